"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters.  A seed lexicon, and words and word beginnings that labelled training rows
   set apart (log-likelihood ratio).  A voter votes "toxic" where a text has its word
   or beginning, else it abstains.  Training rows are a bounded sample of labelled rows.
2. Label model.  One scan of the whole corpus counts how often each voter fires and
   each two fire together.  With prior pi and rates a = P(fire | toxic) and
   b = P(fire | clean), voters that are independent given the label have covariance
   u_j * u_k, u = sqrt(pi (1 - pi)) * (a - b); triplets of voters give u, and u with the
   firing rate gives a and b.  Pairs that fire together more than u_j * u_k allows are
   correlated; such voters form one cluster, which has one vote.
3. Classifier.  The posterior of the label model labels the training texts, and a
   logistic regression over the patterns is fitted to these posteriors.  Its scale and
   offset are set on the training rows' labels.

Labels are read only from rows whose crc32(id as text) mod 3 is not 1.  Language, source
and id are never inputs of a score.

Results in special cases
* Null and empty texts get the score of a text without any pattern.
* Without labels, or without toxic ones among the training rows, the seed lexicon
  votes alone and the prior is ``PRIOR``.
* Equal texts get equal scores, repeated rows included.  Texts are scored whole.
* Empty table: empty result.  Other columns of ``docs`` are kept as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import documents, labels, worker_cache

#: Bound of the sample of labelled training rows, by hash of the id.
TRAIN_ROWS = 20_000
#: Bounds of the voters and of the classifier's patterns.
MAX_VOTERS = 256
MAX_PATTERNS = 2_048
#: A pattern needs this log-likelihood ratio, and this share of toxic rows among those that have it.
MIN_RATIO, MIN_PRECISION = 24.0, 0.6
#: Correlation beyond what the label explains that joins two voters to a cluster.
CORRELATED = 0.25
PRIOR = 0.05
REJECT = 0.7
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)

# Seed lexicon of insults.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile")


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 3 == 1


def patterns_of(word: str) -> list[str]:
    """A word itself, and its beginnings marked with a star."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) >= k]]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Matcher(dict):
    """word -> indices of its patterns in ``patterns``; remembers up to ``limit`` words of at most 64 characters."""

    def __init__(self, patterns: list[str], limit: int = 200_000):
        self.index, self.limit = {p: i for i, p in enumerate(patterns)}, limit

    def __missing__(self, word: str) -> tuple:
        out = tuple(self.index[p] for p in patterns_of(word) if p in self.index)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out

    def fired(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for w in text_words(text):
            if hit := self[w]:
                out.update(hit)
        return out


def _matcher(patterns: list[str]) -> Matcher:
    return worker_cache("toxicity", tuple(patterns), lambda: Matcher(patterns))


# -- 1. voters --------------------------------------------------------------

def training_rows(docs: DataFrame, marks: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, y) of at most ``rows`` labelled rows that are not held out, one an id (that with the smallest text hash), ids by hash.

    An id that is labelled twice counts as toxic if either is.  The texts of an id are reduced to one before the shuffle."""
    own = marks.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("y"))
    own = own.filter(~held_out(F.col("_label_id")) & F.col("y").isNotNull() & F.col("_label_id").isNotNull())
    own = own.groupBy("_label_id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("_label_id").cast("string")), "_label_id").limit(rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("_id") == F.col("_label_id"))  # at most `rows` ids
    one = found.groupBy("_label_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.orderBy(F.md5(F.col("_label_id").cast("string")), "_label_id").select("text", "y")


def _pattern_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows():
        keys = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["pattern", "tox", "clean"])

    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[y > 0].update({p for w in text_words(text.as_py()) for p in patterns_of(w)})
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield rows()
                counts[0].clear(), counts[1].clear()
    yield rows()


def _ratio() -> Column:
    """Log-likelihood ratio of (tox of n_tox) against (clean of n_clean)."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    t, c, nt, nc = F.col("tox"), F.col("clean"), F.col("n_tox"), F.col("n_clean")
    rate = (t + c) / (nt + nc)
    return 2 * (part(t, nt * rate) + part(c, nc * rate) + part(nt - t, nt * (1 - rate)) + part(nc - c, nc * (1 - rate)))


def learned_patterns(train: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """(pattern, toxic rows, clean rows) of the patterns that stand out, strongest first, and the numbers of toxic and clean rows."""
    counts = train.mapInArrow(_pattern_counts, "pattern string, tox long, clean long").groupBy("pattern").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
    n = train.agg(F.count_if(F.col("y") > 0).alias("tox"), F.count_if(F.col("y") <= 0).alias("clean")).first()
    own = counts.filter(F.col("tox") > 1).withColumn("n_tox", F.lit(n["tox"])).withColumn("n_clean", F.lit(n["clean"]))
    own = own.withColumn("_ratio", _ratio()).filter((F.col("_ratio") >= MIN_RATIO) & (F.col("tox") * F.col("n_clean") > F.col("clean") * F.col("n_tox"))
                                                    & (F.col("tox") >= MIN_PRECISION * (F.col("tox") + F.col("clean"))))
    top = own.orderBy(F.col("_ratio").desc(), "pattern").limit(MAX_PATTERNS).select("pattern", "tox", "clean").collect()
    return [tuple(r) for r in top], int(n["tox"]), int(n["clean"])


# -- 2. label model ---------------------------------------------------------

def co_firing(docs: DataFrame, voters: list[str], text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many rows of the whole corpus fire both voters (the diagonal: one), and the number of rows."""
    m = len(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, n = _matcher(voters), np.zeros((m, m), np.int64), 0
        for batch in batches:
            n += len(batch)
            for text in batch.column(0):
                if hit := sorted(own.fired(text.as_py())):
                    total[np.ix_(hit, hit)] += 1
        j, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*j, -1], pa.int32()), pa.array([*k, -1], pa.int32()), pa.array([*total[j, k], n], pa.int64())], ["j", "k", "c"])

    rows = docs.select(text_col).mapInArrow(run, "j int, k int, c long").groupBy("j", "k").agg(F.sum("c").alias("c")).collect()  # at most m * m + 1
    both, n = np.zeros((m, m)), 0
    for r in rows:
        if r["j"] < 0:
            n = r["c"]
        else:
            both[r["j"], r["k"]] = r["c"]
    return both, n


@dataclass
class LabelModel:
    prior: float
    a: np.ndarray
    b: np.ndarray
    cluster: np.ndarray

    def posterior(self, fired: set[int]) -> float:
        """P(toxic | votes): a cluster has the vote of its strongest voter that fired, or of its strongest that did not."""
        odds = np.log(self.prior / (1 - self.prior))
        yes, no = np.log(self.a / self.b), np.log((1 - self.a) / (1 - self.b))
        hit = {}
        for j in fired:
            c = self.cluster[j]
            hit[c] = max(hit.get(c, -np.inf), yes[j])
        silent = {c: no[self.cluster == c].min() for c in set(self.cluster.tolist()) - set(hit)}
        return float(1 / (1 + np.exp(-np.clip(odds + sum(hit.values()) + sum(silent.values()), -30, 30))))


def fit_label_model(both: np.ndarray, n: int, prior: float, guess_a: np.ndarray, guess_b: np.ndarray) -> LabelModel:
    """Rates and correlations from the corpus's moments.  ``guess_a``, ``guess_b``: rates among training rows, used
    where a voter has no triplet and to weigh triplets that disagree."""
    m = len(guess_a)
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(prior * (1 - prior))
    u = np.maximum(scale * (guess_a - guess_b), 1e-9)
    together = (cov > 0) & ~np.eye(m, dtype=bool)
    cluster = np.arange(m)
    for _ in range(3):
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        extra = (cov - np.outer(u, u)) / np.outer(sd, sd)
        linked = together & (extra > CORRELATED)
        cluster = np.arange(m)
        for j in range(m):  # clusters: least index that is linked
            for k in np.flatnonzero(linked[j]):
                lo, hi = sorted((cluster[j], cluster[k]))
                cluster[cluster == hi] = lo
        fresh = u.copy()
        for j in range(m):
            others = np.flatnonzero(together[j] & ~linked[j])
            if len(others) > 2:
                block = cov[np.ix_(others, others)]
                ok = together[np.ix_(others, others)] & ~linked[np.ix_(others, others)]
                products = np.outer(cov[j, others], cov[j, others])[ok] / np.maximum(block[ok], 1e-12)
                if len(products) > 2:
                    fresh[j] = np.sqrt(max(np.median(products), 1e-18))
        u = np.sqrt(u * fresh)  # half a step: triplets and what is known so far
    a = np.clip(p + u * (1 - prior) / scale, 1e-6, 1 - 1e-6)
    b = np.clip(p - u * prior / scale, 0, None)
    b = np.clip(np.maximum(b, guess_b * 0.1 + 0.5 / max(n, 1)), 1e-7, 1 - 1e-6)
    return LabelModel(prior, np.maximum(a, 1.5 * b).clip(None, 1 - 1e-6), b, cluster)


# -- 3. classifier ----------------------------------------------------------

@dataclass
class Classifier:
    patterns: list[str]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, matcher: Matcher | None = None) -> float:
        fired = (matcher or _matcher(self.patterns)).fired(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[j] for j in fired), -30, 30))))


def fit_linear(rows: list[list[int]], target: np.ndarray, m: int, ridge: float = 1e-2, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; weights are not negative, as all patterns speak for toxic."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((j for r in rows for j in r), np.int64, len(row))
    share = np.where(target > 0.5, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)) * len(rows)  # both sides weigh the same
    w, bias, vw, vb = np.zeros(m), -2.0, np.zeros(m), 0.0
    n = max(len(rows), 1)
    seen = np.maximum(np.bincount(col, weights=share[row], minlength=m) / n, 1e-4) if len(row) else np.ones(m)
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + bias if len(row) else np.full(len(rows), bias)
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        gw = (np.bincount(col, weights=error[row], minlength=m) if len(row) else np.zeros(m)) / n + ridge * seen * w
        vw, vb = 0.9 * vw - 0.1 * gw / np.sqrt(seen), 0.9 * vb - 0.1 * error.sum() / n
        w, bias = np.maximum(w + vw, 0), bias + vb
    return w, float(bias)


def fit(docs: DataFrame, marks: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """The classifier for ``docs``, with labels from ``marks`` (id, toxic)."""
    train = training_rows(docs, marks, train_rows, id_col, text_col)
    found, n_tox, n_clean = learned_patterns(train)
    known = {p: (t, c) for p, t, c in found}
    patterns = [*[s for s in SEEDS if s not in known], *known][:MAX_PATTERNS]
    voters = [*[s for s in SEEDS if s not in known], *known][:MAX_VOTERS]
    prior = min(max((n_tox + 1) / (n_tox + n_clean + 2), 0.01), 0.5) if n_tox else PRIOR
    guess_a = np.array([(known.get(v, (1, 0))[0] + 0.5) / (n_tox + 10) for v in voters])
    guess_b = np.array([(known.get(v, (1, 0))[1] + 0.05) / (n_clean + 10) for v in voters])
    both, n = co_firing(docs, voters, text_col)
    model = fit_label_model(both, n, prior, guess_a, guess_b)

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _matcher(patterns)
        for batch in batches:
            hits = [sorted(every.fired(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], ["fired", "y"])

    rows = train.mapInArrow(fired, "fired array<int>, y int").collect()  # at most train_rows
    index = {v: j for j, v in enumerate(voters)}
    votes = [{index[patterns[j]] for j in r["fired"] if patterns[j] in index} for r in rows]
    target = np.array([model.posterior(v) for v in votes])
    w, bias = fit_linear([r["fired"] for r in rows], target, len(patterns))
    if not rows:  # no labelled text: the label model's own evidence for each pattern
        w = np.array([np.log(model.a[j] / model.b[j]) for j in range(len(voters))] + [0.0] * (len(patterns) - len(voters)))
        bias = float(np.log(prior / (1 - prior)))
    y = np.array([r["y"] for r in rows], float)
    if n_tox and len(rows):
        z = np.array([bias + sum(w[j] for j in r["fired"]) for r in rows])
        scale, offset = calibrated(z, y)
        w, bias = w * scale, bias * scale + offset
    return Classifier(patterns, w, bias)


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """scale > 0 and offset of the logistic curve that fits labels best (Newton steps, lightly damped)."""
    s, o = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(s * z + o, -30, 30)))
        g = np.array([((q - y) * z).sum() + 0.01 * (s - 1), (q - y).sum() + 0.01 * o])
        v = q * (1 - q)
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        s, o = max(s - step[0], 0.05), o - step[1]
    return float(s), float(o)


def score_column(model: Classifier, text: Column) -> Column:
    """The classifier's score of a text column, JVM columns beside it untouched."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = _matcher(model.patterns)
        return pd.Series([model.score(t, own) for t in texts], dtype="float64")

    return score(text)


def without_toxic(docs: DataFrame, marks: DataFrame, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``reject``, with its columns."""
    model = fit(docs, marks, id_col=id_col, text_col=text_col)
    return docs.filter(score_column(model, F.col(text_col)) < reject)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))
