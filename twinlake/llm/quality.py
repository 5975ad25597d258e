"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` gives the statistics of a text and ``RULES`` the thresholds.  Both become
built-in column expressions of a single projection, so a scan with the rules has
no shuffle and no Python on the executors.  Word arrays and window hashes are
bound to lambda variables (``textkit.let``), which computes them once per row.

Results in special cases
* Null and empty texts: no words, so the base rule drops them.
* A rule whose denominator is 0 does not fail.  Rules with ``min_words`` leave shorter texts alone.
* Two windows count as equal when their 64-bit chained hashes are; a false match
  within a text of 20,000 words has probability 1e-11.
* Rows are judged one by one, so ties and repeated rows get equal results; an
  empty table gives an empty one.  Other columns are not touched; ``measured``
  replaces columns that have a statistic's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import SPACE_CHARS, SPACE_RUN, documents, let

# The most frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the of and to in is for that with on as it was by at from be are this an or not which but have has had they you he we his her".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour au il sur pas plus ce se ne avec sont ou son aux cette mais comme".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este".split(),
}
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * numerator / denominator is under ``low`` or over ``high`` per cent and the text has ``min_words``."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table.  Without a denominator the statistic itself is compared.
RULES = (
    Rule("length", "n_words", None, low=10, high=1_000_000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=20),
    Rule("word_length", "word_chars", "n_words", low=250, high=1200, min_words=20),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("upper_case", "n_upper", "word_chars", high=35),
    Rule("stop_words", "n_stop_words", "n_words", low=5, min_words=50),
    Rule("stutter", "n_stutter", "n_words", high=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90, min_words=20),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=40, min_words=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
)
BASE = ("length", "repeated_windows")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more: windows sorted by hash beside their place; the
    places of those with an equal neighbour are merged into covered words."""
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(pairs, places), start, lambda acc, i: F.struct(
            (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda acc: acc["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of all statistics of a text."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    missing = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))

    def of_words(w: Column) -> list[Column]:
        return [F.size(w).cast("long").alias("n_words"),
                F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?\"'()"))).isin(stop))).cast("long").alias("n_stop_words"),
                F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_stutter"),
                _repeat_words(w).alias("n_repeat_words")]

    def of_lines(ls: Column) -> list[Column]:
        return [F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(ls, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(ls, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines")]

    def all_of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE_RUN), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
        return let(words, lambda w: let(lines, lambda ls: F.struct(
            *of_words(w), *of_lines(ls), F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            missing(t, SYMBOLS).cast("long").alias("n_symbols"), missing(t, UPPER).cast("long").alias("n_upper"))))

    return let(F.coalesce(text, F.lit("")), all_of)


STATISTICS = ("n_words", "n_stop_words", "n_stutter", "n_repeat_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines",
              "word_chars", "n_symbols", "n_upper")


def fails(rule: Rule, m: Column) -> Column:
    value = 100 * m[rule.numerator] if rule.denominator else m[rule.numerator]
    base = m[rule.denominator] if rule.denominator else F.lit(1)
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (value < rule.low * base)
    if rule.high is not None:
        bad = bad | (value > rule.high * base)
    return bad & (m["n_words"] >= rule.min_words)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    own = [*STATISTICS, "base_failed", "failed_rules", "kept"]
    rest = [c for c in docs.columns if c not in own]

    def verdict(m: Column) -> Column:
        failed = F.filter(F.array(*[F.when(fails(r, m), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return F.struct(*[m[s].alias(s) for s in STATISTICS],
                        F.coalesce(F.greatest(*[fails(r, m) for r in rules if r.name in BASE], F.lit(False)), F.lit(False)).alias("base_failed"),
                        failed.alias("failed_rules"), (F.size(failed) == 0).alias("kept"))

    own_name = "_quality".ljust(1 + max(map(len, docs.columns)), "_")  # longer than the name of any column
    out = docs.select(*rest, let(measures(F.col(text_col)), verdict).alias(own_name))
    return out.select(*rest, f"{own_name}.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measured(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "n_stop_words", "n_stutter", "n_lines", "n_upper", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def _sql_rules() -> str:
    def bad(r: Rule) -> str:
        value, base = (f"100 * {r.numerator}", r.denominator) if r.denominator else (r.numerator, "1")
        tests = [f"{value} < {r.low} * {base}"] * (r.low is not None) + [f"{value} > {r.high} * {base}"] * (r.high is not None)
        return f"CASE WHEN ({' OR '.join(tests)}) AND n_words >= {r.min_words} THEN '{r.name}' END"

    return f"list_filter([{', '.join(bad(r) for r in RULES)}], lambda x: x IS NOT NULL)"


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) > 0) AS ls FROM t),
win AS (SELECT r, p, list_slice(ws, p, p + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: list_contains([{', '.join(repr(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))}], lower(trim(x, '.,;:!?"''()'))))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_stutter,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(text) - length(translate(text, '{UPPER}', '')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(ls, lambda x: list_contains(['-', '*', '•', '‣'], substr(ltrim(x), 1, 1)))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(ls, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN cover USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  len({_sql_rules()}) = 0 AS kept, n_stop_words, n_stutter, n_lines, n_upper, list_aggregate({_sql_rules()}, 'string_agg', ',') AS failed_rules
FROM m
"""
ORACLE = ORACLE.replace("list_aggregate(", "coalesce(list_aggregate(").replace("'string_agg', ',')", "'string_agg', ','), '')")
