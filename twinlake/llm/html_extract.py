"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  A word scores positive, a tag negative;
the contiguous region with the largest sum, found by one linear scan, is the
content.  Weights come from labelled pages: those whose own markup names the
content (``article``, ``main``, role=main, itemprop=articleBody).  There a word's
weight is the share of content among words in its place (block tag, link or not),
a tag's cost ``scale`` times the share of its occurrences outside the content, and
``scale`` the value of ``SCALES`` whose regions agree best with the labels (F1 over
words).  Names of the labelling tags are no features.

Elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments by tag, role, class or id are holes: their words
score nothing and are never returned, their tags count like others.  The region is then
widened to the element around it (an ``article`` or ``main`` if there is one) where at
least half of that element's words are in the region.

Tasks parse pages, one at a time; parsing and the scan are linear in the page.
Learning reads about ``TRAIN_PAGES`` rows, chosen by a seeded random number, and sums counts in
Spark: what reaches the driver is a table of a few hundred features.

Results in special cases
* Null and empty html, and pages without words outside holes: empty text.
* Broken markup: unclosed p, b and li, missing ends, stray end tags and ``<`` as text are read as browsers do,
  roughly; a hole whose end tag never comes ends at the next block.
* Character references are decoded, white space inside a block (``br`` too) becomes one space, blocks are joined by
  one newline in page order.  Pages of any length are read whole.  Of equal regions the first counts.
* No labelled page: a word scores 1 and a tag -3.25.
* Null ids and repeated pages: rows like others.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages that weights are learned from, about.
TRAIN_PAGES = 4000
#: Candidates for the price of a tag, in words.
SCALES = (0.5, 1.0, 2.0, 4.0, 8.0)
#: Weights without labelled pages, as published for the method.
WORD_WEIGHT, TAG_COST = 1.0, 3.25
#: Least weight of a word and cost of a tag.
LEAST = 0.02

# HTML's block elements, other elements, void elements and elements whose content is not markup.
BLOCKS = frozenset("""address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select
summary table tbody td tfoot th thead title tr ul""".split())
INLINE = frozenset("a abbr b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "template", "noembed", "noframes", "svg", "object", "audio", "video", "canvas")
# An open element of these ends when one of its kind begins beside it.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
# Tags, roles and words of class and id names that mark what is not the article.
HOLE_TAGS = frozenset("nav footer aside form button select menu dialog noscript fieldset".split())
HOLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
HOLE_WORDS = frozenset("""ad ads adbox adsense adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent
cookie cookies copyright disclaimer discussion disqus followus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices
notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended recommendations register related replies reply respond
responses share sharebar sharing sidebar signin signup skiplink social sponsor sponsored submenu subscribe subscription taboola toolbar topbar trending widget""".split())
HEADER_WORDS = frozenset("header heading topbar masthead".split())
STATE_WORDS = frozenset("has with no without is hide show".split())

COMMENT = r"<!--.*?(?:-->|\Z)"
TAG = r"</?[a-zA-Z][^\s/<>]*+(?:[^'\"<>]|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>"
TOKEN = re.compile(f"{COMMENT}|<[!?][^>]*+>|{TAG}", re.DOTALL)
NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
ATTRIBUTE = re.compile(r"""(?<=[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _names_hole(value: str, in_label: bool) -> bool:
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        if not parts or parts[0] in STATE_WORDS:
            continue
        ends = {parts[0], parts[-1]} if parts[0] not in HEADER_WORDS and parts[-1] not in HEADER_WORDS else (set() if in_label else {"masthead"})
        if ends & HOLE_WORDS:
            return True
    return False


def _marks(tag: str, name: str, in_label: bool) -> tuple[bool, bool]:
    """(is a hole, names the content) of a start tag."""
    found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(tag)} if "=" in tag else {}
    role, prop = found.get("role", "").lower(), found.get("itemprop", "").lower()
    if name in ("html", "body"):
        return False, False
    label = name in ("article", "main") or role == "main" or prop == "articlebody"
    hole = (name in HOLE_TAGS or (name == "header" and not in_label) or role in HOLE_ROLES or prop == "comment"
            or (name != "main" and (_names_hole(found.get("class", ""), in_label) or _names_hole(found.get("id", ""), in_label))))
    return hole, label and not hole


@dataclass
class Page:
    """A parsed page.  ``runs``: stretches of text as (start, end, words, place, element, block, in a hole, in labelled content);
    ``items``: in page order, the index of a run or the name of a tag, with whether the tag is in labelled content; ``elements``: (name,
    parent, names the content)."""

    runs: list = field(default_factory=list)
    items: list = field(default_factory=list)
    elements: list = field(default_factory=lambda: [("", -1, False)])


def parse(text: str, memory: dict | None = None) -> Page:
    page, memory = Page(), {} if memory is None else memory
    runs, items, elements = page.runs, page.items, page.elements
    stack, opened, last_end = [(0, "", False, False)], {}, {}  # (element, name, hole, label); open elements by name
    holes = labels = block = links = 0
    place, at, unended = "", 0, []

    def close(upto: int) -> None:
        nonlocal holes, labels
        while len(stack) > upto:
            _, name, hole, label = stack.pop()
            opened[name] -= 1
            holes -= hole
            labels -= label

    def run(a: int, b: int) -> None:
        words = len(text[a:b].split())
        runs.append((a, b, words, (place, links > 0), stack[-1][0], block, holes > 0, labels > 0))
        if words:
            items.append((len(runs) - 1, False))

    n = len(text)
    while at < n:
        m = TOKEN.search(text, at)
        a = m.start() if m else n
        if a > at:
            run(at, a)
        if not m:
            break
        at, tag = m.end(), m.group()
        named = NAME.match(tag)
        if not named:
            continue
        name = named.group(1).lower()
        known = name if name in BLOCKS or name in INLINE else "other"
        is_block, ending = name in BLOCKS, tag[1] == "/"
        if name in RAW and not ending:
            if not tag.endswith("/>"):
                end = re.compile(f"</{name}[^>]*>", re.IGNORECASE).search(text, at)
                at = end.end() if end else n
            if is_block:
                block += 1
            items.append((known, labels > 0))
            continue
        if is_block:
            block += 1
        if name == "br":
            runs.append((a, a, 0, (place, False), stack[-1][0], block, holes > 0, labels > 0))
        if ending:
            if name == "a" and links:
                links -= 1
            items.append((known, labels > 0))
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][1] != name:
                    k -= 1
                close(k)
            if is_block:
                place = stack[-1][1] if stack[-1][1] in BLOCKS else ""
            continue
        if is_block:
            while unended and unended[-1] >= len(stack):
                unended.pop()
            if unended:  # a hole whose end never comes
                close(unended[0])
                unended.clear()
            while stack[-1][1] == "p":
                close(len(stack) - 1)
            while stack[-1][1] in SIBLINGS.get(name, ()):
                close(len(stack) - 1)
        if name in VOID or tag.endswith("/>") and not is_block:
            items.append((known, labels > 0))
            continue
        if name == "a":
            links += 1
        key = (tag, labels > 0)
        mark = memory.get(key)
        if mark is None:
            mark = _marks(tag, name, labels > 0)
            if len(tag) <= 200:
                if len(memory) > 20_000:
                    memory.clear()
                memory[key] = mark
        hole, label = mark
        if is_block or hole or label or holes:
            elements.append((name, stack[-1][0], label))
            stack.append((len(elements) - 1, name, hole, label))
            opened[name] = opened.get(name, 0) + 1
            holes += hole
            labels += label
            if hole:
                if name not in last_end:
                    last_end[name] = max((e.start() for e in re.finditer(f"</{re.escape(name)}[\\s>]", text, re.IGNORECASE)), default=-1)
                if last_end[name] < at:
                    unended.append(len(stack) - 1)
        if is_block:
            place = name
            links = 0
        items.append(("" if label else known, labels > 0))  # a labelling tag is no feature
    return page


# -- weights and the scan ------------------------------------------------------------

@dataclass
class Weights:
    """Scores of words by place, costs of tags by name before ``scale``."""

    words: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)
    scale: float = TAG_COST

    def word(self, place: tuple) -> float:
        return self.words.get(place, WORD_WEIGHT if not self.words else 0.5)

    def cost(self, name: str) -> float:
        return max(LEAST, self.scale * self.tags.get(name, 1.0 if not self.tags else 0.5)) if name else LEAST


def best_region(page: Page, w: Weights) -> tuple[int, int, float]:
    """First and last run of the maximum-scoring subsequence, and its score; (0, -1, 0) without one."""
    best, first, last, score, start = 0.0, 0, -1, 0.0, None
    costs: dict = {}
    for item, _ in page.items:
        if isinstance(item, int):
            run = page.runs[item]
            if run[6]:
                continue
            if start is None:
                start = item
            score += run[2] * w.word(run[3])
            if score > best:
                best, first, last = score, start, item
        else:
            if item not in costs:
                costs[item] = w.cost(item)
            score -= costs[item]
            if score <= 0:
                score, start = 0.0, None
    return first, last, best


def widened(page: Page, first: int, last: int) -> tuple[int, int]:
    """The region, widened to the innermost element around it, or to the article around that, of whose words the region has half."""
    if last < first:
        return first, last
    runs, elements = page.runs, page.elements

    def chain(e: int) -> list[int]:
        up = []
        while e > 0:
            up.append(e)
            e = elements[e][1]
        return up

    shared = set(chain(runs[last][4]))
    around = next((e for e in chain(runs[first][4]) if e in shared), 0)
    candidates = [e for e in chain(around) if elements[e][2]][:1] or [around]
    e = candidates[0]
    if e <= 0 or elements[e][0] in ("html", "body"):
        return first, last
    inside = {0: False, e: True}

    def within(x: int) -> bool:
        path = []
        while x not in inside:
            path.append(x)
            x = elements[x][1]
        for p in path:
            inside[p] = inside[x]
        return inside[x]

    members = [i for i, r in enumerate(runs) if r[2] and not r[6] and within(r[4])]
    have = sum(runs[i][2] for i in members if first <= i <= last)
    if 2 * have >= sum(runs[i][2] for i in members):
        return min(first, members[0]), max(last, members[-1])
    return first, last


def region_text(text: str, page: Page, first: int, last: int) -> str:
    """The blocks of a region, without holes."""
    blocks: dict[int, list[str]] = {}
    for a, b, _, _, _, block, hole, _ in page.runs[first: last + 1]:
        if not hole:
            blocks.setdefault(block, []).append(entities.unescape(text[a:b]) if b > a else " ")
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in joined if b)


# -- learning -------------------------------------------------------------------------

def _pages(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[Page]:
    memory: dict = {}
    for batch in batches:
        for value in batch.column(column):
            page = parse(value.as_py() or "", memory)
            if any(label for _, _, label in page.elements):
                yield page


def _rows(counts: dict) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                      pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64()),
                                      pa.array([v[2] for v in counts.values()], pa.int64())], names=["kind", "feature", "x", "y", "z"])


_COUNTS = "kind string, feature string, x long, y long, z long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature: how often in the content (x) and in all (y)."""
    counts: dict = {}
    for page in _pages(batches):
        for item, label in page.items:
            if isinstance(item, int):
                _, _, words, (place, link), _, _, hole, label = page.runs[item]
                own = counts.setdefault(("link" if link else "word", place), [0, 0, 0])
                own[0] += words * (label and not hole)
                own[1] += words
            elif item:
                own = counts.setdefault(("tag", item), [0, 0, 0])
                own[0] += label
                own[1] += 1
    yield from _rows(counts)


def _agreement(candidates: list[Weights]):
    """Of each candidate: words of the region that are content (x), words of the region (y), words of the content (z)."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {("scale", str(k)): [0, 0, 0] for k in range(len(candidates))}
        for page in _pages(batches):
            content = sum(r[2] for r in page.runs if r[7] and not r[6])
            for k, w in enumerate(candidates):
                first, last, _ = best_region(page, w)
                own = counts["scale", str(k)]
                own[0] += sum(r[2] for r in page.runs[first: last + 1] if r[7] and not r[6])
                own[1] += sum(r[2] for r in page.runs[first: last + 1] if not r[6])
                own[2] += content
        yield from _rows(counts)

    return step


def fit(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from about ``train_pages`` of the pages, those with a label among them."""
    share = min(1.0, train_pages / max(1, pages.count()))
    train = pages.select(html).filter(F.rand(13) < share)  # by row: copies of one page are thinned like others

    def summed(step) -> list:
        return train.mapInArrow(step, _COUNTS).groupBy("kind", "feature").agg(*[F.sum(c).alias(c) for c in "xyz"]).collect()  # a row for each feature

    words, tags = {}, {}
    for r in summed(_occurrences):
        if r["kind"] == "tag":
            tags[r["feature"]] = 1 - (r["x"] + 0.5) / (r["y"] + 1)
        else:
            words[r["feature"], r["kind"] == "link"] = max(LEAST, (r["x"] + 0.5) / (r["y"] + 1))
    if not words:
        return Weights()
    candidates = [Weights(words, tags, s) for s in SCALES]
    f1 = {int(r["feature"]): 2 * r["x"] / max(1, r["y"] + r["z"]) for r in summed(_agreement(candidates))}
    return candidates[max(range(len(SCALES)), key=lambda k: (f1[k], -abs(SCALES[k] - 2)))]


# -- the operator ---------------------------------------------------------------------

def extract(pages: DataFrame, weights: Weights | None = None, html: str = "html", carry: list[str] = ("page_id", "url")) -> DataFrame:
    """``carry``, and of every page the text, the number of its blocks, the region's place in the html (code points) and its score."""
    w = weights or fit(pages, html)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            out = {"text": [], "start": [], "end": [], "score": []}
            for value in batch.column(0):
                text = value.as_py() or ""
                page = parse(text, memory)
                first, last, score = best_region(page, w)
                first, last = widened(page, first, last)
                out["text"].append(region_text(text, page, first, last))
                out["start"].append(page.runs[first][0] if last >= first else None)
                out["end"].append(page.runs[last][1] if last >= first else None)
                out["score"].append(score)
            yield pa.RecordBatch.from_arrays([pa.array(out["text"], pa.string()), pa.array(out["start"], pa.int64()), pa.array(out["end"], pa.int64()),
                                              pa.array(out["score"], pa.float64()), batch.column(1)], names=["text", "start", "end", "score", "row"])

    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    rows = pages.select(F.col(html).alias("html"), row.alias("row"))
    done = rows.mapInArrow(step, f"text string, start long, end long, score double, row {rows.schema['row'].dataType.simpleString()}")
    blocks = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return done.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)], "text", blocks.alias("n_blocks"), "start", "end", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
