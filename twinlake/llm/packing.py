"""Best-fit packing of tokenized documents into sequences: best two fit.

Documents are tokenized (ids plus an end id), and only those longer than a
sequence are cut.  A bin is filled greedily with the longest piece that fits;
when none does and room is left, its smallest piece gives way to the two unpacked
pieces that fill the expanded gap best, if they fill it better.

Workers tokenize and keep lengths and checksums; texts and ids are never shuffled.
Pieces are dealt at random into groups of ``PIECES_PER_GROUP``, each packed in one
task on a histogram of lengths.  A group has the corpus's mix of lengths, so
packing by groups costs at most its last bins.

``packed_in_order`` keeps the order of the documents instead (the mixing stage's):
a group is a range of it, and a sequence is numbered by the place of its longest
piece, so sequence ids follow the order to within a group.

Results in special cases
* Null and empty texts: one piece, the end id alone.
* Equal lengths are taken in the order of their rows; repeated rows are packed each.
* Texts of any length: cut at full sequences, which are sequences of their own.
* Only id and text are read.  Empty table: empty result.
* A document longer than ``LONG_CHARS`` is tokenized in parts that end before white
  space, which gives the same ids, as the tokenizer never joins words.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import documents, pin, worker_cache

SEQUENCE_TOKENS = 4096
END_ID = 1
PIECES_PER_GROUP = 50_000
LONG_CHARS = 1 << 20
#: Words whose ids a worker remembers before it starts again, and the longest that it remembers.
CACHED_WORDS, CACHED_CHARS = 500_000, 64
#: Bits of a piece's number in the id of a sequence that has a place.
PIECE_BITS = 26

#: Texts of these characters only are cut into words here, by the tokenizer's own pattern; others go to it whole.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ]+|[0-9²³¹¼½¾]|[^\t-\r 0-9a-zA-Zªµº²³¹¼½¾À-ÖØ-öø-ɏ]+")


class WordTokenizer:
    """ids of a text as little-endian 32-bit bytes.  Words repeat far more than texts, so ids are kept by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self._encode(text)
        words = WORD.findall(unicodedata.normalize("NFC", text).lower())
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHED_WORDS:
                known.clear()
            new = [w for w in set(words) if w not in known]
            self._learn([w for w in new if len(w) <= CACHED_CHARS])
            long = {w: self._encode(w) for w in new if len(w) > CACHED_CHARS}
            return b"".join([long[w] if w in long else known[w] for w in words] if long else map(known.__getitem__, words))

    def _learn(self, words: list[str]) -> None:
        """All words in one call, cut where a word's last piece is."""
        ids = np.asarray(self.whole.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) == len(words):
            data = ids.tobytes()
            self.known.update(zip(words, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        else:
            self.known.update((w, self._encode(w)) for w in words)


def parts(text: str, limit: int = LONG_CHARS) -> Iterator[str]:
    a = 0
    while len(text) - a > limit:
        cut = text.rfind(" ", a + 1, a + limit)
        if cut < 0:
            cut = text.find(" ", a + limit)
            if cut < 0:
                break
        yield text[a:cut]
        a = cut
    yield text[a:] if a else text


def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache("packing", path, lambda: WordTokenizer(path))


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
           place_col: str | None = None) -> DataFrame:
    """One row for each piece of a document, with the CRC-32 of its ids (unsigned little-endian 32-bit) and, if named, the document's place."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64() for _ in [place_col] if place_col]]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            places = zip(batch.column(2).to_pylist()) if place_col else [()] * len(batch)
            for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), places, strict=True):
                text = text.as_py() or ""
                ids = b"".join([*map(tok.ids, parts(text)), end])
                for k, a in enumerate(range(0, len(ids), 4 * sequence)):
                    own = ids[a: a + 4 * sequence]
                    rows.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own), *place))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias("place") for c in [place_col] if c]]
    return docs.select(*own).mapInArrow(run, PIECE + ", place long" if place_col else PIECE)


def best_two_fit(counts: list[int], capacity: int) -> Iterator[list[int]]:
    """Bins (lists of lengths) for ``counts[l]`` pieces of length l, 0 < l < capacity.

    Lengths that are left form a bit set, and so do they mirrored: a shift of one against the other shows
    whether two lengths with a given sum are left.
    """
    counts = list(counts)
    left = sum(1 << x for x in range(1, capacity) if counts[x])
    mirror = sum(1 << (capacity - x) for x in range(1, capacity) if counts[x])

    def take(x: int) -> None:
        nonlocal left, mirror
        counts[x] -= 1
        if not counts[x]:
            left &= ~(1 << x)
            mirror &= ~(1 << (capacity - x))

    def put(x: int) -> None:
        nonlocal left, mirror
        counts[x] += 1
        left |= 1 << x
        mirror |= 1 << (capacity - x)

    def pair(most: int, least: int) -> tuple[int, int] | None:
        """Two lengths left whose sum is as large as possible, at most ``most`` and over ``least``."""
        for total in range(most, least, -1):
            both = left & (mirror << (total - capacity) if total >= capacity else mirror >> (capacity - total)) & ((1 << total) - 2)
            if not total % 2 and counts[total // 2] == 1:
                both &= ~(1 << (total // 2))
            if both:
                x = both.bit_length() - 1
                return x, total - x
        return None

    while left:
        gap, own = capacity, []
        while fits := left & ((1 << (gap + 1)) - 1):
            x = fits.bit_length() - 1
            take(x)
            own.append(x)
            gap -= x
        if gap and left:
            smallest = own[-1]
            if two := pair(gap + smallest, smallest):
                own.pop()
                put(smallest)
                for x in two:
                    take(x)
                    own.append(x)
        yield own


def _pack_group(sequence: int, ordered: bool = False):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        counts = np.bincount(lengths, minlength=sequence)
        at = (np.cumsum(counts) - counts).tolist()
        order, bins, offsets = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        n = 0
        for b, own in enumerate(best_two_fit(counts.tolist(), sequence)):
            offset = 0
            for x in own:
                order[n], bins[n], offsets[n] = at[x], b, offset
                at[x] += 1
                offset += x
                n += 1
        out = pdf.iloc[order].reset_index(drop=True)
        out["offset"] = offsets
        # a bin's first piece is its longest; no other bin has its row
        out["sequence_id"] = out["_row"].where(out["offset"] == 0).ffill().astype(np.int64) if ordered else (int(key[0]) << 32) + bins
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_no_id"]]

    return run


def pack(rows: DataFrame, sequence: int = SEQUENCE_TOKENS, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Pieces (see ``pieces``) with sequence_id and offset."""
    rows = pin(rows.withColumn("_row", F.monotonically_increasing_id()))
    full = rows.filter(F.col("length") == sequence).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = rows.filter(F.col("length") < sequence)
    n = max(1, -(-open_.count() // pieces_per_group))
    dealt = open_.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n)))
    return _packed_groups(dealt, sequence, False).unionByName(full)


def pack_in_order(rows: DataFrame, sequence: int = SEQUENCE_TOKENS, pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """As ``pack``, for pieces with their documents' places (0, 1, 2, ...), by ranges of places.

    A document has one piece at most that is shorter than a sequence, so a range of ``pieces_per_group`` documents
    has no more such pieces, and the place and number of a sequence's longest piece are its own.
    """
    rows = rows.withColumn("_row", F.col("place") * F.lit(1 << PIECE_BITS) + F.col("piece"))
    rows = pin(rows.withColumn("_group", F.floor(F.col("place") / F.lit(pieces_per_group)).cast("long")).drop("place"))
    full = rows.filter(F.col("length") == sequence).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return _packed_groups(rows.filter(F.col("length") < sequence), sequence, True).unionByName(full)


def _packed_groups(dealt: DataFrame, sequence: int, ordered: bool) -> DataFrame:
    dealt = dealt.withColumn("_no_id", F.col("doc_id").isNull())
    dealt = dealt.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))  # pandas has no null among integers
    packed = dealt.groupBy("_group").applyInPandas(_pack_group(sequence, ordered), PIECE + ", sequence_id long, offset long, _no_id boolean")
    return packed.withColumn("doc_id", F.when(~F.col("_no_id"), F.col("doc_id"))).drop("_no_id")


def with_places(docs: DataFrame, name: str = "_place") -> DataFrame:
    """``docs`` with each row's place in the order it was written: by file and row of Parquet files, else by partition and row.

    Readers deal files to tasks by size, so the order of the rows that they give is not that of the files.
    """
    try:
        own = docs.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        at = F.monotonically_increasing_id()
        own = pin(docs.withColumn("_at", at)).withColumn("_file", F.concat(F.lit("part-"), F.shiftright("_at", 33).cast("string")))
        own = own.withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    part, more = (F.coalesce(F.try_element_at(F.regexp_extract_all("_file", F.lit(p), 1), F.lit(1)).cast("long"), F.lit(0)) for p in ("^part-([0-9]+)", "-c([0-9]+)[.]"))
    before = Window.orderBy(part, more, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = own.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each file
    return own.join(F.broadcast(files), "_file").withColumn(name, F.col("_before") + F.col("_at"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    return pack(pieces(docs, path or tokenizer_path(), **options))


def packed_in_order(docs: DataFrame, path: str | None = None, pieces_per_group: int = PIECES_PER_GROUP, **options) -> DataFrame:
    """As ``packed``, with sequences in the order of ``docs`` (see ``with_places``)."""
    id_col, text_col, sequence = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("sequence", SEQUENCE_TOKENS)
    placed = with_places(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    options = {k: v for k, v in options.items() if k not in ("id_col", "text_col")}
    return pack_in_order(pieces(placed, path or tokenizer_path(), place_col="_place", **options), sequence, pieces_per_group)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
