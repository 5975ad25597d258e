"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Greedy longest match cuts a word into the
longest piece that the vocabulary has, again and again.  Where the trie cannot go
on from a node, a failure link gives the node for what remains of the word after
the pieces that are then certain, and a count says how many those are.  One pass
over a word's bytes adds up counts; no piece is built and no byte is read twice.

The vocabulary is that of a byte-level tokenizer: it has every byte, so each word
can be cut.  A word is looked up with a space before it, which the vocabulary's
word-initial pieces begin with.

Results in special cases
* Null and empty texts, and white space alone: 0 words, 0 tokens.
* Words of any length take time in proportion to their bytes.
* Rows are counted one by one, so ties and repeated rows get equal counts; an
  empty table gives an empty one.  Only id and text are read.
* A vocabulary that lacks a byte: ValueError.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import documents, utf8, worker_cache

#: Words whose counts a worker remembers before it starts again, and the longest (bytes) that it remembers: about 100 MB at most.
CACHED_WORDS, CACHED_BYTES = 500_000, 64


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    out |= {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    return out


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", ())}
    alphabet = byte_of_char()
    return [bytes(alphabet[c] for c in piece) for piece in file["model"]["vocab"] if piece not in special]


class Automaton:
    """``edges`` (node * 256 + byte -> node), ``fail`` and ``popped`` (pieces certain when the link is taken), by node; 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        if missing := set(range(256)) - {p[0] for p in pieces if len(p) == 1}:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        edges: dict[int, int] = {}
        final, order, n = [False], [(0, 0, 0)], 1
        for piece in pieces:
            at = 0
            for b in piece:
                to = edges.get(at * 256 + b)
                if to is None:
                    to = edges[at * 256 + b] = n
                    final.append(False)
                    order.append((at, b, n))
                    n += 1
                at = to
            final[at] = True
        depth = [0] * n
        for at, _, to in order[1:]:
            depth[to] = depth[at] + 1
        fail, popped = [-1] * n, [0] * n
        for at, b, to in sorted(order[1:], key=lambda e: depth[e[2]]):  # parents first
            if final[to]:
                fail[to], popped[to] = 0, 1
                continue
            z, count = fail[at], popped[at]
            while z >= 0 and z * 256 + b not in edges:
                count += popped[z]
                z = fail[z]
            if z >= 0:
                fail[to] = edges[z * 256 + b]
            popped[to] = count
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: bytes) -> int:
        edges, fail, popped, at, n = self.edges, self.fail, self.popped, 0, 0
        for b in word:
            to = edges.get(at * 256 + b)
            while to is None:
                n += popped[at]
                at = fail[at]
                to = edges.get(at * 256 + b)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class Counts(dict):
    """word -> tokens of " word"; missing words go through the automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text",
                 words_as: str = "n_words", tokens_as: str = "n_tokens") -> DataFrame:
    """(id, n_words, n_tokens) of every row.  The vocabulary goes to the workers once (its size is fixed)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hashlib.sha256(b"\0".join(pieces)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("token_count", name, lambda: Counts(Automaton(shared.value)))
        for batch in batches:
            data, at = utf8(batch.column(1))
            data, n = data.tobytes(), len(batch)
            n_words, n_tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                words = data[at[i]: at[i + 1]].split()
                n_words[i] = len(words)
                n_tokens[i] = sum(map(known.__getitem__, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], [id_col, words_as, tokens_as])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{words_as}` long, `{tokens_as}` long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary(vocabulary_path()))
