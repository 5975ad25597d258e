"""Secret scans with a recursive decoding worklist.

A text is scanned with the base rules.  Encoded parts of it (URL escapes, Unicode and
character escapes, base64, and compressed data inside base64) are unwrapped into
layers; each layer is scanned and searched for further encoded parts, until none is
left.  Escapes are replaced over the whole text of a layer, so a key and its value meet
however far apart they are.  A layer whose text already occurs among the layers it came
from is a cycle and is not entered again, nor is the same text from the same place.  Each layer knows, for every code point, which part of the
original text it came from, so a find in any layer becomes a span of the original.

Results in special cases
* Null and empty texts: no spans, the digest of the empty string.
* A secret found in several layers at the same place and of the same kind counts once.
* Data that decode to something other than text (invalid UTF-8 or control characters)
  are scanned in their runs of text; without a run of ``LEAST`` ASCII characters they are no layer.
* Compressed data are decompressed until none are left, over all members and what
  follows them.  Over ``MAX_LAYER`` bytes they are scanned in pieces that overlap.
  An encoded run in them that is longer than a piece is scanned in parts, and
  ``n_refused`` counts its cuts, as what is encoded across one is not found.
* ``limit``, if given: decompressed data over so many bytes are refused and counted.
* Rows are scanned one by one: repeated rows get equal results, an empty table an
  empty one.  Only id and text are read; texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import documents

KINDS = ("assign", "access", "hex")
#: Bytes of a piece; decompressed data over it are scanned in pieces that overlap.
MAX_LAYER = 64 << 20
OVERLAP = 4096
CHUNK = 1 << 20
#: zstd gives all that its input holds at once, so it gets little.
ZSTD_CHUNK = 1 << 10

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
CHAR_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
NEXT_LINE = r"[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++={0,2}+"
#: Lines of base64; the last one may have other text after it.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++={{0,2}}+(?={NEXT_LINE})(?:{NEXT_LINE}(?=[\x20\t]*+(?:\r?\n|[^A-Za-z0-9+/_=\x20\t-]|\Z)))*+(?:{NEXT_LINE})?+")
NOT_TEXT = re.compile(r"[\x00-\x08\x0E-\x1F\x7F-\x9F￾￿]")
NO_TEXT = re.compile(r"[\x00-\x08\x0E-\x1F\x7F-\x9F￾￿\ud800-\udfff]")
LEAST = 12
ASCII_RUN = re.compile(rb"[\x20-\x7e]{%d}" % LEAST)
#: Compressed streams inside other data.
SIGNATURE = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Where data may be cut: after a character of no encoding, or a space between words.
BREAK = re.compile(rb"[^A-Za-z0-9+/=_\-%\\&#;\s]|(?<=\S) (?=\S)")
SPACES = re.compile(rb" {2,}")


def base_scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' matches."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(n in lower for n in NAMES):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    return sorted(out)


class Origin:
    """For each code point of a layer, the part [start, end) of the text above that it came from.

    Kept as pieces (first code point, start, step, width): code point i of a piece starts at
    start + (i - first) * step and is ``width`` long; a step of 0 maps the whole piece to one part.
    """

    def __init__(self, pieces: list[tuple[int, int, int, int]]):
        self.pieces, self.firsts = pieces, [p[0] for p in pieces]

    def of(self, i: int) -> tuple[int, int]:
        first, start, step, width = self.pieces[bisect_right(self.firsts, i) - 1]
        a = start + (i - first) * step
        return a, a + width


    def over(self, below: Origin) -> Origin:
        """This origin of an origin: the parts of the text two layers up, for pieces that map one to one or whole."""
        pieces = []
        for k, (first, start, step, width) in enumerate(self.pieces):
            if step == 0:  # one part
                (a, _), (_, b) = below.of(start), below.of(start + width - 1)
                pieces.append((first, a, 0, b - a))
                continue
            n = self.firsts[k + 1] - first if k + 1 < len(self.firsts) else None
            j = bisect_right(below.firsts, start) - 1
            while j < len(below.pieces) and (n is None or below.firsts[j] < start + n):
                low, at, step_, width_ = below.pieces[j]
                skip = max(start - low, 0)
                pieces.append((first + max(low - start, 0), at + skip * step_, step_, width_))
                j += 1
        return Origin(pieces)


@dataclass
class Layer:
    """A decoded text.  ``origin`` leads to ``above``, the nearest base64 text around it or the text itself; layers
    of escapes between are composed into it, so a chain of them keeps no texts and maps in one step."""

    text: str
    origin: Origin | Places | None = None
    above: Layer | None = None

    def inside(self, text: str, origin: Origin | Places) -> Layer:
        if isinstance(origin, Origin) and isinstance(self.origin, Origin):
            return Layer(text, origin.over(self.origin), self.above)
        return Layer(text, origin, Layer("", self.origin, self.above))

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The span of the original text for code points [a, b) of this layer."""
        layer = self
        while layer.above is not None:
            if layer.origin is not None:
                (a, _), (_, b) = layer.origin.of(a), layer.origin.of(b - 1)
            layer = layer.above
        return a, b


def _replaced(text: str, escapes: re.Pattern, decode) -> tuple[str, Origin] | None:
    """The whole text with its escapes replaced.  ``decode``: escapes -> [(characters, their length in the text)]."""
    parts, pieces, at, n = [], [], 0, 0
    for m in escapes.finditer(text):
        chars = decode(m.group())
        if m.start() > at:
            parts.append(text[at: m.start()])
            pieces.append((n, at, 1, 1))
            n += m.start() - at
        at = m.start()
        for c, width in chars:
            pieces.append((n, at, 0, width))
            parts.append(c)
            n += len(c)
            at += width
    if not pieces:
        return None
    if at < len(text):
        parts.append(text[at:])
        pieces.append((n, at, 1, 1))
    return "".join(parts), Origin(pieces)


def _url(escapes: str) -> list[tuple[str, int]]:
    """Bytes that are not UTF-8 stay escapes."""
    out, at = [], 0
    for c in bytes.fromhex(escapes.replace("%", "")).decode("utf-8", "surrogateescape"):
        bad = 0xDC80 <= ord(c) < 0xDD00
        width = 3 if bad else 3 * len(c.encode())
        out.append((escapes[at: at + width] if bad else c, width))
        at += width
    return out


def _characters(escapes: str) -> list[tuple[str, int]]:
    """Escapes that name no character stay."""
    out: list[tuple[int, str]] = []
    for m in ONE_ESCAPE.finditer(escapes):
        digits = next(g for g in m.groups() if g is not None)
        code, own = int(digits, 10 if m.group(4) is not None else 16), m.group()
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= out[-1][0] < 0xDC00:
            high, before = out.pop()
            code, own = 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00, before + own
        out.append((code, own))
    return [(own if c > 0x10FFFF or 0xD800 <= c < 0xE000 else chr(c), len(own)) for c, own in out]


def _text(data: bytes) -> tuple[str, list[int] | range] | None:
    """The text in some bytes and the place of each character's first byte; bytes that are no text become NULs.

    Every rule and every encoding needs a run of ASCII, so data without one of ``LEAST`` characters hold nothing.
    """
    try:
        text = data.decode()
        clean = bool(text) and not NOT_TEXT.search(text)
    except UnicodeDecodeError:
        clean = False
    if not clean:
        if not ASCII_RUN.search(data):
            return None
        text = data.decode("utf-8", "surrogateescape")
    at = range(len(data) + 1) if len(text) == len(data) else list(accumulate((len(c.encode("utf-8", "surrogateescape")) for c in text), initial=0))
    return text if clean else NO_TEXT.sub("\0", text), at


class Refused(Exception):
    """Decompressed data over the caller's limit."""


class Source:
    """Bytes from chunks, read once; ``unread`` puts some back, ``log`` keeps what was read if it is a list."""

    def __init__(self, chunks):
        self.chunks, self.held, self.at, self.log = iter(chunks), b"", 0, None

    def peek(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            parts, size = [self.held[self.at:]], len(self.held) - self.at
            while size < n and (more := next(self.chunks, None)) is not None:
                parts.append(more)
                size += len(more)
            self.held, self.at = b"".join(parts), 0
        return self.held[self.at: self.at + n]

    def read(self, n: int) -> bytes:
        out = self.peek(1) and self.held[self.at: self.at + n]
        self.at += len(out)
        if self.log is not None:
            self.log.append(out)
        return out

    def unread(self, data: bytes) -> None:
        if self.log is not None:
            whole = b"".join(self.log)
            self.log = [whole[: len(whole) - len(data)]]
        self.held, self.at = data + self.held[self.at:], 0


def _codec(head: bytes) -> str | None:
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return "zlib"
    return "bz2" if head[:3] == b"BZh" else "xz" if head[:6] == b"\xfd7zXZ\x00" else "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _stream(source: Source, codec: str) -> Iterator[bytes]:
    if codec == "zstd":
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompressobj()
        while not unpack.eof and (data := source.read(ZSTD_CHUNK)):
            yield unpack.decompress(data)
    else:
        unpack = zlib.decompressobj(47) if codec == "zlib" else bz2.BZ2Decompressor() if codec == "bz2" else lzma.LZMADecompressor()
        data = source.read(CHUNK)
        while not unpack.eof:
            out = unpack.decompress(data, CHUNK)
            yield out
            data = unpack.unconsumed_tail if codec == "zlib" else b""
            if not unpack.eof and not data and (len(out) < CHUNK if codec == "zlib" else unpack.needs_input) and not (data := source.read(CHUNK)):
                return
    source.unread(unpack.unused_data)


def _member(source: Source, codec: str) -> Iterator[bytes]:
    """What one compressed stream holds, in chunks.  An error ends it; if it gave nothing it is put back.  Returns whether it was one."""
    own = source.log is None
    if own:
        source.log = []
    some = False
    try:
        for out in _stream(source, codec):
            if out:
                some = True
                if own:
                    source.log = None
                yield out
    except Refused:
        raise
    except Exception:  # noqa: BLE001 - each library has its own errors for data that only look compressed
        if own and not some:
            log, source.log = b"".join(source.log), None
            source.unread(log)
        return some
    if own:
        source.log = None
    return True


def _members(source: Source, one: bool) -> Iterator[bytes]:
    """What the streams at the source hold, one after the other, then what follows them."""
    first = True
    while codec := _codec(source.peek(6)):
        if not (yield from _member(source, codec)):
            if first:
                return
            break
        if one:
            return
        first = False
        while source.peek(1) == b"\0":  # padding
            source.unread(source.read(CHUNK).lstrip(b"\0"))
    if source.peek(1):
        yield b"\0"
        while out := source.read(CHUNK):
            yield out


def _counted(chunks: Iterator[bytes], limit: int | None) -> Iterator[bytes]:
    n = 0
    for c in chunks:
        n += len(c)
        if limit is not None and n > limit:
            raise Refused
        if c:
            yield c


def _cuts(source: Source, size: int) -> Iterator[bytes | None]:
    """The source in pieces of about ``size`` bytes, cut where no encoded run is, each with the end of the one before.

    None for a run that is longer than a piece, and so is cut.
    """
    held = b""
    while True:
        n = max(size - len(held), OVERLAP)
        source.peek(n)
        piece = held + source.read(n)
        if not source.peek(1):
            if piece:
                yield piece
            return
        cut, window = 0, min(size, CHUNK)
        while not cut:
            for m in BREAK.finditer(piece, max(len(held), len(piece) - window)):
                cut = m.end()
            if window >= len(piece):
                break
            window *= 2
        if not cut:
            yield None
            cut = len(piece)
        yield piece[:cut]
        held = SPACES.sub(b" ", piece[:cut])[-OVERLAP:] + piece[cut:]


def unpacked(source: Source, limit: int | None, size: int, heads: frozenset = frozenset(), inside: bool = False) -> Iterator[bytes | None]:
    """The data at the source, decompressed until no compressed stream is left, in pieces; None for a run cut between two.

    ``inside``: the source begins at a signature inside other data; if it is no stream, nothing.
    """
    head = source.peek(CHUNK)
    key = hashlib.sha256(head).digest()
    if _codec(head) and key not in heads:  # a stream that holds itself is a cycle
        source.log = []
        inner = Source(_counted(_members(source, inside), limit))
        if inner.peek(1):
            source.log = None
            yield from unpacked(inner, limit, size, heads | {key})
            return
        log, source.log = b"".join(source.log), None
        source.unread(log)
    if inside:
        return
    for piece in _cuts(source, size):
        yield piece
        if piece is not None:
            for m in SIGNATURE.finditer(piece):
                if m.start():
                    yield from unpacked(Source([piece[m.start():]]), limit, size, heads | {key}, True)


class Places:
    """As ``Origin``, for the characters of base64 text in some runs of the text above."""

    def __init__(self, runs: list[tuple[int, int]], at):
        self.runs, self.at = runs, at
        self.firsts = [0, *accumulate(b - a for a, b in runs)]

    def _place(self, i: int) -> int:
        k = min(bisect_right(self.firsts, i), len(self.runs)) - 1
        return self.runs[k][0] + i - self.firsts[k]

    def of(self, i: int) -> tuple[int, int]:
        return self._place(8 * self.at[i] // 6), self._place(-(-8 * self.at[i + 1] // 6) - 1) + 1


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of base64: each word, and words on consecutive lines as one.

    Lines of one length with a shorter one at the end belong together; so may a line before them, which
    something else may begin (a key, a quote, the words of a header).
    """
    for m in BASE64.finditer(text):
        yield [m.span()]
    if "\n" not in text:
        return
    for m in WRAPPED.finditer(text):
        blocks: list[list[tuple[int, int]]] = []
        width, open_ = 0, False
        for line in LINE.finditer(text, *m.span()):
            n = line.end() - line.start()
            if open_ and n <= width:
                blocks[-1].append(line.span())
            else:
                blocks.append([line.span()])
                width, open_ = n, True
            open_ = open_ and n == width and text[line.end() - 1] != "="
        for k, block in enumerate(blocks):
            if len(block) > 1:
                yield block
            if k and len(blocks[k - 1]) == 1:
                yield blocks[k - 1] + block
        if len(blocks) > 2:
            yield sum(blocks, [])


def _base64(text: str, runs: list[tuple[int, int]], limit: int | None, size: int) -> Iterator[tuple[str, Origin | Places] | None]:
    """The layers in some runs of base64 that are read as one."""
    bare = "".join(text[a:b] for a, b in runs).rstrip("=")
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]
    if len(bare) < 16:
        return
    try:
        data = base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4))
    except (binascii.Error, ValueError):
        return
    whole = Origin([(0, runs[0][0], 0, runs[-1][1] - runs[0][0])])
    pieces = unpacked(Source([data]), limit, max(size, len(data) + 1))
    for piece in pieces if limit is None else list(pieces):
        found = piece and _text(piece)
        if piece is None:
            yield None
        elif found:
            yield found[0], Places(runs, found[1]) if piece == data else whole


def encoded(text: str, limit: int | None = None, size: int = MAX_LAYER) -> Iterator[tuple[str, Origin | Places] | None]:
    """The layers directly inside a text; None for one that was refused.  Escapes are replaced over the whole text and
    come last: nothing is left to do in a text when its last layer is entered."""
    for runs in _runs(text):
        try:
            yield from _base64(text, runs, limit, size)
        except Refused:
            yield None
    for signs, escapes, decode in (("\\", "&#"), CHAR_ESCAPES, _characters), (("%",), URL_ESCAPES, _url):
        if any(sign in text for sign in signs) and (found := _replaced(text, escapes, decode)):
            yield found


def _with_last(items: Iterator) -> Iterator[tuple]:
    """(item, whether it is the last one)."""
    held = next(items, False)
    while held is not False:
        following = next(items, False)
        yield held, following is False
        held = following


def scan(text: str, limit: int | None = None, size: int = MAX_LAYER) -> tuple[list, list, int, int]:
    """Base spans, all spans (start, kind, end), layers unwrapped and layers refused.

    Layers are entered depth first.  A layer whose last inner layer is entered is let go, so a chain of escapes holds one
    text; ``path`` has the digests of the layers around the current one, for cycles.
    """
    base = base_scan(text)
    spans, layers, refused, seen = set(base), 0, 0, set()
    own = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    path, work = {own}, [(Layer(text), own, _with_last(encoded(text, limit, size)))]
    while work:
        layer, digest, inside = work[-1]
        found, last = next(inside, (False, True)) if inside is not None else (False, True)
        if last:
            work[-1] = (None, digest, None)  # the layer goes, its digest stays until those inside it are done
        if found is False:
            path.discard(digest)
            work.pop()
            continue
        if found is None:
            refused += 1
            continue
        inner, origin = found
        digest = hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest()
        new = layer.inside(inner, origin)
        place = (digest, *new.span(0, len(inner)))
        if digest in path or place in seen:
            continue
        seen.add(place)
        path.add(digest)
        layers += 1
        for a, kind, b in base_scan(inner):
            a, b = new.span(a, b)
            spans.add((a, kind, b))
        work.append((new, digest, _with_last(encoded(inner, limit, size))))
    return base, sorted(spans), layers, refused


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """Base counts, base digest and all spans of every row; spans are code points of the original text, end exclusive."""
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans, layers, refused = scan(text.as_py() or "", limit)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers, refused))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {OUT}")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
