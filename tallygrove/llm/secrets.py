"""Secret scans with a recursive decoding worklist.

Every text is scanned for three kinds of secret. Encoded parts (percent escapes, Unicode escapes, base64, and compressed
bytes inside base64 or written as escapes, raw deflate included) are unwrapped into layers; each layer is scanned and unwrapped
again until no new layer appears. Escapes are undone step by step for ``STEPS`` steps, and to their fixpoint in one pass, so
escapes of escapes take time in proportion to the text, however deep.
A layer remembers for each of its characters which characters of the original text it came from, so every find is
reported as a span of the original; a layer already seen (same text from the same place) ends a cycle.

Each document is handled alone in one pass without a shuffle. Slices of a few MB are first searched in numpy for runs
and markers, so that most texts never reach the regular expressions.

Defined cases: a missing text is empty; an empty text has no span; repeated documents get equal rows; spans count code
points, end exclusive; an escape that isn't valid stays as written; base64 is read by line and over line breaks (lines of fewer
than 16 characters where they are whole lines of 4 and more); bytes that
are no UTF-8 are read as Latin-1, and with null bytes also as UTF-16; every member of compressed data is read, in overlapping
pieces of ``MAX_LAYER`` bytes; what lies beyond ``MAX_READ`` bytes of one layer, or a run of base64 too long for a piece's
overlap, is counted in ``n_unread``, and ``redact`` replaces the part of the text that it stands for; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import text_slices

KINDS = ("assign", "access", "hex")
MAX_LAYER, OVERLAP, MAX_READ, MOST_LEVELS, STEPS = 1 << 24, 1 << 16, 1 << 30, 64, 3
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"\\u\{?([0-9A-Fa-f]+)\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: The same over line breaks, plain or written as \\n, with indents and marks of quotation.
_BREAK = r"[\x20\t>]*(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*"
_LINES = tuple(re.compile(rf"{c}{{16,}}+(?:{_BREAK}{c}++(?=={{0,2}}[\"'`,;)\]}}<]*[\x20\t]*(?:[\r\n\\]|\Z)))+={{0,2}}") for c in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]"))
_BREAKS = re.compile(_BREAK)
_SHORT_LINES = re.compile(rf"(?:\A|(?<=\n))[\x20\t>]*[\"'`]?([A-Za-z0-9+/_-]{{4,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++(?=={{0,2}}[\"'`,;)\]}}<]*[\x20\t]*(?:[\r\n\\]|\Z)))+={{0,2}})")
_SHORT_BYTES = re.compile(rb"(?:\A|\n)[\x20\t>]*[\"'`]?[A-Za-z0-9+/_-]{4,}+[\x20\t>]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]++={0,2}[\"'`,;)\]}<]*[\x20\t]*(?:\r?\n|\Z)")
#: One escape at the end of what has been read, and the beginnings of compressed data written in percent or backslash escapes.
_LAST_ESCAPE = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8}))\Z")
_LONGEST = 10  # characters of an escape
#: How gzip, zlib, bzip2, xz and zstd data begin.
_MAGIC = (b"\x1f\x8b", b"x\x01", b"x^", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00", b"(\xb5/\xfd")


def _begins(*escapes: str) -> str:
    """A pattern for these beginnings with each byte as itself or escaped; the second of two is escaped."""
    own = lambda b: [re.escape(chr(b))] if 32 < b < 127 else []
    escaped = lambda b: "(?i:" + "|".join(e.format(b) for e in (*escapes, *([r"\\0"] if b == 0 and "x" in escapes[0] else []))) + ")"
    either = lambda b: "(?:" + "|".join([*own(b), escaped(b)]) + ")"
    return "|".join("".join(map(either, m)) if len(m) > 2 else either(m[0]) + escaped(m[1]) for m in _MAGIC)


_PERCENT_DATA = re.compile(f"(?:{_begins('%{:02x}')})[!#-&(-~]*")
_ESCAPED_DATA = re.compile(rf"(?:{_begins(chr(92) * 2 + 'x{:02x}', chr(92) * 2 + 'u00{:02x}')})(?:\\.|[\x20-\[\]-~])*", re.ASCII)
_ONE_BYTE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u00([0-9A-Fa-f]{2})|(.))", re.DOTALL)
#: The letters of one-byte escapes.
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
#: Without any of these a layer holds no secret and no further layer.
_WORTH = re.compile(r"(?ai:passw|secret|token|api)|AKIA|[A-Za-z0-9+/_-]{16}|\\[uUx]|%[0-9A-Fa-f]{2}")

_IS_HEX, _IS_BASE64, _IN_LINES = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_BASE64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_IN_LINES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n\\ \t>")] = True
_NO_SPANS = hashlib.sha256(b"").hexdigest()


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret written plainly."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, for each character, the span of the original text it stands for."""

    def __init__(self, text: str, lo=None, hi=None, steps: int = 0) -> None:
        self.steps = steps  # of escapes undone since the text was last written otherwise
        self.text, self.lo, self.hi = text, lo, hi  # None: the original; numbers: all from one place; arrays: by character

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return int(self.lo[start]), int(self.hi[end - 1])

    def key(self) -> tuple:
        place = (self.lo, self.hi) if self.lo is None or isinstance(self.lo, int) else (self.lo.tobytes(), self.hi.tobytes())
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), hashlib.sha256(repr(place).encode() if not isinstance(place[0], bytes) else place[0] + place[1]).digest()

    def rewritten(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with every match replaced by what decode makes of it: pairs (character, characters used), or None to keep it."""
        parts, lo, hi, at, changed = [], [], [], 0, False
        n = len(self.text)
        own_lo = np.arange(n) if self.lo is None else self.lo
        own_hi = np.arange(1, n + 1) if self.lo is None else self.hi
        flat = isinstance(own_lo, int)
        for m in pattern.finditer(self.text):
            pairs = decode(m.group())
            if not pairs:
                continue
            changed = True
            parts.append(self.text[at : m.start()])
            parts.append("".join(c for c, _ in pairs))
            if not flat:
                used = np.cumsum([0, *(k for _, k in pairs)]) + m.start()
                lo += [own_lo[at : m.start()], own_lo[used[:-1]]]
                hi += [own_hi[at : m.start()], own_hi[used[1:] - 1]]
            at = m.end()
        if not changed:
            return None
        text = "".join([*parts, self.text[at:]])
        return Layer(text, own_lo, own_hi, self.steps + 1) if flat else Layer(text, np.concatenate([*lo, own_lo[at:]]), np.concatenate([*hi, own_hi[at:]]), self.steps + 1)

    def resolved(self) -> Layer:
        """The layer with its escapes undone until none is left, in one pass: what an escape stands for may end or begin another."""
        n, s = len(self.text), self.text
        chars: list[str] = []  # what has been read, with the first and last place that each character stands for
        first: list[int] = []
        last: list[int] = []
        at = 0
        while at < n:
            if not any(c in "%\\" for c in chars[-_LONGEST:]):  # nothing is open: on to the next mark
                marks = [p for p in (s.find("%", at), s.find("\\", at)) if p >= 0]
                to = min(marks, default=n)
                chars += s[at:to]
                first += range(at, to)
                last += range(at, to)
                at = to
                if at == n:
                    break
            chars.append(s[at])
            first.append(at)
            last.append(at)
            at += 1
            while chars[-1] in "0123456789abcdefABCDEF}" and (m := _LAST_ESCAPE.search("".join(chars[-_LONGEST:]))):
                value, size = int(next(filter(None, m.groups())), 16), m.end() - m.start()
                if value > 0x10FFFF:
                    break
                begin, end = first[-size], last[-1]
                del chars[-size:], first[-size:], last[-size:]
                chars.append("\ufffd" if 0xD800 <= value < 0xE000 else chr(value))
                first.append(begin)
                last.append(end)
        lo, hi = (self.lo, self.hi) if isinstance(self.lo, int) else (np.array(first, np.int64), np.array(last, np.int64) + 1) if self.lo is None else (self.lo[first], self.hi[last])
        return Layer("".join(chars), lo, hi, STEPS)


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in raw.decode()]
    except UnicodeDecodeError:
        return [(chr(b), 3) for b in raw]


def _escapes(run: str) -> list[tuple[str, int]] | None:
    out: list[tuple[str, int]] = []
    for m in _ONE_ESCAPE.finditer(run):
        value, size = int(m[1] or m[2] or m[3], 16), m.end() - m.start()
        if value > 0x10FFFF:
            return None
        if out and 0xDC00 <= value < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, used = out.pop()
            value, size = 0x10000 + ((ord(high) - 0xD800) << 10) + value - 0xDC00, used + size
        out.append((chr(value), size))
    return [("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c, k) for c, k in out]


class _Inflated(io.RawIOBase):
    """The bytes of gzip or zlib data, over all its members."""

    def __init__(self, source) -> None:
        self.source, self.inflater, self.rest = source, zlib.decompressobj(47), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.inflater.eof:
                self.rest, self.inflater = self.inflater.unused_data, zlib.decompressobj(47)
            data = self.rest or self.source.read1(1 << 16)
            out = self.inflater.decompress(data, len(into))
            self.rest = self.inflater.unconsumed_tail
            if out or not data:
                into[: len(out)] = out
                return len(out)


class _Raw(_Inflated):
    """The bytes of deflated data without a header."""

    def __init__(self, source) -> None:
        self.source, self.inflater, self.rest = source, zlib.decompressobj(-15), b""

    def readinto(self, into) -> int:
        while not self.inflater.eof:
            data = self.rest or self.source.read1(1 << 16)
            out = self.inflater.decompress(data, len(into))
            self.rest = self.inflater.unconsumed_tail
            if out or not data:
                into[: len(out)] = out
                return len(out)
        return 0


def _is_raw(data: bytes) -> bool:
    """Whether bytes that begin nothing known inflate without a header: up to an end near theirs, or for 4096 bytes."""
    inflater = zlib.decompressobj(-15)
    try:
        out = inflater.decompress(data[: 1 << 16], 4096)
    except zlib.error:
        return False
    return len(out) >= 8 and (len(out) == 4096 or inflater.eof and len(inflater.unused_data) <= 8)


def _opener(head: bytes):
    """What opens a stream that begins with these bytes, or None if it isn't compressed."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return _Inflated
    if head[:3] == b"BZh":
        return bz2.BZ2File
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMAFile
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return lambda f: io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True), 1 << 16)
    return None


def _carried(data: bytes) -> tuple[bytes, bool]:
    """The end of a piece that the next one begins with: a base64 run that may go on, or else ``OVERLAP``; whether a run was too long."""
    tail = np.frombuffer(data, np.uint8)[-(MAX_LAYER // 2) :]
    word = _IS_BASE64[tail]
    gap = ~word  # a space or mark between two words is no indent
    gap[1:-1] &= word[:-2] & word[2:]
    gap[[0, -1]] = False
    stops = np.flatnonzero(~_IN_LINES[tail] | gap & ((tail == 32) | (tail == 9) | (tail == 62)))
    size = len(tail) - 1 - int(stops[-1]) if len(stops) else len(tail)
    return data[-(max(size, OVERLAP) if len(stops) else OVERLAP) :], not len(stops)


def _unpacked(data: bytes) -> Iterator[bytes | None]:
    """The data and what they hold when decompressed, as often as they are compressed; None for what is left unread."""
    yield data
    chain, head = [], data[:6]
    for _ in range(MOST_LEVELS):
        opener = _opener(head) or (_Raw if not chain and len(data) >= 8 and _is_raw(data) else None)
        if opener is None:
            return
        chain.append(opener)
        stream = io.BytesIO(data)
        for k in chain:
            stream = io.BufferedReader(k(stream), 1 << 16)
        head, piece, new, total, pieces = b"", bytearray(), 0, 0, 0
        while total <= MAX_READ:
            try:
                read = stream.read1(1 << 16)
            except Exception:
                break  # damaged, or only looked like compressed data
            if not read:
                break
            piece += read
            new, total = new + len(read), total + len(read)
            if len(piece) >= MAX_LAYER:
                head, pieces = head or bytes(piece[:6]), pieces + 1
                yield bytes(piece)
                carried, long = _carried(bytes(piece))
                if long:
                    yield None
                piece, new = bytearray(carried), 0
        else:
            yield None
        if new:
            yield bytes(piece)
        if not pieces:  # all at hand: the next level begins here
            data, chain, head = bytes(piece), [], bytes(piece[:6])
    if _opener(head):
        yield None


def _readings(data: bytes) -> Iterator[str]:
    """The bytes as text: UTF-8, or else Latin-1; with null bytes also UTF-16 in either order from either of the first bytes."""
    try:
        yield data.decode()
    except UnicodeDecodeError:
        yield data.decode("latin-1")
    if b"\0" in data:
        for order in ("utf-16-le", "utf-16-be"):
            for first in (0, 1):
                yield data[first:].decode(order, "replace")


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and characters of base64 runs: by line, over lines of one length and a shorter last one, and over all lines."""
    seen = set()
    for pattern, lines in zip(_BASE64, _LINES, strict=True):
        for m in pattern.finditer(text):
            if m.span() not in seen:
                seen.add(m.span())
                yield *m.span(), m.group()
        for m in lines.finditer(text) if "\n" in text or "\\n" in text else ():
            cuts = [(b.start() + m.start(), b.end() + m.start()) for b in _BREAKS.finditer(m.group())]
            parts = list(zip([m.start(), *[e for _, e in cuts]], [*[b for b, _ in cuts], m.end()], strict=True))
            groups, at = [(0, len(parts))], 0
            while at < len(parts):
                size, end = parts[at][1] - parts[at][0], at + 1
                while end < len(parts) and parts[end][1] - parts[end][0] == size:
                    end += 1
                last = end < len(parts) and parts[end][1] - parts[end][0] < size
                groups.append((at, end + last))
                at = end
            for a, b in groups:
                span = parts[a][0], parts[b - 1][1]
                if b - a > 1 and span not in seen:
                    seen.add(span)
                    yield *span, "".join(text[x:y] for x, y in parts[a:b])


def _short_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 over whole lines of fewer than 16 characters."""
    for m in _SHORT_LINES.finditer(text) if "\n" in text or "\\n" in text else ():
        joined_ = _BREAKS.sub("", m[1])
        if len(joined_) >= 16 and not all(len(x) >= 16 for x in _BREAKS.split(m[1])[:-1]):
            yield m.start(1), m.end(1), joined_


def _written(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and bytes of compressed data that stand in percent or backslash escapes."""
    if "%" in text:
        for m in _PERCENT_DATA.finditer(text):
            yield *m.span(), unquote_to_bytes(m.group())
    if "\\x" in text or "\\u" in text:
        for m in _ESCAPED_DATA.finditer(text):
            byte = lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else _LETTERS.get(e[3], e[3])
            quote = text[m.start() - 1 : m.start()]  # what is quoted ends with the same mark, else with either
            part = re.match(rf"(?:\\.|[^\\{quote if quote in ('"', "'") else '"' + "'"}])*", m.group(), re.DOTALL).group()
            yield m.start(), m.start() + len(part), _ONE_BYTE.sub(byte, part).encode("latin-1", "replace")


def _blobs(text: str) -> Iterator[tuple[int, int, str | None]]:
    """Start, end and decoded text of base64 runs; None as text for what was left unread."""
    for start, end, data in _written(text):
        for nth, piece in enumerate(_unpacked(data)):
            if piece is None:
                yield start, end, None
            elif nth:  # the escapes themselves are read elsewhere
                yield from ((start, end, inside) for inside in _readings(piece) if _WORTH.search(inside))
    for start, end, run in itertools.chain(_runs(text), _short_runs(text)):
        run = run.rstrip("=")
        if len(run) % 4 == 1:
            run = run[:-1]
        data = base64.b64decode(run + "=" * (-len(run) % 4), altchars=b"-_" if "-" in run or "_" in run else None)
        for piece in _unpacked(data):
            if piece is None:
                yield start, end, None
            else:
                for inside in _readings(piece):
                    if _WORTH.search(inside):
                        yield start, end, inside


def unwrap(text: str) -> tuple[list[tuple[int, int, int]], int]:
    """Spans (start, kind number, end) in the original of secrets in all layers below the text, and how many layers were not read to their end."""
    found, unread = unwrapped(text)
    return found, len(unread)


def unwrapped(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The same with the spans of what was not read to its end."""
    found, unread, seen = set(), [], set()

    def below(layer: Layer) -> Iterator[Layer]:
        escaped = [layer.rewritten(p, f) if mark in layer.text and layer.steps < STEPS else None for mark, p, f in (("%", _PERCENT, _percent), ("\\", _ESCAPE, _escapes))]
        yield from filter(None, escaped)
        if not layer.steps and any(escaped):
            yield layer.resolved()
        for start, end, inside in _blobs(layer.text):
            if inside is None:
                unread.append(layer.span(start, end))
            else:
                yield Layer(inside, *layer.span(start, end))

    work = [iter([Layer(text)])]  # depth first, so that few layers are held
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        if layer.lo is not None:
            for start, kind, end in scan(layer.text):
                lo, hi = layer.span(start, end)
                found.add((lo, kind, hi))
        work.append(below(layer))
    return sorted(found), unread


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _long_runs(member: np.ndarray, data: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """Which rows hold a run of at least so many bytes of the class."""
    stops = np.flatnonzero(~member[data])
    edges = np.sort(np.concatenate([stops, offs[1:] - 0.5, [-1.0]])) if len(stops) else np.concatenate([[-1.0], offs[1:] - 0.5])
    # between two edges lie only bytes of the class; row ends are edges half a byte before the next row
    size = np.ceil(edges[1:]) - np.floor(edges[:-1]) - 1
    rows = np.zeros(len(offs) - 1, bool)
    rows[np.searchsorted(offs, np.floor(edges[:-1][size >= least] + 1), side="right") - 1] = True
    return rows


def flagged(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may hold a plain secret, and rows that may hold an encoded part."""
    plain = _long_runs(_IS_HEX, data, offs, 16)
    coded = _long_runs(_IS_BASE64, data, offs, 16)
    whole = data.tobytes()
    low = whole.lower()
    for m in _SHORT_BYTES.finditer(whole):
        coded[int(np.searchsorted(offs, min(m.start() + 1, len(data) - 1), side="right")) - 1] = True
        coded[int(np.searchsorted(offs, m.start(), side="right")) - 1] = True
    for words, rows, text in (((b"passw", b"secret", b"token", b"api"), plain, low), ((b"AKIA",), plain, whole), ((b"\\u", b"\\U", b"\\x", b"%"), coded, whole)):
        for w in words:
            at = text.find(w)
            while at >= 0:
                row = int(np.searchsorted(offs, at, side="right")) - 1
                rows[row] = True
                at = text.find(w, int(offs[row + 1]))
    return plain, coded


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (plain finds), base_sha256, spans (plain and decoded), n_decoded, n_unread."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = dict(d.dtypes)["doc_id"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n = batch.num_rows
            counts, digests, spans, decoded, unread = np.zeros((3, n), np.int64), [_NO_SPANS] * n, [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi, offs, data in text_slices(texts):
                plain, coded = flagged(data, offs)
                for i in np.flatnonzero(plain | coded):
                    t, at = texts[lo + int(i)].as_py() or "", lo + int(i)
                    base = scan(t) if plain[i] else []
                    more, unread[at] = unwrap(t) if coded[i] else ([], 0)
                    for _, k, _ in base:
                        counts[k, at] += 1
                    if base:
                        digests[at] = hashlib.sha256(joined(base).encode()).hexdigest()
                    everything = sorted({*base, *more})
                    decoded[at] = len(everything) - len(base)
                    spans[at] = joined(everything)
            yield pa.record_batch([batch.column(0), *[pa.array(c) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(decoded), pa.array(unread)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_unread"])

    return d.mapInArrow(look, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_unread long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[redacted]") -> DataFrame:
    """docs with every span, plain or decoded, replaced by the mark; overlapping spans by one mark. A missing text stays missing."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = column.astype(object).copy()
            for lo, hi, offs, data in text_slices(pa.array(column, pa.large_string())):
                plain, coded = flagged(data, offs)
                for i in np.flatnonzero(plain | coded):
                    t = column.iloc[lo + int(i)]
                    more, unread = unwrapped(t) if coded[i] else ([], [])
                    spans = sorted({*(scan(t) if plain[i] else []), *more, *((a, 0, b) for a, b in unread)})  # what is unread is held back
                    parts, at, end = [], 0, -1
                    for s, _, e in spans:
                        if s >= end:
                            parts += [t[at:s], mark] if s >= at else [mark]
                            end = e
                        else:
                            end = max(end, e)
                        at = end
                    if spans:
                        out.iloc[lo + int(i)] = "".join([*parts, t[at:]])
            yield out

    return docs.withColumn(text, F.pandas_udf(clean, "string")(F.col(f"`{text}`")))
