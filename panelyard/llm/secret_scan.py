"""Secret scans through nested encodings.

A worklist starts with the text itself. Each layer is scanned for secrets; its escapes (URL, Unicode and numeric
character references), its base64 runs and compressed bytes give further layers, until no layer is new. A layer knows,
for each of its characters, the stretch of the text that it comes from, so a secret found at any depth is a span of
the text. A layer that has the content and the stretch of one before it is not opened again: that ends cycles, such as
an archive that unpacks to itself.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm._common import slices

#: kind -> (pattern, group that is measured, least characters of it); kinds in the order in which equal starts are listed.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
_ORDER = {kind: i for i, kind in enumerate(KINDS)}
_ASSIGN, _ACCESS = (re.compile(KINDS[k][0], re.ASCII) for k in ("assign", "access"))
#: A run that is long enough is found from its first digit on; shorter ones would be dropped.
_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
_ASSIGNED = re.compile("[:=]")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Escaped bytes that begin like gzip, zlib, zstd, xz or bzip2; characters that URLs leave as they are stand between.
_URL_PACKED = re.compile(r"(?:%1[Ff]%8[Bb]|x%[0-9A-Fa-f]{2}|%28%[Bb]5%2[Ff]%[Ff][Dd]|\(%[Bb]5/%[Ff][Dd]|%[Ff][Dd]7zXZ%00|BZh[1-9])(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~!*'()/-])+")
_URL_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|.", re.S)
_UNICODE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4}|%u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
_UNIT = re.compile(r"[\\%]u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: Base64, also in lines of 60 to 76 characters as mail and key files have it.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+|[A-Za-z0-9+/_-]{16,})={0,2}")
_PART = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
#: Bytes of base64 and of all other runs as one letter, the rest as blanks: a long run is then found by its letters.
_RUNS = bytes(97 if chr(i) in "+/_-" or (i < 128 and chr(i).isalnum()) else 32 for i in range(256))
_BLANKS = re.compile(r"[\r\n]")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]")
_PLAIN = bytes(i for i in range(256) if i in b"\t\n\x0b\x0c\r\x1b" or (i >= 32 and i != 127))

#: Bytes to which one compressed layer may grow; a larger one is counted in ``n_unopened`` and not read.
MOST_BYTES = 64 << 20


class Layer:
    """Text or bytes, and the stretch of the document that each character or byte comes from.

    That is one of: a piece of the document from ``at`` on, arrays of first and last (exclusive) places, or for
    unpacked bytes one stretch for all of them.
    """

    def __init__(self, content: str | bytes, at: int | None = None, places: tuple[np.ndarray, np.ndarray] | None = None, whole: tuple[int, int] | None = None):
        self.content, self.at, self.places, self.whole = content, at, places, whole

    def span(self, start: int, stop: int) -> tuple[int, int]:
        """The stretch of characters start to stop - 1."""
        if self.whole:
            return self.whole
        if self.places:
            return int(self.places[0][start]), int(self.places[1][stop - 1])
        return self.at + start, self.at + stop

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self.places:
            return self.places
        first = np.arange(self.at, self.at + len(self.content), dtype=np.int64)
        return first, first + 1

    def child(self, content: str | bytes, starts, stops) -> Layer:
        """A layer whose character i comes from this one's starts[i] to stops[i] - 1."""
        if self.whole:
            return Layer(content, whole=self.whole)
        starts, last = np.asarray(starts, np.int64), np.asarray(stops, np.int64) - 1
        if self.places:
            return Layer(content, places=(self.places[0][starts], self.places[1][last]))
        return Layer(content, places=(starts + self.at, last + (self.at + 1)))

    def replaced(self, found: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """This text with each (start, stop, [(character, its start, its stop), ...]) put in the place of its characters."""
        text, parts, at = self.content, [], 0
        for start, stop, chars in found:
            parts += [text[at:start], "".join([c for c, _, _ in chars])]
            at = stop
        content = "".join([*parts, text[at:]])
        if self.whole:
            return Layer(content, whole=self.whole)
        first, last = self.bounds()
        firsts, lasts, at = [], [], 0
        for start, stop, chars in found:
            firsts += [first[at:start], first[[a for _, a, _ in chars]]]
            lasts += [last[at:start], last[[b - 1 for _, _, b in chars]]]
            at = stop
        return Layer(content, places=(np.concatenate([*firsts, first[at:]]), np.concatenate([*lasts, last[at:]])))

    def key(self) -> tuple[bytes, int, int]:
        """Content and stretch: two layers that share both have the same secrets and the same children."""
        is_text = isinstance(self.content, str)
        data = self.content.encode("utf-8", "surrogatepass") if is_text else self.content
        return hashlib.blake2b(data, digest_size=16, key=b"text" if is_text else b"bytes").digest(), *self.span(0, len(self.content))


def _has_run(text: str) -> bool:
    """Whether 16 letters, digits or signs of base64 stand in a row: hexadecimal digits and base64 need that."""
    return b"a" * 16 in text.encode("utf-8", "surrogatepass").translate(_RUNS)


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that are plain in text, leftmost and without overlap in a kind."""
    if _ASSIGNED.search(text):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= KINDS["assign"][2]:
                yield "assign", *m.span()
    if not _has_run(text):
        return
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= KINDS["access"][2]:
                yield "access", *m.span()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()


def _decoded(data: bytes) -> list[tuple[str, int, int]] | None:
    """The characters of UTF-8 bytes with the bytes that each takes; None if they are not UTF-8."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    ends = np.cumsum([len(c.encode()) for c in text]).tolist()
    return [(c, b - len(c.encode()), b) for c, b in zip(text, ends, strict=True)]


def _url(layer: Layer) -> Iterator[Layer]:
    """One level of percent escapes; escaped bytes that may be compressed are layers of their own."""
    found = []
    for m in _URL.finditer(layer.content):
        at, data = m.start(), bytes.fromhex(m.group().replace("%", ""))
        chars = _decoded(data)
        if chars is None:
            chars = [(chr(b) if b < 128 else "\ufffd", i, i + 1) for i, b in enumerate(data)]
        found.append((at, m.end(), [(c, at + 3 * a, at + 3 * b) for c, a, b in chars]))
    if found:
        yield layer.replaced(found)
        for m in _URL_PACKED.finditer(layer.content):
            units = [(u.group(), m.start() + u.start(), m.start() + u.end()) for u in _URL_UNIT.finditer(m.group())]
            data = bytes(int(u[1:], 16) if len(u) == 3 else ord(u) for u, _, _ in units)
            if _packed(data):
                yield layer.child(data, [a for _, a, _ in units], [b for _, _, b in units])


def _unicode(layer: Layer) -> Iterator[Layer]:
    """One level of Unicode escapes and numeric character references; surrogate pairs become one character."""
    found = []
    for m in _UNICODE.finditer(layer.content):
        s = m.group()
        if s[:3] == "\\u{" or s[:2] in ("\\U", "&#"):
            digits = s[3:-1] if s[:3] == "\\u{" or s[:3].lower() == "&#x" else s[2:].rstrip(";")
            code = int(digits, 10 if s[:2] == "&#" and s[2] not in "xX" else 16)
            if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
                continue
            found.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
            continue
        chars: list[tuple[str, int, int]] = []
        codes = [(int(u.group()[2:], 16), m.start() + u.start(), m.start() + u.end(), u.group()[1] == "x") for u in _UNIT.finditer(s)]
        data = bytes(c for c, *_ in codes) if all(x for *_, x in codes) else b""
        if (utf8 := _decoded(data) if max(data, default=0) > 127 else None) is not None:
            chars = [(c, codes[a][1], codes[b - 1][2]) for c, a, b in utf8]
        else:
            if max(data, default=0) > 127:
                yield layer.child(data, [a for _, a, *_ in codes], [b for _, _, b, _ in codes])
            k = 0
            while k < len(codes):
                code, a, b, _ = codes[k]
                if 0xD800 <= code < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1][0] < 0xE000:
                    code, b, k = 0x10000 + ((code - 0xD800) << 10) + codes[k + 1][0] - 0xDC00, codes[k + 1][2], k + 1
                chars.append(("\ufffd" if 0xD800 <= code < 0xE000 else chr(code), a, b))
                k += 1
        found.append((m.start(), m.end(), chars))
    if found:
        yield layer.replaced(found)


def _base64_bytes(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, with or without padding; None if they are neither text nor compressed."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        if not _promising(binascii.a2b_base64(body[:16])):  # most runs are words: their first bytes tell
            return None
        data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None
    return data if _packed(data) or _text(data) else None


def _promising(head: bytes) -> bool:
    """Whether bytes can begin a text or a compressed layer."""
    return _packed(head) or 4 * head.count(0) >= len(head) or not head.translate(None, _PLAIN)


def _base64(layer: Layer) -> Iterator[Layer]:
    """The bytes of each run and, where they are nothing, of its parts: a run may hold a path or end in another word."""
    if not _has_run(layer.content):
        return
    for m in _BASE64.finditer(layer.content):
        run, at = m.group(), m.start()
        tries = [(0, len(run))]
        if "\n" in run:
            tries.append((0, run.rstrip("\r\n").rindex("\n")))
        found = [(data, a, b) for a, b in tries if (data := _base64_bytes(_BLANKS.sub("", run[a:b]))) is not None]
        if not found:
            parts = [p.span() for p in _PART.finditer(run) if len(p.group()) < len(run)]
            found = [(data, a, b) for a, b in parts if (data := _base64_bytes(run[a:b])) is not None]
        for data, a, b in found:
            where = np.array([at + i for i in range(a, b) if run[i] not in "\r\n="], np.int64)
            bits = np.arange(len(data), dtype=np.int64) * 8
            yield layer.child(data, where[bits // 6], where[(bits + 7) // 6] + 1)


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00" or data[:4] == b"\x28\xb5\x2f\xfd" or (len(data) > 1 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0)


def _unpacked(data: bytes, most: int) -> bytes | None:
    """The bytes of a gzip, zlib, bzip2, xz or zstd stream, also of one that is cut off; None if it is none of them.

    Raises OverflowError if they are more than most.
    """
    if data[:3] == b"BZh":
        unpack = bz2.BZ2Decompressor()
    elif data[:6] == b"\xfd7zXZ\x00":
        unpack = lzma.LZMADecompressor(memlimit=256 << 20)
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        unpack = None
    else:
        unpack = zlib.decompressobj(47)  # gzip or zlib by their heads
    try:
        if unpack is None:
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as r:
                out = r.read(most + 1)
        else:
            out = unpack.decompress(data, most + 1)
    except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
        return None
    if len(out) > most:
        raise OverflowError
    return out or None


def _text(data: bytes) -> tuple[str, str] | None:
    """The characters of bytes in UTF-8 or UTF-16 and which of these it is; None if they are no text."""
    wide = "utf-16-le" if data[1::2].count(0) * 4 > len(data) else "utf-16-be" if data[::2].count(0) * 4 > len(data) else "utf-8"
    try:
        text = data.decode(wide)
    except UnicodeDecodeError:
        return None
    return (text, wide) if text and not _CONTROL.search(text) else None


def _of_bytes(layer: Layer, most: int) -> Iterator[Layer]:
    """The layer in bytes: what they unpack to, or else their characters."""
    data = layer.content
    if _packed(data) and (out := _unpacked(data, most)) is not None:
        yield Layer(out, whole=layer.span(0, len(data)))
    elif found := _text(data):
        text, code = found
        size = np.ones(len(text), np.int64) if len(text) == len(data) else np.fromiter((len(c.encode(code)) for c in text), np.int64, len(text))
        ends = np.cumsum(size)
        yield layer.child(text, ends - size, ends)


def _escaped_lines(text: str) -> Iterator[Layer]:
    """The lines with an escape: no pattern and no escape reaches over a line's end, so the others need no layer of their own."""
    if not ("%" in text or "\\" in text or "&#" in text):
        return
    at, ahead = 0, [(p, p.search(text)) for p in (_URL, _UNICODE)]
    while True:
        # each kind is looked for again only once its last match lies behind
        ahead = [(p, m if m.start() >= at else p.search(text, at)) for p, m in ahead if m]
        found = [m for _, m in ahead if m]
        if not found:
            return
        place = min(m.start() for m in found)
        start, stop = text.rfind("\n", 0, place) + 1, text.find("\n", place)
        stop = len(text) if stop < 0 else stop
        yield Layer(text[start:stop], start)
        at = stop + 1


def scan(text: str, most_bytes: int = MOST_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """(plain spans, all spans, layers opened, layers not opened) of one text; spans (kind, start, end) by start, then kind.

    Every layer is scanned whole. Its children are: all its percent escapes decoded once, all its Unicode escapes
    decoded once, the bytes of each base64 run, what bytes unpack to, the text of bytes. A line of n characters with
    escapes nested d deep takes d layers of n characters.
    """
    by_place = lambda spans: sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    plain = list(matches(text))
    spans = set(plain)
    queue: deque[Layer] = deque()
    seen: set[tuple[bytes, int, int]] = set()
    unopened = 0

    def add(layers: Iterator[Layer]) -> None:
        for x in layers:
            if len(x.content) and (k := x.key()) not in seen:
                seen.add(k)
                queue.append(x)

    add(_base64(Layer(text, 0)))
    for line in _escaped_lines(text):
        add(_url(line))
        add(_unicode(line))
    while queue:
        layer = queue.popleft()
        if isinstance(layer.content, bytes):
            try:
                add(_of_bytes(layer, most_bytes))
            except OverflowError:
                unopened += 1
            continue
        spans.update((kind, *layer.span(a, b)) for kind, a, b in matches(layer.content))
        for opened in (_url, _unicode, _base64):
            add(opened(layer))
    return by_place(plain), by_place(spans), len(seen), unopened


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Secrets in every whole text, also in nested encodings.

    Kinds: ``assign`` (a value of 12 or more characters given to a password, secret, token or API key), ``access`` (an
    access key id), ``hex`` (16 or more hexadecimal digits). Returns per input row: id_col, plain (spans of the text as
    it is: array of kind, start, end), spans (those and the ones found in layers, where start and end are the stretch
    of the text that encodes the secret), n_layers, n_unopened.

    most_bytes: a compressed layer that unpacks to more is not read but counted in n_unopened: such streams are made
    to exhaust a scanner. Nothing else is bounded; texts are read whole, however long. A null or empty text has no span.
    Null and repeated ids are rows like others. Columns other than the two named are not read. An empty table gives
    an empty result. Each row is judged by itself, so no shuffle is needed and copies or hot sources change nothing.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 512):
                found = [scan(t or "", most_bytes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array([listed(f[k]) for f in found], kinds) for k in (0, 1)),
                        *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)),
                    ],
                    names=["id", "plain", "spans", "n_layers", "n_unopened"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {id_type}, plain {span}, spans {span}, n_layers long, n_unopened long").withColumnRenamed("id", id_col)
