"""Secret scan: a worklist unwraps nested encodings until nothing new appears and rescans every layer.

A text is scanned as it is (base spans), then what decodes becomes a layer of its own that is scanned and searched
further: the whole layer with its percent or ``\\uXXXX``, ``\\xXX`` and ``&#N;`` escapes replaced, each base64 run, from
each of its first four characters on and also wrapped over lines, and each gzip, zlib, bzip2, xz or zstd stream in a layer. Layers can be any bytes. A layer seen
before in the same document is not entered again, so the worklist ends. Spans found in a layer are mapped back through
all layers to code points of the original text.

Defined results: null and empty texts have no spans; repeated rows give repeated results; only the id and text columns
are read, so other columns can have any name; an empty table gives an empty result. Texts are scanned whole.
All members of a stream are read, and of a broken one what comes out. What grows beyond ``max_layer_bytes`` is scanned in
pieces of that size that overlap by an eighth; only what needs more than the overlap in one piece can be missed there.
n_layers counts the layers that are text or hold a span or such a layer; other bytes are scanned but not counted.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("assign", "access", "hex")
#: The contract's patterns. All are ASCII, so they run on UTF-8 bytes; IGNORECASE on bytes folds ASCII letters only.
ASSIGN = re.compile(
    rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a run of [0-9a-f]+ of 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
BYTE_ESCAPE = re.compile(rb"\\x([0-9A-Fa-f]{2})")
UNICODE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run and the further lines that begin with one. It can't begin within a run, which keeps long runs linear.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
SPACE = re.compile(rb"[ \t\r\n]+")
#: Where a stream can start; the short start of zlib counts in layers that are no text.
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
STREAM_OR_ZLIB = re.compile(STREAM.pattern + rb"|\x78[\x01\x5e\x9c\xda]")
SLICE = 256  # compressed bytes at once, so that what comes out at once is bounded
STANDARD = bytes.maketrans(b"-_", b"+/")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_layers long, n_decoded long"
)
MAX_LAYER_BYTES = 64 << 20

#: From a span of a decoded fragment to a span of the fragment as it stood.
Spread = Callable[[int, int], tuple[int, int]]


def matches(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) in bytes of one layer."""
    if b"=" in data or b":" in data:
        low = data.lower()
        if any(w in low for w in WORDS):
            for m in ASSIGN.finditer(data):
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    yield m.start(), m.end(), 0
    if b"AKIA" in data:
        for m in ACCESS.finditer(data):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield m.start(), m.end(), 1
    for m in HEX.finditer(data):
        yield m.start(), m.end(), 2


def rewritten(piece: bytes, pattern: re.Pattern, value: Callable[[re.Match], bytes]) -> tuple[bytes, Spread]:
    """piece with every match replaced, and the map from spans of the result to spans of piece."""
    out, at = [], 0
    befores, afters, olds = [0], [0], [0]  # of each stretch between matches: its start and end in out, its start in piece
    size = 0
    for m in pattern.finditer(piece):
        new = value(m)
        out += piece[at : m.start()], new
        size += m.start() - at
        afters[-1] = size
        size += len(new)
        at = m.end()
        befores.append(size)
        afters.append(size)
        olds.append(at)
    out.append(piece[at:])
    afters[-1] = size + len(piece) - at

    def spread(s: int, e: int) -> tuple[int, int]:
        i, k = bisect.bisect_right(befores, s) - 1, bisect.bisect_right(befores, e - 1) - 1
        start = olds[i] + min(s, afters[i]) - befores[i]
        return start, olds[k] + e - befores[k] if e <= afters[k] else olds[k + 1]

    return b"".join(out), spread


def code_point(m: re.Match) -> bytes:
    for group, base in ((m[1], 16), (m[2], 16), (m[3], 10), (m[4], 16)):
        if group is not None:
            n = int(group, base)
            return chr(n).encode("utf-8", "ignore") if n < 0x110000 else b""
    return b""


def opened(data: bytes, at: int):
    """A new decompressor for the stream that starts there, or None."""
    head = data[at : at + 6]
    if head[:3] == b"\x1f\x8b\x08" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def member(data: bytes, at: int, step: int, end: list[int]) -> Iterator[bytes]:
    """What one stream gives, step bytes of it at once; a stream that is whole appends its end."""
    d = opened(data, at)
    while d is not None and at < len(data) and not d.eof:
        out = d.decompress(data[at : at + step])
        at = min(at + step, len(data))
        if out:
            yield out
    if d is not None and d.eof:
        end.append(at - len(d.unused_data))


def inflated(data: bytes, at: int, most: int, end: list[int]) -> Iterator[bytes]:
    """The content of the streams that follow each other from there, in pieces of at most `most` bytes that overlap."""
    held, more = bytearray(), True
    while more:
        given, known = 0, len(end)
        for step in (SLICE, 1):  # a broken stream once more by single bytes, up to the break
            past = 0
            try:
                for out in member(data, at, step, end):
                    past += len(out)
                    if past > given:
                        held += out[-(past - given) :]
                        given = past
                    while len(held) > most:
                        yield bytes(held[:most])
                        del held[: most - most // 8]
                break
            except Exception:  # noqa: BLE001  each library has its own errors; not a stream from here on then
                continue
        more = len(end) > known
        if more:
            at = end[-1]
            while data[at : at + 4] == b"\0\0\0\0":  # padding of xz
                at += 4
    if held:
        yield bytes(held)


def printable(data: bytes) -> bool:
    """Whether it is text: UTF-8 without control characters."""
    if not data or data.translate(None, CONTROL) != data:
        return False
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


CONTROL = bytes([*range(9), 11, 12, *range(14, 32), 127])


def unwrapped(data: bytes, most: int) -> Iterator[tuple[int, bytes, Spread]]:
    """(offset of the fragment, its decoded bytes, map of spans into the fragment)."""
    if b"%" in data and ESCAPE.search(data):
        yield 0, *rewritten(data, ESCAPE, lambda x: bytes([int(x[1], 16)]))
    if (b"\\" in data or b"&#" in data) and UNICODE.search(data):
        yield 0, *rewritten(data, UNICODE, code_point)
        if any(x[1] >= b"8" for x in BYTE_ESCAPE.finditer(data)):
            yield 0, *rewritten(data, BYTE_ESCAPE, lambda x: bytes([int(x[1], 16)]))
    for m in BASE64.finditer(data):
        run = m[0].rstrip(b"=")
        for skip in range(min(4, len(run) - 15)):  # letters or a slash before the encoded part shift the groups of four
            raw = decoded(run[skip:])
            full = len(raw) if opened(raw, 0) else -1  # a stream to the end takes the padding too
            into = lambda s, e, k=skip, n=full, w=len(m[0]): (k + s * 8 // 6, w if e == n else k + (e * 8 + 5) // 6)
            yield m.start(), raw, into
    for m in WRAPPED.finditer(data):
        joined, spread = rewritten(m[0].rstrip(b"="), SPACE, lambda _: b"")
        if len(joined) >= 16:
            for skip in range(4):  # a word before the first line shifts the groups of four
                into = lambda s, e, k=skip, f=spread: f(k + s * 8 // 6, k + (e * 8 + 5) // 6)
                yield m.start(), decoded(joined[skip:]), into
    pattern, at = STREAM if printable(data) else STREAM_OR_ZLIB, 0
    while m := pattern.search(data, at):
        end: list[int] = []
        for new in inflated(data, m.start(), most, end):
            yield m.start(), new, lambda s, e, n=end, a=m.start(): (0, (n[-1] if n else len(data)) - a)
        at = max(end[-1:] + [m.start() + 1])


def decoded(body: bytes) -> bytes:
    """Bytes of a base64 run without padding; a single character over has too few bits for one."""
    body = body[: len(body) - (len(body) % 4 == 1)].translate(STANDARD)
    return binascii.a2b_base64(body + b"=" * (-len(body) % 4))


def scan(text: bytes, most: int = MAX_LAYER_BYTES) -> tuple[list, list, int]:
    """Base spans, further spans (start, kind, end; bytes of text), and the number of decoded layers.

    Each distinct layer is entered once, however often and wherever it occurs; its spans are then carried up through
    every place that unwraps to it, until nothing changes.
    """
    base = sorted((s, k, e) for s, e, k in matches(text))
    key = lambda x: hashlib.sha256(x).digest()
    top = key(text)
    layers: dict[bytes, set] = {top: set(base)}
    counted: set[bytes] = set()
    inside: dict[bytes, list] = {}
    work = [(top, text)]
    while work:
        name, data = work.pop()
        inside[name] = []
        for at, new, into in unwrapped(data, most):
            if not new:
                continue
            under = key(new)
            inside[name].append((at, under, into))
            if under not in layers:
                layers[under] = {(s, k, e) for s, e, k in matches(new)}
                if layers[under] or printable(new):
                    counted.add(under)
                work.append((under, new))
    changed = len(layers) > 1
    while changed:
        changed = False
        for name in reversed(layers):
            for at, under, into in inside[name]:
                mapped = {(at + a, k, at + b) for s, k, e in layers[under] for a, b in [into(s, e)]}
                if not mapped <= layers[name] or under in counted and name not in counted:
                    layers[name] |= mapped
                    counted |= {name} if under in counted else set()
                    changed = True
    held = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
    further = layers[top].difference(base)
    more = sorted(x for x in further if not any(s <= x[0] and x[2] <= e for s, e in held[x[1]]))
    return base, more, len(counted - {top})


def in_code_points(text: bytes, spans: list) -> list[str]:
    if text.isascii():
        return [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
    marks = {x for s, _, e in spans for x in (s, e)}
    at, count, place = 0, 0, {}
    for x in sorted(marks):
        count += len(text[at:x].decode("utf-8", "replace"))
        place[x], at = count, x
    return [f"{KINDS[k]}:{place[s]}:{place[e]}" for s, k, e in spans]


def scan_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int = MAX_LAYER_BYTES
) -> DataFrame:
    """One row per row of df: counts and digest of base spans, all spans, decoded layers and spans found in them."""

    def rows(ids: list, bodies: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        for doc, body in zip(ids, bodies, strict=True):
            base, more, layers = scan(body, max_layer_bytes)
            counts = [0, 0, 0]
            for _, k, _ in base:
                counts[k] += 1
            first = in_code_points(body, base)
            values = (
                doc,
                *counts,
                hashlib.sha256(",".join(first).encode()).hexdigest(),
                ",".join(in_code_points(body, sorted(base + more)) if more else first),
                layers,
                len(more),
            )
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return out

    return common.map_texts(common.id_and_text(df, id_col, text_col), rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(common.table(spark, sf_dir, "documents"))
