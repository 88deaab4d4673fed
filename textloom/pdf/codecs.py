"""Stream filters: pure functions over bytes."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .syntax import Dict, PdfError, integer


def parameter(parms: Dict | None, key: bytes, default: int) -> int:
    value = integer(parms.get(key)) if isinstance(parms, Dict) else None
    return default if value is None else value


def inflate(data: bytes) -> bytes:
    """Whatever can be decompressed, with or without a header."""
    best = b""
    for window in (15, -15):
        for body in (data, data.lstrip(b"\r\n")):
            d, out = zlib.decompressobj(window), bytearray()
            try:
                for at in range(0, len(body), 1 << 14):
                    out += d.decompress(body[at : at + (1 << 14)])
                out += d.flush()
                return bytes(out)
            except zlib.error:
                # byte by byte up to the damage
                d, out = zlib.decompressobj(window), bytearray()
                try:
                    for i in range(len(body)):
                        out += d.decompress(body[i : i + 1])
                except zlib.error:
                    pass
                best = max(best, bytes(out), key=len)
    if not best and data:
        raise PdfError("a compressed stream can't be read")
    return best


def inflate_strict(data: bytes) -> bytes | None:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error:
        return None
    return out if d.eof and len(d.unused_data) <= 1 else None


#: Compression by name: zlib levels, or several ways of which the smallest result counts. Beyond 8 MiB "max" is "best".
LEVELS = {"fast": 6, "best": 9}
MOST = 8 << 20


def deflate(data: bytes, how: str = "best") -> bytes:
    if how != "max" or len(data) > MOST:
        return zlib.compress(data, LEVELS.get(how, 9))
    ways = ((memory, strategy) for memory in (8, 9) for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED))

    def packed(memory: int, strategy: int) -> bytes:
        c = zlib.compressobj(9, zlib.DEFLATED, zlib.MAX_WBITS, memory, strategy)
        return c.compress(data) + c.flush()

    return min((packed(*w) for w in ways), key=len)


def up_rows(data: bytes, width: int) -> bytes:
    """Rows of ``width`` bytes as differences to the row above, each behind the tag of that predictor."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    steps = np.diff(rows, axis=0, prepend=np.zeros((1, width), np.uint8))
    return np.insert(steps, 0, 2, axis=1).tobytes()


def unpredict(data: bytes, parms: Dict | None) -> bytes:
    kind = parameter(parms, b"Predictor", 1)
    if kind == 1:
        return data
    colors, bits, columns = parameter(parms, b"Colors", 1), parameter(parms, b"BitsPerComponent", 8), parameter(parms, b"Columns", 1)
    if not (0 < colors <= 64 and bits in (1, 2, 4, 8, 16) and 0 < columns <= 1 << 24):
        raise PdfError("bad predictor parameters")
    pixel, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise PdfError("a TIFF predictor of other than 8 bits is not supported")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[len(data) // width * width :]
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        tag, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if tag == 2:
            for i in range(len(row)):
                row[i] = (row[i] + above[i]) & 255
        elif tag:
            for i in range(len(row)):
                a, b, c = (row[i - pixel], above[i], above[i - pixel]) if i >= pixel else (0, above[i], 0)
                if tag == 4:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    guess = a if tag == 1 else (a + b) // 2 if tag == 3 else 0
                row[i] = (row[i] + guess) & 255
        out += row
        above = row + bytearray(width - len(row))
    return bytes(out)


def unlzw(data: bytes, early: bool = True) -> bytes:
    out, table, size, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & (1 << size) - 1
        if code == 256:
            del table[258:]
            size, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            word = table[code]
        elif last:
            word = last + last[:1]
        else:
            break
        out += word
        if last and len(table) < 4096:
            table.append(last + word[:1])
        last = word
        reached = len(table) + early
        size = 9 if reached < 512 else 10 if reached < 1024 else 11 if reached < 2048 else 12
    return bytes(out)


_NOT_85 = bytes(c for c in range(256) if not 33 <= c <= 117 and c != ord("z"))


def unascii85(data: bytes) -> bytes:
    """Signs of other kinds don't count; groups are worked out all at once."""
    body = data.removeprefix(b"<~").split(b"~")[0].translate(None, _NOT_85)
    # a z between groups stands for a group of zeros; inside a group it doesn't count
    if b"z" in body:
        kept, place = bytearray(), 0
        for run in re.findall(rb"z|[^z]+", body):
            if run != b"z":
                kept += run
                place = (place + len(run)) % 5
            elif not place:
                kept += b"!!!!!"
        body = bytes(kept)
    extra = -len(body) % 5
    if extra == 4:  # a single sign says nothing
        body, extra = body[:-1], 0
    groups = np.frombuffer(body + b"u" * extra, np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(33)
    values = groups @ np.array([85**4, 85**3, 85**2, 85, 1], np.uint64) & np.uint64(0xFFFFFFFF)
    out = values.astype(">u4").tobytes()
    return out[: len(out) - extra]


def unasciihex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def unrunlength(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def decode(filters: list[tuple[bytes, Dict | None]], data: bytes) -> bytes:
    """A chain of (name, parameters)."""
    for name, parms in filters:
        if name in (b"FlateDecode", b"Fl"):
            data = unpredict(inflate(data), parms)
        elif name in (b"LZWDecode", b"LZW"):
            data = unpredict(unlzw(data, parameter(parms, b"EarlyChange", 1) != 0), parms)
        elif name in (b"ASCII85Decode", b"A85"):
            data = unascii85(data)
        elif name in (b"ASCIIHexDecode", b"AHx"):
            data = unasciihex(data)
        elif name in (b"RunLengthDecode", b"RL"):
            data = unrunlength(data)
        elif name != b"Crypt":
            raise PdfError(f"filter {name.decode('latin-1')} is not supported")
    return data
