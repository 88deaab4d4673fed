"""The container: cross-references, objects, streams; reading with recovery, writing with untouched bytes kept."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import codecs
from .crypt import Crypt
from .syntax import BLANK, END, SPACE, WORD, Dict, Keyword, Lexer, Name, PdfError, Ref, Text, integer, parse, write

_HEADER = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")
#: The usual forms of an object's head and of a row of a cross-reference table; all others go token by token.
_HEAD = re.compile(BLANK + rb"*+(\d{1,18})" + BLANK + rb"++(\d{1,18})" + BLANK + rb"++obj(?!" + WORD + rb")")
_ROW = re.compile(BLANK + rb"*+(\d{1,18})" + BLANK + rb"++(\d{1,18})" + BLANK + rb"++([nf])(?!" + WORD + rb")")


@dataclass
class Stream:
    """A stream object: dictionary, raw bytes as in the file, decoded bytes once they were set."""

    dict: Dict
    raw: bytes
    new: bytes | None = None


@dataclass
class Entry:
    """An object: where it was (a byte range, or container and index) and whether it changed."""

    value: object
    gen: int = 0
    span: tuple[int, int] | None = None
    inside: tuple[int, int] | None = None
    dirty: bool = False


class Document:
    """One PDF file in memory."""

    compression = "best"  # of streams that change

    def __init__(self, data: bytes, password: str | None = None):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF file")
        self.data, self.password = data, password
        self.crypt: Crypt | None = None
        self.warnings: list[str] = []
        self.use_xref_stream, self.xref_nums = False, set()
        try:
            self.trailer, places = self._follow(self._startxref())
            self._load(places, True)
            if not isinstance(self.resolve(self.trailer.get(b"Root")), Dict):
                raise PdfError("no catalog")
        except (PdfError, IndexError, OverflowError, RecursionError) as e:
            if "password" in str(e):
                raise
            self.warnings.append(f"the cross-references are damaged ({e}); the file was scanned instead")
            self.trailer, places = self._scan()
            self._load(places, False)
            if not isinstance(self.resolve(self.trailer.get(b"Root")), Dict):
                raise PdfError("no catalog was found") from e

    # ---- where objects are

    def _startxref(self) -> int:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 4096))
        offset = Lexer(self.data, at + 9).next()[0] if at >= 0 else None
        if not isinstance(offset, int):
            raise PdfError("no startxref")
        return offset

    def _follow(self, offset: int) -> tuple[Dict, dict]:
        """Sections from the newest to the oldest; the first mention of an object counts."""
        places: dict[int, tuple] = {}
        todo, seen, newest = [offset], set(), None
        while todo:
            at = todo.pop()
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            lex = Lexer(self.data, at)
            trailer = self._table(lex, places) if lex.next()[0] == Keyword(b"xref") else self._xref_stream(at, places, newest is None)
            newest = newest or trailer
            # a hybrid file's stream is looked up before older sections
            todo += [n for k in (b"Prev", b"XRefStm") if (n := integer(trailer.get(k))) is not None]
        if newest is None:
            raise PdfError("no cross-reference section")
        return newest, places

    @staticmethod
    def _table(lex: Lexer, places: dict) -> Dict:
        while True:
            first = lex.next()[0]
            if first == Keyword(b"trailer"):
                trailer = parse(lex)
                if not isinstance(trailer, Dict):
                    raise PdfError("a malformed trailer")
                return trailer
            count = lex.next()[0]
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("a malformed cross-reference table")
            for num in range(first, first + count):
                if m := _ROW.match(lex.data, lex.pos):
                    places.setdefault(num, ("at", int(m[1]), int(m[2])) if m[3] == b"n" else None)
                    lex.pos = m.end()
                    continue
                at, gen, kind = (lex.next()[0] for _ in range(3))
                if not isinstance(at, int) or not isinstance(gen, int) or not isinstance(kind, Keyword) or kind == END:
                    raise PdfError("a malformed cross-reference entry")
                places.setdefault(num, ("at", at, gen) if kind.word == b"n" else None)

    def _xref_stream(self, at: int, places: dict, first: bool) -> Dict:
        num, _, value, _ = self._object_at(at, {})
        if not isinstance(value, Stream) or value.dict.get(b"Type") != b"XRef":
            raise PdfError("no cross-reference stream where one should be")
        self.xref_nums.add(num)
        self.use_xref_stream |= first
        d = value.dict
        widths = [max(0, integer(w) or 0) for w in d.get(b"W") or []]
        if len(widths) != 3 or not sum(widths):
            raise PdfError("malformed widths in a cross-reference stream")
        body = codecs.decode(self._filters(d, False), value.raw)
        index = [integer(x) or 0 for x in d.get(b"Index") or [0, integer(d.get(b"Size")) or 0]]
        nums = [n for a, c in zip(index[::2], index[1::2], strict=False) for n in range(a, a + min(c, len(body)))]
        for i, n in enumerate(nums[: len(body) // sum(widths)]):
            row, fields = body[i * sum(widths) : (i + 1) * sum(widths)], []
            for w in widths:
                fields.append(int.from_bytes(row[:w], "big"))
                row = row[w:]
            kind = fields[0] if widths[0] else 1
            if kind in (0, 1, 2):
                places.setdefault(n, (None, ("at", fields[1], fields[2]), ("in", fields[1], fields[2]))[kind])
        return d

    def _scan(self) -> tuple[Dict, dict]:
        """Every object in the file, the last of each number; then what object streams hold."""
        places: dict[int, tuple] = {}
        trailer = catalog = None
        containers, pos = [], 0
        while m := _HEADER.search(self.data, pos):
            pos = m.end()
            try:
                num, gen, value, end = self._object_at(m.start(), {})
            except PdfError:
                continue
            places[num] = ("at", m.start(), gen)
            pos = max(pos, end)
            d = value.dict if isinstance(value, Stream) else value
            if isinstance(d, Dict):
                if d.get(b"Type") == b"Catalog" and b"Pages" in d:
                    catalog = num
                elif isinstance(value, Stream) and d.get(b"Type") == b"XRef" and b"Root" in d:
                    trailer = d
                elif isinstance(value, Stream) and d.get(b"Type") == b"ObjStm":
                    containers.append((num, m.start()))
        for m in re.finditer(rb"trailer", self.data):  # a classic trailer is always preferred
            try:
                d = parse(Lexer(self.data, m.end()))
            except PdfError:
                continue
            if isinstance(d, Dict) and b"Root" in d:
                trailer = d
        if trailer is None:
            if catalog is None:
                raise PdfError("no trailer and no catalog")
            trailer = Dict([(Name(b"Root"), Ref(catalog, 0))])
        self.use_xref_stream, self.xref_nums = False, set()
        self.trailer = trailer
        self._open_crypt(places)
        for stm, at in containers:
            try:
                members = self._members(stm, places)
            except PdfError:
                continue
            for i, (num, _) in enumerate(members):
                have = places.get(num)
                if not (have and have[0] == "at" and have[1] > at):
                    places[num] = ("in", stm, i)
                    self.use_xref_stream = True
        return trailer, places

    # ---- objects

    def _object_at(self, at: int, places: dict) -> tuple[int, int, object, int]:
        """(number, generation, value, end) of the object at an offset."""
        lex = Lexer(self.data, at)
        if m := _HEAD.match(self.data, at):
            num, gen, lex.pos = int(m[1]), int(m[2]), m.end()
        else:
            num, gen, word = (lex.next()[0] for _ in range(3))
            if not isinstance(num, int) or not isinstance(gen, int) or word != Keyword(b"obj"):
                raise PdfError(f"no object at {at}")
        value = parse(lex)
        after = lex.pos
        word, start, end = lex.next()
        if word == Keyword(b"stream") and isinstance(value, Dict):
            start = end + (2 if self.data[end : end + 2] == b"\r\n" else 1 if self.data[end : end + 1] in (b"\n", b"\r") else 0)
            length = value.get(b"Length")
            if isinstance(length, Ref):
                place = places.get(length.num)
                length = self._plain_int(place[1]) if place and place[0] == "at" else None
            stop = start + length if isinstance(length, int) and length >= 0 else -1
            close = Lexer(self.data, stop) if start <= stop <= len(self.data) else None
            if close is None or close.next()[0] != Keyword(b"endstream"):
                stop = self.data.find(b"endstream", start)
                if stop < 0:
                    raise PdfError("a stream without an end")
                close = Lexer(self.data, stop + 9)
                stop -= 2 if self.data[stop - 2 : stop] == b"\r\n" else 1 if self.data[stop - 1 : stop] in (b"\n", b"\r") else 0
            value, after = Stream(value, self.data[start : max(start, stop)]), close.pos
            lex = close
            word, _, end = lex.next()
        if word == Keyword(b"endobj"):
            after = end
        return num, gen, value, after

    def _plain_int(self, at: int) -> int | None:
        lex = Lexer(self.data, at)
        tokens = [lex.next()[0] for _ in range(4)]
        return tokens[3] if tokens[2] == Keyword(b"obj") and isinstance(tokens[3], int) else None

    def _open_crypt(self, places: dict) -> None:
        d = self.trailer.get(b"Encrypt")
        self.crypt_num = d.num if isinstance(d, Ref) else None
        if isinstance(d, Ref):
            place = places.get(d.num)
            d = self._object_at(place[1], places)[2] if place and place[0] == "at" else None
        if isinstance(d, Dict):
            ids = self.trailer.get(b"ID")
            first = ids[0].data if isinstance(ids, list) and ids and isinstance(ids[0], Text) else b""
            self.crypt = Crypt(d, first, self.password)

    def _members(self, stm: int, places: dict) -> list[tuple[int, bytes]]:
        """(number, bytes) of what an object stream holds."""
        place = places.get(stm)
        if not place or place[0] != "at":
            raise PdfError("an object stream is missing")
        _, gen, value, _ = self._object_at(place[1], places)
        if not isinstance(value, Stream):
            raise PdfError("an object stream is no stream")
        body = self._decode(value, stm, gen)
        lex, n, first = Lexer(body), integer(value.dict.get(b"N")) or 0, integer(value.dict.get(b"First")) or 0
        pairs = []
        for _ in range(min(n, len(body))):
            a, b = lex.next()[0], lex.next()[0]
            if not isinstance(a, int) or not isinstance(b, int):
                break
            pairs.append((a, first + b))
        ends = sorted({p for _, p in pairs} | {len(body)})
        return [(a, body[p : next((e for e in ends if e > p), len(body))]) for a, p in pairs]

    def _load(self, places: dict, strict: bool) -> None:
        self.entries: dict[int, Entry] = {}
        self.containers: dict[int, list[tuple[int, bytes]]] = {}
        if self.crypt is None:
            self._open_crypt(places)
        for num, place in sorted(places.items()):
            if place and place[0] == "at":
                try:
                    found, gen, value, end = self._object_at(place[1], places)
                    if found != num:
                        raise PdfError(f"object {num} is not where it should be")
                except PdfError:
                    if strict:
                        raise
                    continue
                d = value.dict if isinstance(value, Stream) else None
                if self.crypt and num != self.crypt_num and not (d and d.get(b"Type") == b"XRef"):
                    if isinstance(value, Stream):
                        value.dict = self.crypt.walk(value.dict, num, gen, False)
                    else:
                        value = self.crypt.walk(value, num, gen, False)
                self.entries[num] = Entry(value, gen, (place[1], end))
        for num, place in sorted(places.items()):
            if place and place[0] == "in":
                try:
                    if place[1] not in self.containers:
                        self.containers[place[1]] = self._members(place[1], places)
                    members = self.containers[place[1]]
                    i = place[2] if place[2] < len(members) and members[place[2]][0] == num else next((i for i, (n, _) in enumerate(members) if n == num), None)
                    if i is None:
                        raise PdfError(f"object {num} is not in its container")
                    self.entries[num] = Entry(parse(Lexer(members[i][1])), 0, None, (place[1], i))
                except PdfError:
                    if strict:
                        raise

    # ---- use

    def get(self, num: int):
        e = self.entries.get(num)
        return e.value if e else None

    def resolve(self, value):
        """What a chain of references leads to; a stream is left as it is."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def dict_of(self, value) -> Dict | None:
        """The dictionary of a value, through references and of a stream."""
        value = self.resolve(value)
        return value.dict if isinstance(value, Stream) else value if isinstance(value, Dict) else None

    def list_of(self, value) -> list:
        value = self.resolve(value)
        return value if isinstance(value, list) else []

    def _filters(self, d: Dict, resolve: bool = True) -> list[tuple[bytes, Dict | None]]:
        through = self.resolve if resolve else (lambda v: v)
        names, parms = through(d.get(b"Filter")), through(d.get(b"DecodeParms"))
        names = names if isinstance(names, list) else [names] if names is not None else []
        parms = parms if isinstance(parms, list) else [parms]
        out = []
        for i, n in enumerate(names):
            p = through(parms[i]) if i < len(parms) else None
            if isinstance(p, Dict):
                p = Dict([(k, through(v)) for k, v in p.items])
            out.append((through(n) or b"", p))
        return out

    def _decode(self, s: Stream, num: int, gen: int) -> bytes:
        raw = s.raw
        if self.crypt:
            raw = self.crypt.apply(self.crypt.stream_method(s.dict), num, gen, raw, False)
        return codecs.decode(self._filters(s.dict), raw)

    def stream_data(self, num: int) -> bytes:
        e = self.entries.get(num)
        if e is None or not isinstance(e.value, Stream):
            raise PdfError(f"object {num} is no stream")
        return e.value.new if e.value.new is not None else self._decode(e.value, num, e.gen)

    def set_stream(self, num: int, data: bytes) -> None:
        e = self.entries[num]
        e.value.new, e.dirty = data, True

    def touch(self, num: int) -> None:
        self.entries[num].dirty = True

    def add(self, value) -> int:
        num = max([0, *self.entries, *self.xref_nums]) + 1
        self.entries[num] = Entry(value, 0, None, None, True)
        return num

    @property
    def dirty(self) -> bool:
        return any(e.dirty for e in self.entries.values())

    # ---- writing

    def recompress(self, need: int) -> int:
        """Packs untouched compressed streams tighter, the largest first, until ``need`` bytes are saved; returns how many were.

        Only streams of 64 bytes to 8 MiB with nothing but plain compression count, 200 of them at most."""
        able = [(len(e.value.raw), n) for n, e in self.entries.items() if isinstance(e.value, Stream) and not e.dirty and e.span and self._filters(e.value.dict) == [(b"FlateDecode", None)] and 64 <= len(e.value.raw) < 8 << 20 and e.value.dict.get(b"Type") not in (b"XRef", b"ObjStm")]
        saved = 0
        for size, n in sorted(able, reverse=True)[:200]:
            if saved >= need:
                break
            e = self.entries[n]
            raw = self.crypt.apply(self.crypt.stream_method(e.value.dict), n, e.gen, e.value.raw, False) if self.crypt else e.value.raw
            body = codecs.inflate_strict(raw)
            tight = codecs.deflate(body) if body is not None else raw
            if len(tight) < len(raw) and codecs.inflate_strict(tight) == body:
                self.set_stream(n, body)
                saved += len(raw) - len(tight)
        return saved

    def _stream_bytes(self, num: int, e: Entry) -> bytes:
        s = e.value
        d = Dict(list(s.dict.items))
        raw = s.raw
        if s.new is not None:
            raw = s.new
            if b"Filter" in d:
                d.set(b"Filter", Name(b"FlateDecode"))
                raw = codecs.deflate(raw, self.compression)
            d.drop(b"DecodeParms")
            if self.crypt:
                raw = self.crypt.apply(self.crypt.stream_method(d), num, e.gen, raw, True)
        length = d.get(b"Length")
        if isinstance(length, Ref) and isinstance(self.get(length.num), int) and self.entries[length.num].span:
            self.entries[length.num].value, self.entries[length.num].dirty = len(raw), True
        else:
            d.set(b"Length", len(raw))
        if self.crypt:
            d = self.crypt.walk(d, num, e.gen, True)
        return write(d) + b"\nstream\n" + raw + b"\nendstream"

    def _object_bytes(self, num: int, e: Entry) -> bytes:
        if isinstance(e.value, Stream):
            body = self._stream_bytes(num, e)
        else:
            value = self.crypt.walk(e.value, num, e.gen, True) if self.crypt and num != self.crypt_num else e.value
            body = write(value)
        return b"%d %d obj\n" % (num, e.gen) + body + b"\nendobj"

    def write(self) -> bytes:
        """The file again: untouched objects byte for byte and in their order, then new ones, then new cross-references."""
        if not self.dirty:
            return self.data
        linearized = {n for n, e in self.entries.items() if isinstance(e.value, Dict) and b"Linearized" in e.value}
        hints = {int(n) for n, e in self.entries.items() for d in [self.entries[k].value for k in linearized] if e.span and (h := d.get(b"H")) and isinstance(h, list) and h and h[0] == e.span[0]}
        gone = linearized | hints | self.xref_nums
        rebuilt = {e.inside[0] for e in self.entries.values() if e.inside and e.dirty}
        for stm in rebuilt:
            self._rebuild(stm)
        streams = {n: self._object_bytes(n, e) for n, e in self.entries.items() if e.dirty and not e.inside and isinstance(e.value, Stream)}
        out = bytearray(self.data[: min([len(self.data), *(e.span[0] for e in self.entries.values() if e.span)])])
        if linearized and out.strip().count(b"%") == 0:
            out = bytearray(self.data[:9] + b"\n")
        rows: dict[int, tuple] = {}
        order = sorted((n for n, e in self.entries.items() if e.span and n not in gone), key=lambda n: self.entries[n].span)
        for n in [*order, *(n for n, e in self.entries.items() if not e.span and not e.inside)]:
            e = self.entries[n]
            if out and out[-1:] not in (b"\n", b"\r"):
                out += b"\n"
            rows[n] = (1, len(out), e.gen)
            out += streams.get(n) or (self._object_bytes(n, e) if e.dirty else self.data[e.span[0] : e.span[1]])
            out += b"\n"
        for n, e in self.entries.items():
            if e.inside:
                rows[n] = (2, *e.inside)
        trailer = Dict([(k, v) for k, v in self.trailer.items if k not in (b"Prev", b"XRefStm", b"Size", b"Type", b"W", b"Index", b"Filter", b"DecodeParms", b"Length")])
        if self.use_xref_stream or any(r[0] == 2 for r in rows.values()):
            return bytes(out + self._stream_section(trailer, rows, len(out)))
        return bytes(out + self._table_section(trailer, rows, len(out)))

    def _rebuild(self, stm: int) -> None:
        parts = []
        for i, (num, body) in enumerate(self.containers[stm]):
            e = self.entries.get(num)
            mine = e is not None and e.inside == (stm, i)
            parts.append((num, write(e.value) if mine and e.dirty else body.strip(SPACE)))
        head, body = [], bytearray()
        for num, part in parts:
            head.append(b"%d %d" % (num, len(body)))
            body += part + b"\n"
        first = b" ".join(head) + b"\n"
        s = self.entries[stm].value
        s.dict.set(b"First", len(first))
        s.dict.set(b"N", len(parts))
        self.set_stream(stm, first + bytes(body))

    @staticmethod
    def runs(nums: list[int]) -> list[tuple[int, int]]:
        """(first, count) of runs of numbers; a hole of one is bridged."""
        out: list[tuple[int, int]] = []
        for n in sorted(nums):
            if out and n - (out[-1][0] + out[-1][1]) <= 1:
                out[-1] = (out[-1][0], n - out[-1][0] + 1)
            else:
                out.append((n, 1))
        return out

    def _table_section(self, trailer: Dict, rows: dict, at: int) -> bytes:
        rows = {0: (0, 0, 65_535), **rows}
        out = bytearray(b"xref\n")
        for first, count in self.runs(list(rows)):
            out += b"%d %d\n" % (first, count)
            for n in range(first, first + count):
                kind, a, b = rows.get(n, (0, 0, 65_535))
                out += b"%010d %05d %s \n" % (a, b, b"n" if kind else b"f")
        trailer.set(b"Size", max(rows) + 1)
        return bytes(out) + b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at

    def _stream_section(self, trailer: Dict, rows: dict, at: int) -> bytes:
        own = max([0, *rows]) + 1
        rows = {0: (0, 0, 65_535), **rows, own: (1, at, 0)}
        runs = self.runs(list(rows))
        wide = max(1, (max(a for _, a, _ in rows.values()).bit_length() + 7) // 8)
        body = bytearray()
        for first, count in runs:
            for n in range(first, first + count):
                kind, a, b = rows.get(n, (0, 0, 65_535))
                body += bytes([kind]) + a.to_bytes(wide, "big") + min(b, 65_535).to_bytes(2, "big")
        # rows as differences to the row above, unless plain ones are smaller
        plain, steps = codecs.deflate(bytes(body)), codecs.deflate(codecs.up_rows(bytes(body), wide + 3))
        parms = Dict([(Name(b"Predictor"), 12), (Name(b"Columns"), wide + 3)])
        predicted = len(steps) + len(write(parms)) + len(b"/DecodeParms") < len(plain)
        raw = steps if predicted else plain
        d = Dict([(Name(b"Type"), Name(b"XRef")), *trailer.items])
        for key, value in ((b"Size", own + 1), (b"W", [1, wide, 2]), (b"Index", [x for run in runs for x in run]), (b"Filter", Name(b"FlateDecode")), *([(b"DecodeParms", parms)] if predicted else []), (b"Length", len(raw))):
            d.set(key, value)
        return b"%d 0 obj\n" % own + write(d) + b"\nstream\n" + raw + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
