"""PDF files from scratch, for tests, queries and trying out rules: objects as values of the syntax module, put into containers of
several kinds, and data put into the form of every codec."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np

from . import crypt as C
from .codecs import up_rows
from .syntax import Dict, Name, Ref, Text, write


def value(x):
    """Python values as those of the syntax module: str is a name, bytes a string."""
    if isinstance(x, dict):
        return Dict([(Name(k.encode()), value(v)) for k, v in x.items()])
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    if isinstance(x, str):
        return Name(x.encode())
    return Text(x) if type(x) is bytes else x


SANS = {"Type": "Font", "Subtype": "Type1", "BaseFont": "Helvetica", "Encoding": "WinAnsiEncoding"}


@dataclass
class Paper:
    """A document in the making. Object 1 is the catalog, 2 the page tree."""

    objects: dict[int, tuple] = field(default_factory=dict)  # number -> (value, stream bytes or None)
    pages: list[Ref] = field(default_factory=list)

    def add(self, x, data: bytes | None = None) -> Ref:
        num = max([2, *self.objects]) + 1
        self.objects[num] = (value(x), data)
        return Ref(num)

    def page(self, drawn: bytes | str, fonts: dict | None = None, packed: bool = False, **more) -> Paper:
        """A page; ``more`` goes into its dictionary, but ``resources`` into its resources."""
        drawn = drawn.encode("cp1252") if isinstance(drawn, str) else drawn
        body = self.add({"Filter": "FlateDecode"}, zlib.compress(drawn, 1)) if packed else self.add({}, drawn)
        fonts = {k: v if isinstance(v, Ref) else self.add(v) for k, v in (fonts or {"Body": SANS}).items()}
        resources = {"Font": fonts} | more.pop("resources", {})
        self.pages.append(self.add({"Type": "Page", "Parent": Ref(2), "MediaBox": [0, 0, 420, 595], "Contents": body, "Resources": resources} | more))
        return self

    def all(self) -> dict[int, tuple]:
        tree = {"Type": "Pages", "Count": len(self.pages), "Kids": self.pages}
        return {1: (value({"Type": "Catalog", "Pages": Ref(2)}), None), 2: (value(tree), None), **self.objects}

    def table(self, head: bytes = b"%PDF-1.6\n", extra: dict | None = None) -> bytes:
        """With a plain cross-reference table."""
        return _table({n: _body(*o) for n, o in self.all().items()}, head, extra or {})

    def linearized(self) -> bytes:
        """The table form with the mark of a file made for slow lines."""
        self.add({"Linearized": 1, "L": 0})
        return self.table()

    def packed(self) -> bytes:
        """All that can be in an object stream, and a cross-reference stream."""
        every = self.all()
        inside = sorted(n for n, (_, data) in every.items() if data is None)
        bodies = [write(every[n][0]) for n in inside]
        index = b" ".join(b"%d %d" % (n, sum(map(len, bodies[:i])) + i) for i, n in enumerate(inside)) + b" "
        holder = max(every) + 1
        outside = {n: o for n, o in every.items() if n not in inside}
        outside[holder] = (value({"Type": "ObjStm", "N": len(inside), "First": len(index), "Filter": "FlateDecode"}), zlib.compress(index + b"\n".join(bodies)))
        out, rows = bytearray(b"%PDF-1.7\n"), {n: (2, holder, i) for i, n in enumerate(inside)}
        for n, o in outside.items():
            rows[n] = (1, len(out), 0)
            out += _numbered(n, _body(*o))
        own, at = holder + 1, len(out)
        rows |= {0: (0, 0, 255), own: (1, at, 0)}
        raw = b"".join(rows[n][0].to_bytes(1, "big") + rows[n][1].to_bytes(4, "big") + rows[n][2].to_bytes(1, "big") for n in range(own + 1))
        section = {"Type": "XRef", "Size": own + 1, "Root": Ref(1), "W": [1, 4, 1], "Filter": "FlateDecode"}
        return bytes(out + _numbered(own, _body(value(section), zlib.compress(raw)))) + b"startxref\n%d\n%%%%EOF\n" % at

    def locked(self, method: str, password: bytes = b"") -> bytes:
        """Encrypted by rc4, aes128 or aes256."""
        mark = b"fedcba9876543210"
        handler, security = (_modern if method == "aes256" else _classic)(method, password, mark)
        bodies = {}
        for n, (v, data) in self.all().items():
            sealed = None if data is None else handler.apply(method, n, 0, data, True)
            bodies[n] = _body(handler.walk(v, n, 0, True), sealed)
        num = max(bodies) + 1
        bodies[num] = write(security)
        return _table(bodies, b"%PDF-1.7\n", {"Encrypt": Ref(num), "ID": [Text(mark, True), Text(mark, True)]})


def _body(v, data: bytes | None) -> bytes:
    if data is None:
        return write(v)
    v = Dict([*v.items, (Name(b"Length"), len(data))])
    return write(v) + b"\nstream\n" + data + b"\nendstream"


def _numbered(n: int, body: bytes) -> bytes:
    return b"%d 0 obj\n" % n + body + b"\nendobj\n"


def _table(bodies: dict[int, bytes], head: bytes, extra: dict) -> bytes:
    out, rows = bytearray(head), [b"0000000000 65535 f \n"]
    for n in sorted(bodies):
        rows.append(b"%010d 00000 n \n" % len(out))
        out += _numbered(n, bodies[n])
    trailer = write(value({"Size": len(rows), "Root": Ref(1), **extra}))
    return bytes(out) + b"xref\n0 %d\n" % len(rows) + b"".join(rows) + b"trailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF\n" % len(out)


class _Key(C.Crypt):
    """A handler made from its key, to write encrypted files with."""

    def __init__(self, key: bytes, method: str):
        self.key, self.strings, self.streams, self.metadata = key, method, method, True


def _hex(x: bytes) -> Text:
    return Text(x, True)


def _modern(method: str, password: bytes, mark: bytes) -> tuple[_Key, Dict]:
    key = bytes(range(100, 132))

    def sealed(secret: bytes, salts: bytes, extra: bytes) -> tuple[bytes, bytes]:
        proof = C.hardened(6, secret, salts[:8], extra) + salts
        return proof, C.Aes(C.hardened(6, secret, salts[8:], extra)).cbc(bytes(16), key, True)

    u, ue = sealed(password, b"saltAAAAsaltBBBB", b"")
    o, oe = sealed(b"keeper", b"saltCCCCsaltDDDD", u)
    filter_ = {"StdCF": {"CFM": "AESV3", "Length": 32}}
    return _Key(key, method), value({"Filter": "Standard", "V": 5, "R": 6, "Length": 256, "P": -4, "O": _hex(o), "U": _hex(u), "OE": _hex(oe), "UE": _hex(ue), "Perms": _hex(bytes(16)), "CF": filter_, "StmF": "StdCF", "StrF": "StdCF"})


def _classic(method: str, password: bytes, mark: bytes) -> tuple[_Key, Dict]:
    version, revision = (2, 3) if method == "rc4" else (4, 4)
    o = bytes(range(64, 96))
    maker = _Key(b"", method)
    maker.revision = revision
    key = maker._user_key(password, o, (-4).to_bytes(4, "little", signed=True), mark, 16)
    u = hashlib.md5(C.PAD + mark).digest()
    for i in range(20):
        u = C.rc4(bytes(k ^ i for k in key), u)
    security = {"Filter": "Standard", "V": version, "R": revision, "Length": 128, "P": -4, "O": _hex(o), "U": _hex(u + bytes(16))}
    if method == "aes128":
        security |= {"CF": {"StdCF": {"CFM": "AESV2", "Length": 16}}, "StmF": "StdCF", "StrF": "StdCF"}
    return _Key(key, method), value(security)


FORMS = {
    "table": lambda p: p.table(), "linearized": lambda p: p.linearized(), "packed": lambda p: p.packed(), "damaged": lambda p: p.table().replace(b"startxref", b"startxrof"),
    "rc4": lambda p: p.locked("rc4"), "aes128": lambda p: p.locked("aes128"), "aes256": lambda p: p.locked("aes256"),
}


def two_byte_font(paper: Paper, letters: str, subset: bool = True) -> dict:
    """A composite font that shows these letters by codes from 1 on."""
    code = {c: i for i, c in enumerate(letters, 1)}
    rows = b"".join(b"<%04X> <%s>\n" % (i, c.encode("utf-16-be").hex().encode()) for c, i in code.items())
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n" % len(code) + rows + b"endbfchar"
    kid = {"Type": "Font", "Subtype": "CIDFontType2", "DW": 500, "FontDescriptor": {"Type": "FontDescriptor", "Flags": 4} | ({"FontFile2": paper.add({}, b"\0")} if subset else {})}
    return {"Type": "Font", "Subtype": "Type0", "BaseFont": "LOOMED+Made" if subset else "Made", "Encoding": "Identity-H", "DescendantFonts": [kid], "ToUnicode": paper.add({"Filter": "FlateDecode"}, zlib.compress(cmap))}


def text_operators(text: str, letters: str) -> bytes:
    """Lines of a text in codes of ``two_byte_font``, one below the other."""
    at = {c: i for i, c in enumerate(letters, 1)}
    lines = (b"<" + b"".join(b"%04X" % at[c] for c in line) + b"> Tj" for line in text.split("\n"))
    return b"BT /Made 10 Tf 12 TL 40 800 Td " + b" T* ".join(lines) + b" ET"


def any_text_pdf(pages: list[str], form: str = "table", marked: bool = False) -> bytes:
    """Pages of texts with any characters. ``marked``: each also stands as the replacement text of its own content."""
    paper, letters = Paper(), "".join(sorted({c for p in pages for c in p if c != "\n"}))
    font = paper.add(two_byte_font(paper, letters))
    for p in pages:
        body = text_operators(p, letters)
        if marked:
            body = b"/Span <</ActualText " + write(Text(b"\xfe\xff" + p.encode("utf-16-be"))) + b">> BDC " + body + b" EMC"
        paper.page(body, {"Made": font}, packed=True)
    return FORMS[form](paper)


def named_glyphs_pdf(text: str) -> bytes:
    """A line of at most 200 different letters in a one-byte font whose glyphs have names only."""
    letters = sorted(set(text))
    names = [f"u{ord(c):04X}" if ord(c) > 0xFFFF else f"uni{ord(c):04X}" for c in letters]
    paper = Paper()
    font = {"Type": "Font", "Subtype": "Type1", "BaseFont": "Named", "FirstChar": 32, "Widths": [500] * len(letters), "Encoding": {"Differences": [32, *names]}}
    codes = bytes(32 + letters.index(c) for c in text)
    return paper.page(b"BT /Named 10 Tf 20 700 Td " + write(Text(codes)) + b" Tj ET", {"Named": font}).table()


def link_pdf(uris: list[str], apart: bool) -> bytes:
    """A page with a link annotation for each address, which may be an object of its own."""
    paper = Paper()
    notes = []
    for u in uris:
        target = paper.add(u.encode()) if apart else u.encode()
        notes.append(paper.add({"Subtype": "Link", "Rect": [0, 0, 9, 9], "A": {"S": "URI", "URI": target}}))
    return paper.page(b"", Annots=notes).table()


def stamped_pdf(pages: int, stamp: str) -> bytes:
    """Pages that all draw the same form."""
    paper = Paper()
    font = paper.add(SANS)
    form = paper.add({"Type": "XObject", "Subtype": "Form", "Resources": {"Font": {"Body": font}}}, b"BT /Body 9 Tf 9 9 Td " + write(Text(stamp.encode("cp1252", "replace"))) + b" Tj ET")
    for _ in range(pages):
        paper.page(b"/Stamp Do", resources={"XObject": {"Stamp": form}})
    return paper.table()


def text_pdf(pages: list[str], font: str = "Helvetica") -> bytes:
    """One page for each text, one line for each of its lines, in a standard font."""
    paper = Paper()
    shared = paper.add(SANS | {"BaseFont": font})
    for p in pages:
        lines = b" T* ".join(write(Text(line.encode("cp1252", "replace"))) + b" Tj" for line in p.split("\n"))
        paper.page(b"BT /F1 10 Tf 12 TL 40 800 Td " + lines + b" ET", {"F1": shared}, packed=True)
    return paper.table()


# ---- codecs the other way round


def lzw(data: bytes) -> bytes:
    """Codes of growing width; the table is cleared when it is full."""
    out, held, bits = bytearray(), 0, 0
    known: dict[bytes, int] = {}
    width, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal known, width
        put(256)
        known, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word])
        known[longer] = len(known) + 2
        width = max(9, (len(known) + 2).bit_length())
        if len(known) + 2 >= 4_094:
            clear()
        word = data[i : i + 1]
    if word:
        put(known[word])
        width = max(9, (len(known) + 3).bit_length())
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def run_lengths(data: bytes) -> bytes:
    """Runs of three and more equal bytes as such, the rest as it is."""
    out, at, plain = bytearray(), 0, bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 128):
            out.extend(bytes([len(plain[i : i + 128]) - 1]) + plain[i : i + 128])
        plain.clear()

    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        if n > 2:
            flush()
            out += bytes([257 - n, data[at]])
        else:
            plain += data[at : at + n]
        at += n
    flush()
    return bytes(out) + b"\x80"


def left_rows(data: bytes, width: int) -> bytes:
    """Rows as differences to the byte on the left, without tags (the predictor of TIFF)."""
    return np.diff(np.frombuffer(data, np.uint8).reshape(-1, width), axis=1, prepend=np.uint8(0)).tobytes()


def encoded(codec: str, data: bytes) -> tuple[list, bytes]:
    """(filters as a document names them, bytes) for a codec, or for a predictor before compression."""
    import base64

    if codec in ("Up", "Tiff"):
        parms = value({"Predictor": 12 if codec == "Up" else 2, "Columns": 16})
        padded = data + bytes(-len(data) % 16)
        return [(b"FlateDecode", parms)], zlib.compress(up_rows(padded, 16) if codec == "Up" else left_rows(padded, 16))
    forms = {
        "Flate": (b"FlateDecode", zlib.compress), "Hex": (b"ASCIIHexDecode", lambda d: d.hex().encode() + b">"), "Ascii85": (b"ASCII85Decode", lambda d: base64.a85encode(d) + b"~>"),
        "Lzw": (b"LZWDecode", lzw), "RunLength": (b"RunLengthDecode", run_lengths),
    }
    name, form = forms[codec]
    return [(name, None)], form(data)
