"""Fonts as the matcher needs them: codes to text, text to codes, widths."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache, lru_cache

from ..functions.text import BOLD, ITALIC, LIGATURES, MONO, SANS, SERIF
from .container import Document, Stream
from .syntax import BLANK, END, Dict, Keyword, Lexer, Name, PdfError, Text, integer, number

#: Advances of the standard sans and serif fonts for codes 32 to 126 (fixed values of the public metrics).
SANS_WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
SERIF_WIDTHS = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)
#: Codes of the standard encoding that differ from ASCII (fixed values of the public format).
STANDARD = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯",
    0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı",
    0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}
#: Glyph names that no rule gives (fixed values of the public glyph list).
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+",
    "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "nbspace": " ", "nonbreakingspace": " ", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦",
    "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "guillemetleft": "«", "logicalnot": "¬", "sfthyphen": "­", "softhyphen": "­", "registered": "®", "macron": "¯", "degree": "°",
    "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "middot": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»",
    "guillemetright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "AE": "Æ", "Eth": "Ð", "multiply": "×", "Oslash": "Ø", "Thorn": "Þ", "germandbls": "ß", "ae": "æ", "eth": "ð", "divide": "÷",
    "oslash": "ø", "thorn": "þ", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…",
    "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "florin": "ƒ", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ",
    "OE": "Œ", "oe": "œ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "Dcroat": "Đ", "dcroat": "đ", "circumflex": "ˆ", "tilde": "˜", "breve": "˘", "dotaccent": "˙", "ring": "˚", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ",
    "minus": "−", "lessequal": "≤", "greaterequal": "≥", "notequal": "≠", "infinity": "∞", "Delta": "∆", "apple": "",
}
#: Accents that a name may end in, as combining marks.
ACCENTS = {"grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dieresis": 0x308, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C, "cedilla": 0x327, "ogonek": 0x328}


def _component(name: str) -> str | None:
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if name in NAMED:
        return NAMED[name]
    accent = ACCENTS.get(name[1:])
    if accent and name[:1].isascii() and name[:1].isalpha():
        both = unicodedata.normalize("NFC", name[0] + chr(accent))
        return both if len(both) == 1 else None
    digits = name[3:] if name.startswith("uni") else name[1:] if name.startswith("u") else ""
    if digits and all(c in "0123456789ABCDEF" for c in digits):
        try:
            if name.startswith("uni") and len(digits) % 4 == 0:
                return bytes.fromhex(digits).decode("utf-16-be")
            if not name.startswith("uni") and 4 <= len(digits) <= 6:
                return chr(int(digits, 16)) if not 0xD800 <= int(digits, 16) < 0xE000 else None
        except (ValueError, UnicodeDecodeError):
            return None
    return None


@lru_cache(4096)
def glyph_text(name: bytes) -> str | None:
    """Text of a glyph name: parts joined by "_", any ".suffix" left off."""
    try:
        stem = name.decode().partition(".")[0]
    except UnicodeDecodeError:
        return None
    parts = [_component(p) for p in stem.split("_")]
    return "".join(parts) if stem and all(p is not None for p in parts) else None


def base_text(encoding: str, code: int) -> str | None:
    """Text of a code in the "win", "mac" or "standard" encoding."""
    if code < 32 or code == 127:
        return None
    if encoding == "standard":
        return STANDARD.get(code) or (chr(code) if code < 127 else None)
    if code < 127:
        return chr(code)
    if encoding == "mac":
        return bytes([code]).decode("mac_roman")
    if code == 0xAD:
        return "-"
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return "•"


@cache
def base_texts(encoding: str) -> dict[int, str]:
    """All codes of an encoding; who changes it needs a copy."""
    return {c: t for c in range(256) if (t := base_text(encoding, c))}


#: Signs that the fallback encoding stands others in for (fixed values).
STAND_INS = {0x2212: "-", 0x00A0: " "}


def encode_win(text: str) -> bytes | None:
    """Bytes of a text in the Windows encoding; None if it holds control characters or others that this lacks."""
    text = text.translate(STAND_INS)
    if any(c < " " or "\x7f" <= c < "\xa0" for c in text):
        return None
    try:
        return text.encode("cp1252")
    except UnicodeEncodeError:
        return None


def normal(text: str) -> str:
    """Ligatures spelt out, no-break spaces as spaces, no NULs."""
    if text.isascii() and "\0" not in text:
        return text
    return (_spelt_sign if len(text) == 1 else _spelt)(text)


def _spelt(text: str) -> str:
    for sign, letters in LIGATURES.items():
        text = text.replace(sign, letters)
    return text.replace(" ", " ").replace("\0", "")


_spelt_sign = lru_cache(4096)(_spelt)


def standard_width(family: str, ch: str) -> float:
    if family == "mono":
        return 600.0
    at = ord(ch) - 32
    table, other = (SANS_WIDTHS, 556.0) if family == "sans" else (SERIF_WIDTHS, 500.0)
    return float(table[at]) if 0 <= at < 95 else other


@dataclass(frozen=True)
class Style:
    family: str = "sans"
    bold: bool = False
    italic: bool = False

    @property
    def font(self) -> str:
        base, slant, plain = {"sans": ("Helvetica", "Oblique", ""), "mono": ("Courier", "Oblique", ""), "serif": ("Times", "Italic", "-Roman")}[self.family]
        style = ("Bold" if self.bold else "") + (slant if self.italic else "")
        return f"{base}-{style}" if style else base + plain


def style_of(name: str, flags: int, weight: float, angle: float) -> Style:
    low = name.lower()
    has = lambda words: any(w in low for w in words)
    family = "mono" if flags & 1 or has(MONO) else "sans" if has(SANS) else "serif" if flags & 2 or has(SERIF) else "sans"
    return Style(family, bool(flags & 1 << 18) or weight >= 600 or has(BOLD) or low.endswith("medi"), bool(flags & 64) or angle != 0 or has(ITALIC))


@dataclass
class CMap:
    spaces: list = field(default_factory=list)
    text: dict = field(default_factory=dict)
    vertical: bool = False


#: A code of at most four bytes and its text, in the usual form; all others go token by token.
_PAIR = re.compile(BLANK + rb"*+<((?:[0-9A-Fa-f]{2}){1,4})>" + BLANK + rb"*+<((?:[0-9A-Fa-f]{2})*+)>")


def read_cmap(data: bytes) -> CMap:
    out, lex, before = CMap(), Lexer(data), None
    code = lambda t: int.from_bytes(t.data[:4], "big")
    text = lambda t: t.data.decode("utf-16-be", "replace")
    while (token := lex.next()[0]) != END:
        if before == b"WMode" and isinstance(token, int):
            out.vertical = token == 1
        before = token if isinstance(token, Name) else None
        if not isinstance(token, Keyword) or not token.word.startswith(b"begin"):
            continue
        kind = token.word[5:]
        while kind == b"bfchar" and (m := _PAIR.match(data, lex.pos)):
            out.text[int(m[1], 16)] = bytes.fromhex(m[2].decode()).decode("utf-16-be", "replace")
            lex.pos = m.end()
        while kind in (b"codespacerange", b"bfchar", b"bfrange") and isinstance(lo := lex.next()[0], Text):
            hi = lex.next()[0]
            if kind == b"bfchar":
                if isinstance(hi, Text):
                    out.text[code(lo)] = text(hi)
                elif not isinstance(hi, Name):
                    break
                continue
            if not isinstance(hi, Text):
                break
            first, last = code(lo), code(hi)
            if kind == b"codespacerange":
                if 1 <= len(lo.data) <= 4:
                    out.spaces.append((len(lo.data), first, last))
                continue
            to = lex.next()[0]
            if isinstance(to, Text):
                base = text(to)
                for k in range(min(last - first, 0xFFFF) + 1):
                    if base and ord(base[-1]) + k < 0x110000 and not 0xD800 <= ord(base[-1]) + k < 0xE000:
                        out.text[first + k] = base[:-1] + chr(ord(base[-1]) + k)
            elif to == Keyword(b"["):
                k = first
                while (t := lex.next()[0]) not in (END, Keyword(b"]")):
                    if isinstance(t, Text):
                        if k <= last:
                            out.text[k] = text(t)
                        k += 1
            else:
                break
    return out


class Font:
    """One font of a document."""

    def __init__(self, doc: Document, d: Dict):
        self.doc, kind = doc, d.get(b"Subtype")
        self.composite = kind == b"Type0"
        below = doc.dict_of(next(iter(doc.list_of(d.get(b"DescendantFonts"))), None)) if self.composite else None
        owner = below or d
        descriptor = doc.dict_of(owner.get(b"FontDescriptor"))
        num = lambda x, key, default=0.0: default if x is None or (v := number(doc.resolve(x.get(key)))) is None else v
        flags = int(num(descriptor, b"Flags"))
        embedded = descriptor is not None and any(k in descriptor for k in (b"FontFile", b"FontFile2", b"FontFile3"))
        name = doc.resolve(d.get(b"BaseFont"))
        name = name.decode("latin-1") if isinstance(name, Name) else ""
        tagged = len(name) > 7 and name[6] == "+" and name[:6].isascii() and name[:6].isalpha() and name[:6].isupper()
        self.name = name[7:] if tagged else name
        self.style = style_of(self.name, flags, num(descriptor, b"FontWeight"), num(descriptor, b"ItalicAngle"))
        self.subset, self.opaque, self.vertical = tagged and embedded, False, False
        self.spaces, self.text, self.widths, self.default_width = [(1, 0, 255)], {}, {}, 0.0
        self.trusted: set | None = None
        self.used: set = set()
        self._codes = None
        unicode_map = self._stream_map(d.get(b"ToUnicode"))
        if self.composite:
            self._composite(d, below, unicode_map, num)
        else:
            self._simple(d, descriptor, kind, flags & 4 and not flags & 32, embedded, num)
        if unicode_map:
            self.text.update(unicode_map.text)
        self.text = {c: n for c, t in self.text.items() if (n := normal(t))}

    def _stream_map(self, value) -> CMap | None:
        value_num = getattr(value, "num", None)
        if value_num is None or not isinstance(self.doc.get(value_num), Stream):
            return None
        try:
            return read_cmap(self.doc.stream_data(value_num))
        except PdfError:
            return None

    def _composite(self, d: Dict, below: Dict | None, unicode_map: CMap | None, num) -> None:
        doc, identity = self.doc, False
        self.spaces = [(2, 0, 0xFFFF)]
        other = unicode_map.spaces if unicode_map else []
        cmap = self._stream_map(d.get(b"Encoding"))
        if cmap:
            self.spaces, self.vertical = cmap.spaces or other or self.spaces, cmap.vertical
        else:
            name = doc.resolve(d.get(b"Encoding"))
            name = name.decode("latin-1") if isinstance(name, Name) else "Identity-H"
            self.vertical, identity = name.endswith("-V"), name.startswith("Identity")
            if "UCS2" in name:
                self.text = {c: chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cc"}
            elif not identity:
                self.spaces, self.opaque = other or self.spaces, not other
        self.default_width = num(below, b"DW", 1000.0)
        widths, i = doc.list_of(below.get(b"W")) if below and identity else [], 0
        while i + 1 < len(widths) and (first := integer(doc.resolve(widths[i]))) is not None:
            second = doc.resolve(widths[i + 1])
            if isinstance(second, list):
                self.widths.update({first + k: v for k, w in enumerate(second) if (v := number(doc.resolve(w))) is not None})
                i += 2
                continue
            last, w = integer(second), number(doc.resolve(widths[i + 2])) if i + 2 < len(widths) else None
            if last is None or w is None:
                break
            self.widths.update(dict.fromkeys(range(first, min(last, first + 0xFFFF) + 1), w))
            i += 3

    def _simple(self, d: Dict, descriptor: Dict | None, kind, symbolic, embedded: bool, num) -> None:
        doc, type3 = self.doc, kind == b"Type3"
        own = type3 or self.name.lower().startswith(("symbol", "zapfdingbats")) or (symbolic and embedded)
        default = None if own else "win" if kind == b"TrueType" else "standard"
        known = {b"WinAnsiEncoding": "win", b"MacRomanEncoding": "mac", b"StandardEncoding": "standard"}
        encoding, names = doc.resolve(d.get(b"Encoding")), {}
        base = known.get(encoding) if isinstance(encoding, Name) else default
        if isinstance(encoding, Dict):
            named = doc.resolve(encoding.get(b"BaseEncoding"))
            base = known.get(named) if isinstance(named, Name) else default
            code = 0
            for item in doc.list_of(encoding.get(b"Differences")):
                item = doc.resolve(item)
                if isinstance(item, Name):
                    names[code] = item
                    code += 1
                elif integer(item) is not None:
                    code = max(0, integer(item))
        if base:
            self.text = dict(base_texts(base))
        for c, n in names.items():
            self.text.pop(c, None)
            if (t := glyph_text(n)) is not None:
                self.text[c] = t
        scale = 1.0
        if type3:
            drawn = doc.dict_of(d.get(b"CharProcs")) or Dict()
            self.trusted, self.subset = {c for c, n in names.items() if n in drawn}, True
            matrix = doc.list_of(d.get(b"FontMatrix"))
            scale = (number(doc.resolve(matrix[0])) or 0.001) * 1000 if matrix else 1.0
        self.default_width = num(descriptor, b"MissingWidth")
        widths = doc.resolve(d.get(b"Widths"))
        if isinstance(widths, list):
            first = int(num(d, b"FirstChar"))
            self.widths = {first + i: v * scale for i, w in enumerate(widths) if (v := number(doc.resolve(w))) is not None}
        else:
            self.widths = {c: standard_width(self.style.family, chr(c)) for c in range(32, 127)}
            self.default_width = standard_width(self.style.family, "n")

    # ---- use

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """(code, bytes) of every character of a string."""
        if not self.composite:
            return [(b, 1) for b in data]
        if len({size for size, _, _ in self.spaces}) == 1 and not len(data) % (size := self.spaces[0][0]):
            return [(int.from_bytes(data[i : i + size], "big"), size) for i in range(0, len(data), size)]
        out, at = [], 0
        while at < len(data):
            for n in range(1, min(4, len(data) - at) + 1):
                code = int.from_bytes(data[at : at + n], "big")
                if any(size == n and lo <= code <= hi for size, lo, hi in self.spaces):
                    break
            else:
                n = min(min((s[0] for s in self.spaces), default=1), len(data) - at)
                code = int.from_bytes(data[at : at + n], "big")
            out.append((code, n))
            at += n
        return out

    def bytes_of(self, code: int) -> bytes:
        sizes = [s for s, lo, hi in self.spaces if lo <= code <= hi]
        return code.to_bytes((min(sizes) if sizes else 2) if self.composite else 1, "big")

    def text_of(self, code: int) -> str | None:
        return None if self.opaque else self.text.get(code)

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default_width)

    def space_width(self) -> float:
        return next((w for c in sorted(self.text) if self.text[c] == " " and (w := self.width(c)) > 0), 260.0)

    def note(self, code: int) -> None:
        if code not in self.used:
            self.used.add(code)
            self._codes = None

    def usable(self, code: int) -> bool:
        return code in self.used or (code in self.trusted if self.trusted is not None else not self.subset)

    def encode(self, text: str) -> list[int | None] | None:
        """Codes for a text, longest pieces first; None inside the list is a gap for a space the font lacks."""
        if self.opaque:
            return None
        if self._codes is None:
            self._codes = {}
            for c in sorted((c for c in self.text if self.usable(c)), key=lambda c: (c not in self.used, c)):
                if "�" not in self.text[c]:
                    self._codes.setdefault(self.text[c], c)
            self._longest = max([1, *map(len, self._codes)])
        out, at = [], 0
        while at < len(text):
            for n in range(min(self._longest, len(text) - at), 0, -1):
                if (code := self._codes.get(text[at : at + n])) is not None:
                    out.append(code)
                    at += n
                    break
            else:
                if text[at] not in "  ":
                    return None
                out.append(None)
                at += 1
        return out

    def lacks(self, text: str) -> str:
        return next((c for c in text if self.encode(c) is None), "?")
