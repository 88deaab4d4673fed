"""PDF objects: values, tokens, parser, serializer.

Values are None, bool, int, bytes-preserving Real, Name, Text, list, Dict (ordered, first key wins) and Ref.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

SPACE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
MAX_DEPTH = 200


class PdfError(ValueError):
    """A document that can't be read as asked."""


class Name(bytes):
    """A name without its slash."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"/{self.decode('latin-1')}"


@dataclass(frozen=True)
class Real:
    """A number kept as it was written."""

    raw: bytes

    @property
    def value(self) -> float:
        return lenient_float(self.raw) or 0.0


@dataclass(frozen=True)
class Text:
    """A string and how it was written."""

    data: bytes
    hex: bool = False


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Dict:
    """An association list: order kept, the first of several equal keys counts."""

    items: list = field(default_factory=list)

    def get(self, key: bytes, default=None):
        for k, v in self.items:
            if k == key:
                return v
        return default

    def __contains__(self, key: bytes) -> bool:
        for k, _ in self.items:
            if k == key:
                return True
        return False

    def set(self, key: bytes, value) -> None:
        for i, (k, _) in enumerate(self.items):
            if k == key:
                self.items[i] = (k, value)
                return
        self.items.append((Name(key), value))

    def drop(self, key: bytes) -> None:
        self.items = [(k, v) for k, v in self.items if k != key]


@dataclass(frozen=True)
class Keyword:
    word: bytes


END = Keyword(b"")


def lenient_float(raw: bytes) -> float | None:
    """Numbers as damaged writers put them: several signs, several points, trailing rubbish."""
    m = re.match(rb"[+-]*", raw)
    sign = -1.0 if b"-" in m[0] else 1.0
    body = re.match(rb"\d*\.?\d*", raw[m.end() :])[0]
    if not body.strip(b"."):
        return None
    return sign * float(body)


def number(value) -> float | None:
    if isinstance(value, bool):
        return None
    return float(value) if isinstance(value, int) else value.value if isinstance(value, Real) else None


def integer(value) -> int | None:
    n = number(value)
    return None if n is None else int(n)


#: Parts of patterns: a sign of a word, and a blank or comment.
WORD, BLANK = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]", rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)"
#: What may stand before a token, and the token: a word, a name, a plain string, a bracket, the start of any other string, a hex string; none at the end.
_TOKEN = re.compile(BLANK + rb"*+(?:(" + WORD + rb"++)|/(" + WORD + rb"*+)|\(([^()\\\r]*+)\)|(<<|>>|[\[\]{})>])|(\()|<([^>]*+>?))?")
_REFERENCE = re.compile(BLANK + rb"*+([+-]?\d++)" + BLANK + rb"++R(?!" + WORD + rb")")
_INT = re.compile(rb"[+-]?\d+\Z")
_REAL = re.compile(rb"[+-]*[\d.+-]*\d[\d.+-]*\Z")
_PLAIN = re.compile(rb"[^()\\\r]+")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_HEX_CODE = re.compile(rb"#([0-9A-Fa-f]{2})")
_NO_HEX = re.compile(rb"[^0-9A-Fa-f]")
_SIGNS = {w: Keyword(w) for w in (b"<<", b">>", b"[", b"]", b"{", b"}", b")", b">")}
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Lexer:
    """Tokens with their byte ranges: ints, Reals, Names, Texts and Keywords (also for brackets)."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def next(self) -> tuple[object, int, int]:
        m = _TOKEN.match(self.data, self.pos)
        kind, end = m.lastindex, m.end()
        self.pos = end
        if kind == 1:
            return (_short_word if end - m.start(1) <= 16 else _word)(m[1]), m.start(1), end
        if kind == 2:
            name = m[2]
            return Name(_HEX_CODE.sub(lambda x: bytes([int(x[1], 16)]), name) if b"#" in name else name), m.start(2) - 1, end
        if kind == 4:
            return _SIGNS[m[4]], m.start(4), end
        if kind == 3:
            return Text(m[3]), m.start(3) - 1, end
        if kind == 6:
            digits = _NO_HEX.sub(b"", m[6])
            return Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), True), m.start(6) - 1, end
        if kind == 5:
            out, self.pos = self._literal(end)
            return out, end - 1, self.pos
        return END, end, end

    def token(self):
        """The next token without its range."""
        m = _TOKEN.match(self.data, self.pos)
        kind = m.lastindex
        if kind == 1:
            self.pos = m.end()
            return (_short_word if len(word := m[1]) <= 16 else _word)(word)
        if kind == 4:
            self.pos = m.end()
            return _SIGNS[m[4]]
        if kind == 2 and b"#" not in m[2]:
            self.pos = m.end()
            return Name(m[2])
        return self.next()[0]

    def _literal(self, at: int) -> tuple[Text, int]:
        data, out, depth = self.data, bytearray(), 1
        while at < len(data):
            m = _PLAIN.match(data, at)
            if m:
                out += m[0]
                at = m.end()
                continue
            c = data[at]
            at += 1
            if c == ord("("):
                depth += 1
            elif c == ord(")"):
                depth -= 1
                if not depth:
                    break
            elif c == 13:  # any line end counts as a line feed
                at += data[at : at + 1] == b"\n"
                out.append(10)
                continue
            elif c == ord("\\"):
                m = _OCTAL.match(data, at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif data[at : at + 1] in (b"\r", b"\n"):
                    at += 2 if data[at : at + 2] == b"\r\n" else 1
                elif at < len(data):
                    out.append(_ESCAPES.get(data[at], data[at]))
                    at += 1
                continue
            out.append(c)
        return Text(bytes(out)), at


def _word(word: bytes):
    if word.isdigit() or _INT.match(word):
        value = int(word)
        return value if -(1 << 63) <= value < 1 << 63 else Real(word)
    return Real(word) if _REAL.match(word) else Keyword(word)


_short_word = lru_cache(4096)(_word)


def parse(lex: Lexer):
    return parse_from(lex, lex.token())


def parse_from(lex: Lexer, token, depth: int = 0):
    """A value from its first token on; stray keywords count as null."""
    if depth > MAX_DEPTH:
        raise PdfError("objects are nested too deeply")
    if isinstance(token, Keyword):
        if token.word == b"[":
            out = []
            while True:
                token = lex.token()
                if token is END or token is _SIGNS[b"]"]:
                    return out
                if isinstance(token, Keyword) and token.word not in (b"[", b"<<", b"true", b"false", b"null"):
                    continue
                out.append(parse_from(lex, token, depth + 1))
        if token.word == b"<<":
            items = []
            while True:
                token = lex.token()
                if token is END or token is _SIGNS[b">>"]:
                    return Dict(items)
                if not isinstance(token, Name):
                    continue
                before = lex.pos
                value = lex.token()
                if isinstance(value, (Name, Text)):
                    items.append((token, value))
                    continue
                if value is _SIGNS[b">>"]:
                    lex.pos = before
                    items.append((token, None))
                    continue
                items.append((token, parse_from(lex, value, depth + 1)))
        if token == END:
            raise PdfError("unexpected end of data")
        return {b"true": True, b"false": False}.get(token.word)
    if isinstance(token, int) and not isinstance(token, bool) and token >= 0:
        m = _REFERENCE.match(lex.data, lex.pos)
        if m and 0 <= (gen := int(m[1])) <= 65_535:
            lex.pos = m.end()
            return Ref(token, gen)
    return token


def short(value: float) -> bytes:
    """At most four decimals, without trailing zeros."""
    text = f"{value:.4f}".rstrip("0").rstrip(".")
    return b"0" if text in ("-0", "") else text.encode()


_TO_ESCAPE = re.compile(rb"[\\()]")
_TO_CODE = re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")


def write_text(value: Text) -> bytes:
    if value.hex:
        return b"<" + value.data.hex().upper().encode() + b">"
    body = _TO_ESCAPE.sub(lambda m: b"\\" + m[0], value.data)
    return b"(" + body.replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def write(value) -> bytes:
    """The compact form of a value."""
    if isinstance(value, Name):
        return b"/" + _TO_CODE.sub(lambda m: b"#%02X" % m[0][0], value)
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return short(value)
    if isinstance(value, Real):
        return value.raw
    if isinstance(value, Text):
        return write_text(value)
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    parts = [write(v) for v in value] if isinstance(value, list) else [p for k, v in value.items for p in (write(Name(k)), write(v))]
    out = bytearray()
    for p in parts:
        if p[:1] not in DELIMITERS_SET and out and out[-1:] not in (b"]", b">", b")"):
            out += b" "
        out += p
    return b"[" + bytes(out) + b"]" if isinstance(value, list) else b"<<" + bytes(out) + b">>"


DELIMITERS_SET = {bytes([c]) for c in DELIMITERS}
