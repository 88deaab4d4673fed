"""Rule patterns in the dialects that run them.

Rules are written in a linear-time dialect: Unicode classes and case folding, ``(?P<name>...)`` groups, ``$`` only at
the very end, no look-around, no back-references, templates with ``$1``, ``${name}`` and ``$$``. They
run as Java patterns inside Spark, or as Python patterns where Java's treatment of empty matches differs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from .spec import RuleError, RuleSpec, parse_pages

_META = re.compile(r"[\\.+*?()|\[\]{}^$#&\-~]")


def quote(text: str) -> str:
    return _META.sub(lambda m: "\\" + m[0], text)


@dataclass(frozen=True)
class Pattern:
    """One pattern: as written, for Java, for Python; group names in order; whether it can match nothing."""

    source: str
    java: str
    python: str
    groups: tuple[str | None, ...]
    may_be_empty: bool

    def compiled(self) -> regex.Pattern:
        return regex.compile(self.python, regex.V0)


@dataclass(frozen=True)
class Rule:
    """A rule ready to run."""

    spec: RuleSpec
    text: Pattern
    link: Pattern
    on_text: bool
    on_links: bool
    pages: tuple[tuple[int, int], ...] | None

    def applies_to(self, page: int) -> bool:
        return self.pages is None or any(a <= page <= b for a, b in self.pages)

    def template(self, pattern: Pattern) -> list[str | int]:
        """The replacement as literal strings and group numbers."""
        return parse_template(self.spec.replace, pattern.groups) if self.spec.regex else [self.spec.replace]


def translate(source: str, ignore_case: bool = False) -> Pattern:
    java, python, groups, i, depth_class = [], [], [], 0, 0
    multi_line = False
    both = lambda s: (java.append(s), python.append(s))
    while i < len(source):
        c = source[i]
        if c == "\\":
            nxt = source[i + 1 : i + 2]
            if nxt.isdigit() and nxt != "0" or nxt == "k":
                raise RuleError(f"back-references are not supported: {source!r}")
            if nxt == "z":
                java.append(r"\z"), python.append(r"\Z")
            elif nxt in "<>" and not depth_class:
                raise RuleError(f"unsupported escape \\{nxt}: {source!r}")
            elif nxt in "pP" and source[i + 2 : i + 3] == "{":
                end = source.find("}", i)
                if end < 0:
                    raise RuleError(f"unclosed property: {source!r}")
                java.append(source[i : end + 1].replace("{Greek}", "{IsGreek}").replace("{Latin}", "{IsLatin}").replace("{Cyrillic}", "{IsCyrillic}"))
                python.append(source[i : end + 1])
                i = end + 1
                continue
            elif nxt == "x" and source[i + 2 : i + 3] == "{":
                end = source.find("}", i)
                java.append(source[i : end + 1]), python.append(regex.escape(chr(int(source[i + 3 : end], 16))))
                i = end + 1
                continue
            else:
                both(source[i : i + 2])
            i += 2
        elif depth_class:
            if c == "[" and source[i : i + 2] == "[:":
                raise RuleError(f"bracket classes are not supported: {source!r}")
            if source[i : i + 2] in ("--", "~~") and source[i + 2 : i + 3] != "]":
                raise RuleError(f"class operators are not supported: {source!r}")
            depth_class += (c == "[") - (c == "]")
            if c == "&" and source[i : i + 2] == "&&":
                raise RuleError(f"class operators are not supported: {source!r}")
            both(c)
            i += 1
        elif c == "[":
            depth_class = 1
            both(c)
            i += 1
            if source[i : i + 1] == "^":
                both("^")
                i += 1
            if source[i : i + 1] == "]":
                both(r"\]")
                i += 1
        elif c == "(":
            if source[i : i + 2] == "(?":
                name = re.match(r"\(\?P?<([A-Za-z_]\w*)>", source[i:])
                flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", source[i:])
                if name:
                    groups.append(name[1])
                    both("(")
                    i += len(name[0])
                elif flags:
                    if set(flags[1]) - set("imsxuU") or "U" in flags[1] or (flags[2] and set(flags[2][1:]) - set("ims")):
                        raise RuleError(f"unsupported flags: {source!r}")
                    multi_line |= "m" in flags[1]
                    both(flags[0].replace("u", ""))
                    i += len(flags[0])
                else:
                    raise RuleError(f"look-around is not supported: {source!r}")
            else:
                groups.append(None)
                both("(")
                i += 1
        elif c == "$":
            java.append("$" if multi_line else r"\z"), python.append("$" if multi_line else r"\Z")
            i += 1
        elif c in "*+?}" and source[i + 1 : i + 2] == "+":
            raise RuleError(f"a repeated repetition: {source!r}")
        else:
            both(c)
            i += 1
    flags = "i" if ignore_case else ""
    out_java = f"(?dU{flags})" + "".join(java)
    out_python = (f"(?{flags})" if flags else "") + "".join(python)
    try:
        regex.compile(out_python, regex.V0)
        width = re._parser.parse(re.sub(r"\\[pP]\{[^}]*\}", "x", out_python)).getwidth()[0]
    except (regex.error, re.error, OverflowError) as e:
        raise RuleError(f"invalid search pattern {source!r}: {e}") from e
    return Pattern(source, out_java, out_python, tuple(groups), width == 0)


def parse_template(template: str, groups: tuple[str | None, ...]) -> list[str | int]:
    """Literal strings and group numbers. A name is the longest run of letters, digits and underscores; unknown groups are empty."""
    out: list[str | int] = []
    at = 0
    for m in re.finditer(r"\$(?:(\$)|\{([^{}]*)\}|([0-9A-Za-z_]+))", template):
        out.append(template[at : m.start()])
        at = m.end()
        if m[1]:
            out.append("$")
            continue
        name = m[2] if m[2] is not None else m[3]
        if name.isascii() and name.isdigit():
            if int(name) <= len(groups):
                out.append(int(name))
        elif name in groups:
            out.append(groups.index(name) + 1)
    out.append(template[at:])
    return [x for x in out if x != ""]


def java_template(parts: list[str | int]) -> str:
    """For Java: a digit after a group must not be read as part of its number."""
    out = ""
    for n, x in enumerate(parts):
        if isinstance(x, int):
            out += f"${x}"
        else:
            text = re.sub(r"[\\$]", lambda m: "\\" + m[0], x)
            out += "\\" + text if n and isinstance(parts[n - 1], int) and text[:1].isdigit() else text
    return out


def expand(parts: list[str | int], match: regex.Match) -> str:
    return "".join(x if isinstance(x, str) else match[x] or "" for x in parts)


def compile_rule(spec: RuleSpec) -> Rule:
    if not spec.search:
        raise RuleError('a rule has an empty "search" string')
    wrap = (lambda p: rf"\b(?:{p})\b") if spec.whole_word else (lambda p: p)
    if spec.regex:
        text = link = translate(wrap(spec.search), spec.ignore_case)
    else:
        words = spec.search.split()
        relaxed = r"\s+".join(map(quote, words))
        if spec.search[0].isspace():
            relaxed = r"\s+" + relaxed
        if spec.search[-1].isspace() and words:
            relaxed += r"\s+"
        text, link = translate(wrap(relaxed), spec.ignore_case), translate(wrap(quote(spec.search)), spec.ignore_case)
    targets = ("text", "links") if spec.targets is None else spec.targets
    return Rule(spec, text, link, "text" in targets, "links" in targets, None if spec.pages is None else tuple(parse_pages(spec.pages)))


def compile_rules(specs: list[RuleSpec]) -> list[Rule]:
    return [compile_rule(s) for s in specs]
