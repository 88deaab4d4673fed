"""Rule scripts: ordered search/replace rules, validated on the driver before any data is read."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, fields

LAST_PAGE = (1 << 63) - 1
TARGETS = ("text", "links")


class RuleError(ValueError):
    """A script or a rule that can't be used."""


@dataclass(frozen=True)
class RuleSpec:
    """One rule as written: ``targets`` None means both, ``pages`` None means all."""

    search: str
    replace: str
    regex: bool = False
    ignore_case: bool = False
    whole_word: bool = False
    targets: tuple[str, ...] | None = None
    pages: str | None = None

    @staticmethod
    def of(value: dict) -> RuleSpec:
        if not isinstance(value, dict):
            raise RuleError("a rule must be an object")
        known = {f.name for f in fields(RuleSpec)}
        if unknown := set(value) - known:
            raise RuleError(f"unknown key in a rule: {', '.join(sorted(unknown))}")
        for name in ("search", "replace"):
            if not isinstance(value.get(name), str):
                raise RuleError(f"a rule needs a string {name!r}")
        for name in ("regex", "ignore_case", "whole_word"):
            if not isinstance(value.get(name, False), bool):
                raise RuleError(f"{name!r} must be true or false")
        targets = value.get("targets")
        if targets is not None:
            if not isinstance(targets, list) or any(t not in TARGETS for t in targets):
                raise RuleError("'targets' must list 'text' and 'links'")
            targets = tuple(targets)
        pages = value.get("pages")
        if pages is not None and not isinstance(pages, str):
            raise RuleError("'pages' must be a string")
        return RuleSpec(value["search"], value["replace"], value.get("regex", False), value.get("ignore_case", False), value.get("whole_word", False), targets, pages)


def literal(search: str, replace: str) -> RuleSpec:
    return RuleSpec(search, replace)


def load_rules(script: str | list | dict | Iterable[RuleSpec]) -> list[RuleSpec]:
    """Rules from JSON text or from what it holds: {"rules": [...]}, a list, or {"replacements": {old: new}}.

    A map has no order: longer searches (in UTF-8 bytes) come first, equal ones bytewise."""
    if isinstance(script, str):
        try:
            script = json.loads(script)
        except ValueError as e:
            raise RuleError(f"a script must be JSON: {e}") from e
    if isinstance(script, dict):
        if "rules" in script:
            script = script["rules"]
        elif isinstance(script.get("replacements"), dict):
            pairs = [(s, r) for s, r in script["replacements"].items()]
            if any(not isinstance(r, str) for _, r in pairs):
                raise RuleError("'replacements' must map strings to strings")
            return [literal(s, r) for s, r in sorted(pairs, key=lambda p: (-len(p[0].encode()), p[0].encode()))]
        else:
            raise RuleError("a script needs 'rules' or 'replacements'")
    if not isinstance(script, (list, tuple)):
        raise RuleError("'rules' must be a list")
    return [r if isinstance(r, RuleSpec) else RuleSpec.of(r) for r in script]


def parse_pages(spec: str) -> list[tuple[int, int]]:
    """Inclusive ranges of "1-3, 7, 10-"."""

    def number(s: str) -> int:
        s = s.strip()
        if not s.removeprefix("+").isascii() or not s.removeprefix("+").isdigit():
            raise RuleError(f"invalid page range {spec!r}")
        return int(s)

    out = []
    for part in (p.strip() for p in spec.split(",")):
        if part:
            first, dash, last = part.partition("-")
            out.append((number(first), LAST_PAGE if dash and not last.strip() else number(last if dash else first)))
    if not out:
        raise RuleError("empty page range")
    return out
