"""Scalar functions of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures that stand for several letters (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Keywords of font names by family (fixed values).
MONO = ("courier", "mono", "consolas", "menlo", "typewriter", "cmtt")
SANS = ("sans", "helvetica", "arial", "calibri", "verdana", "tahoma", "roboto", "cmss")
SERIF = (
    "times", "serif", "georgia", "garamond", "roman", "minion", "cambria", "palatino", "book", "cmr", "cmbx",
    "cmti", "sfrm", "century", "baskerville", "caslon", "charter", "nimbusrom", "libertine",
)
BOLD = ("bold", "black", "heavy", "cmbx", "-bd", "demi", "medi-")
ITALIC = ("italic", "oblique", "cmti", "-it")


def normalize(text: Column) -> Column:
    """Ligatures spelt out, no-break spaces as spaces, no NULs."""
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return F.translate(text, " \u0000", " ")


def short_number(value: Column) -> Column:
    """At most four decimals, without trailing zeros and without a negative zero."""
    text = F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)


def text_string(data: Column) -> Column:
    """A document's text string: UTF-16 or UTF-8 by its mark, else Latin-1."""
    head2, head3 = F.hex(F.substring(data, 1, 2)), F.hex(F.substring(data, 1, 3))
    rest = lambda n: F.substr(data, F.lit(n))
    return F.when(head2 == "FEFF", F.decode(rest(3), "UTF-16BE")).when(head3 == "EFBBBF", F.decode(rest(4), "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))


def without_subset_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+(?=.)", "")


def font_style(name: Column, flags: Column | None = None) -> tuple[Column, Column, Column]:
    """(family, bold, italic) guessed from a font's name and flags."""
    low = F.lower(without_subset_tag(name))
    flags = F.lit(0) if flags is None else flags
    has = lambda words: low.rlike("|".join(w.replace("-", r"\-") for w in words))
    bit = lambda n: flags.bitwiseAND(F.lit(n)) != 0
    family = F.when(bit(1) | has(MONO), "mono").when(has(SANS), "sans").when(bit(2) | has(SERIF), "serif").otherwise("sans")
    return family, bit(1 << 18) | has(BOLD) | low.endswith("medi"), bit(64) | has(ITALIC)


def standard_font(family: Column, bold: Column, italic: Column) -> Column:
    """The standard font of a style."""
    names = {"sans": ("Helvetica", "Oblique", ""), "mono": ("Courier", "Oblique", ""), "serif": ("Times", "Italic", "-Roman")}
    out = F.lit(None).cast("string")
    for key, (base, slant, plain) in names.items():
        style = F.concat(F.when(bold, "Bold").otherwise(""), F.when(italic, slant).otherwise(""))
        out = F.when(family == key, F.when(style == "", base + plain).otherwise(F.concat(F.lit(base + "-"), style))).otherwise(out)
    return out
