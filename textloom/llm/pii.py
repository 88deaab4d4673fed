"""Personal data in whole texts, with built-in functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for IBANs) and ranges confirm
them, and words near a span raise or lower its score. Base kinds, leftmost and not overlapping within
a kind, always stay: email, ip, card, phone. Further kinds must be confirmed and stay if their score then reaches the threshold:

    iban    mod 97 leaves 1; score 1, +0.2 beside an account word, -0.3 beside a counter-word
    ssn     score 0.45, +0.5 beside an identity word, -0.3 beside a counter-word
    secret  20 signs or more with two letters and two digits; score 0.45, +0.5 beside a credential word, -0.3 beside a digest word

Positions are code points, ends exclusive. Null text counts as empty: no spans. Empty tables give no
rows; repeated rows and null ids stay as they are; other columns are ignored. Work per text is linear:
possessive patterns that start at run starts stand in for the plain ones and match the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain patterns (fixed values).
BASE_KINDS = ("email", "ip", "card", "phone")
#: The same languages without backtracking: a match starts where a run starts or the last match ended.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"[A-Za-z0-9_-]{20,}+",
}
#: A text without a match of its guard has no span of the kind that could pass.
GUARD = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "secret": r"[A-Za-z0-9_-]{20}",
}
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: What a secret holds at least.
MIXED = (r"[A-Za-z][^A-Za-z]*[A-Za-z]", r"[0-9][^0-9]*[0-9]")
NEAR = {"iban": r"(?i)iban|account|konto|compte|cuenta|bank", "ssn": r"(?i)ssn|social|security|identity|insurance", "secret": r"(?i)token|secret|passw|api.?key|credential|bearer"}
_COUNTER = r"(?i)example|sample|order|invoice|isbn|serial|version"
AGAINST = {"iban": _COUNTER, "ssn": _COUNTER, "secret": r"(?i)checksum|commit|digest|sha-?[0-9]|md5|example|sample"}
#: Score of a confirmed span, what a word for it adds and what a counter-word takes away.
SCORES = {"iban": (1.0, 0.2, 0.3), "ssn": (0.45, 0.5, 0.3), "secret": (0.45, 0.5, 0.3)}
#: So many code points before and after a span count as near.
REACH = 40
THRESHOLD = 0.6


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    signs = F.reverse(F.split(digits, ""))
    doubled = F.transform(signs, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN (without spaces) leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>>: every match of a kind with its position in code points."""
    pattern = F.lit(FAST[kind])
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, FAST[kind], -1).alias("g"))

    def place(p: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["g"])
            end = start + F.length(x["m"])
            found = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

        pairs = F.arrays_zip(p["m"].alias("m"), F.slice(p["g"], F.lit(1), F.size(p["m"])).alias("g"))
        return F.aggregate(pairs, first, step)["out"]

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(text.rlike(GUARD[kind]), let(parts, place)).otherwise(none)


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        return let(F.translate(m, " -", ""), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return let(F.translate(m, " ", ""), mod97)
    if kind == "secret":
        return m.rlike(MIXED[0]) & m.rlike(MIXED[1])
    return F.lit(True)


def score(kind: str, text: Column, x: Column) -> Column:
    """What the words around a confirmed span make of it."""
    around = F.concat_ws(" ", F.substring(text, F.greatest(x["s"] - REACH + 1, F.lit(1)), F.least(x["s"], F.lit(REACH))), F.substring(text, x["e"] + 1, F.lit(REACH)))
    own, more, less = SCORES[kind]
    return own + F.when(around.rlike(NEAR[kind]), more).otherwise(0.0) - F.when(around.rlike(AGAINST[kind]), less).otherwise(0.0)


def _test(kind: str, text: Column, threshold: float):
    if kind in BASE_KINDS:
        return lambda x: confirmed(kind, x["m"])
    return lambda x: confirmed(kind, x["m"]) & (score(kind, text, x) >= threshold)


def _label(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])


def find_spans(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, and one array<struct<s, e, m>> for each kind, named ``pii_<kind>``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for kind in FAST:
        found = spans(text, kind)
        found = F.filter(found, _test(kind, text, threshold))
        df = df.withColumn(f"pii_{kind}", found)
    return df


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``find_spans`` and ``redacted``: the text with every span, of all kinds, replaced by its kind in brackets.
    Where spans of several kinds overlap, the one that begins first hides them all up to the end of the last. Null texts stay null."""
    every = F.concat(*[F.transform(f"pii_{k}", _named(k)) for k in FAST])

    def cover(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))))
        return F.when((F.size(a) > 0) & (x["s"] < F.coalesce(last["e"], F.lit(0))), longer).otherwise(F.concat(a, F.array(x)))

    merged = F.aggregate(F.array_sort(every), F.array().cast("array<struct<s:int,e:int,kind:string>>"), cover)

    def put(p: Column) -> Column:
        # gaps before each span and after the last, cut from the signs by position
        starts = F.concat(F.array(F.lit(0)), F.transform(p["spans"], lambda x: x["e"]))
        stops = F.concat(F.transform(p["spans"], lambda x: x["s"]), F.array(F.size(p["signs"])))
        gaps = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda g: F.array_join(F.slice(p["signs"], g["a"] + 1, g["b"] - g["a"]), ""))
        marks = F.concat(F.transform(p["spans"], lambda x: F.concat(F.lit("["), x["kind"], F.lit("]"))), F.array(F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), marks.alias("m")), lambda z: F.concat(z["g"], z["m"])), "")

    text = F.col(text_col)
    hidden = let(F.struct(merged.alias("spans"), F.split(text, "").alias("signs")), put)
    return df.withColumn("redacted", F.when(F.size(every) > 0, hidden).otherwise(text))


def _named(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, sha256 of the base spans, and all spans as text."""
    found = find_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    words = lambda kinds: F.array_join(F.concat(*[F.transform(f"pii_{k}", _label(k)) for k in kinds]), ",")
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(words(BASE_KINDS), 256).alias("base_sha256"), words(FAST).alias("spans"))


def _sql() -> str:
    """The same in DuckDB's dialect, with the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "secret": r"[A-Za-z0-9_-]{20,}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"(list_sum([CASE WHEN i % 2 = 1 THEN cast({digits}[length({digits}) - i + 1] AS INT) ELSE (cast({digits}[length({digits}) - i + 1] AS INT) * 2) % 10 + (cast({digits}[length({digits}) - i + 1] AS INT) * 2) // 10 END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0)"
    moved = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4])"
    mod = f"(list_reduce([CASE WHEN {moved}[i] BETWEEN '0' AND '9' THEN cast({moved}[i] AS INT) ELSE ascii({moved}[i]) - 55 END FOR i IN range(1, length({moved}) + 1)], lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END, 0) = 1)"
    around = f"(text[greatest(s - {REACH} + 1, 1):s] || ' ' || text[e + 1:e + {REACH}])"

    def worth(kind: str) -> str:
        own, more, less = SCORES[kind]
        return f"{own} + CASE WHEN regexp_matches({around}, '{NEAR[kind]}') THEN {more} ELSE 0 END - CASE WHEN regexp_matches({around}, '{AGAINST[kind]}') THEN {less} ELSE 0 END >= {THRESHOLD}"

    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (ltrim(x, '0') <> '' AND cast(ltrim(x, '0') AS HUGEINT) > 255))) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"{mod} AND {worth('iban')}",
        "ssn": worth("ssn"),
        "secret": f"regexp_matches(m, '{MIXED[0]}') AND regexp_matches(m, '{MIXED[1]}') AND {worth('secret')}",
    }
    found = " UNION ALL ".join(
        f"SELECT row, {n} AS n, '{k}' AS kind, s, e FROM (SELECT row, text, unnest(m) AS m, unnest(starts) AS s, unnest(ends) AS e FROM (SELECT row, text, m,"
        f" [coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) FOR i IN range(1, len(m) + 1)] AS starts,"
        f" [coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i]]), 0) FOR i IN range(1, len(m) + 1)] AS ends"
        f" FROM (SELECT row, text, regexp_extract_all(text, '{plain[k]}') AS m, regexp_split_to_array(text, '{plain[k]}') AS g FROM docs))) WHERE {keep[k]}"
        for n, k in enumerate(FAST)
    )
    counts = ", ".join(f"coalesce(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END), 0)::BIGINT AS n_{k}" for k in BASE_KINDS)
    join = lambda where: f"coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY n, s){where}, '')"
    return f"WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}) SELECT docs.doc_id, {counts}, sha256({join(' FILTER (WHERE n < 4)')}) AS base_sha256, {join('')} AS spans FROM docs LEFT JOIN found USING (row) GROUP BY docs.row, docs.doc_id"


ORACLE_SQL = _sql()
