"""Chat formatting with built-in functions only.

Records of different layouts become canonical turns: a declarative mapping names the nested field paths that it reads, and those of them
that a record has are hashed. The mapping whose own fingerprint that is applies (the first in the list, if several do); other
fields of a record don't disturb it and are listed as unknown. Turns are
then put into a template whose markers can't occur inside texts: ``\\``, ``<`` and ``[`` are each followed by a
backslash in escaped text, so neither the template's markers nor foreign control strings like ``</s>``
or ``[INST]`` survive unescaped, and unescaping restores every text exactly. Texts of the trained roles lie under
the loss mask, an array of (start, length) spans in code points.

Null texts and roles count as empty, values of other kinds as their JSON. Records of an unknown layout have null turns, an empty list of
messages has none. Turns with the same number are ordered by role and text, repeated rows are turns of their own. A null
conversation id is a conversation of its own. An empty table gives the control conversation only. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where turns are: either a list of objects (``list``, with the names of role and text fields),
    or ``fields``: (role, field) pairs, of which empty ones are left out."""

    name: str
    list: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        """The field paths that it reads, in order."""
        return sorted([f"{self.list}[].{self.role}", f"{self.list}[].{self.text}"] if self.list else [f for _, f in self.fields])


OTHER_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("messages", "messages"),
    Mapping("turns", "turns", text="text"),
    Mapping("sharegpt", "conversations", "from", "value", roles=OTHER_ROLES),
    Mapping("alpaca", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_response", fields=(("user", "instruction"), ("assistant", "response"))),
    Mapping("system_prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)


#: How deep objects may be nested in a record for its own fields to be told from theirs.
DEPTH = 8


def _names(schema: Column) -> Column:
    """Names of the fields of an object, from its schema in words."""
    inner = F.regexp_replace(schema, r"^OBJECT<|>$", "")
    for _ in range(DEPTH):
        inner = F.regexp_replace(inner, "<[^<>]*>", "")
    found = F.regexp_extract_all(inner, F.lit("(?:^|, )([^:,]+): "), F.lit(1))
    return F.when(schema.startswith("OBJECT<"), found).otherwise(F.array().cast("array<string>"))


def _inside(name: str):
    return lambda f: F.concat(F.lit(f"{name}[]."), f)


def field_paths(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Sorted paths of a variant: its fields, and those of the objects in each list that a mapping reads. An empty list
    is taken to hold objects of any kind."""
    out = [_names(F.schema_of_variant(record))]
    for name in sorted({m.list for m in mappings if m.list}):
        kind = F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant"))
        inner = F.transform(_names(F.regexp_replace(kind, "^ARRAY<(.*)>$", "$1")), _inside(name))
        known = sorted({p for m in mappings if m.list == name for p in m.paths})
        out.append(F.when(kind.rlike("^ARRAY<(?:VOID)?>$"), F.array(*map(F.lit, known))).when(kind.startswith("ARRAY<OBJECT<"), inner).otherwise(F.array().cast("array<string>")))
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in out])))


def fingerprint(paths: Column) -> Column:
    """Hash of sorted field paths."""
    return F.sha2(F.array_join(paths, "\n"), 256)


def unknown_paths(paths: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Paths that no mapping reads, nor holds what one reads."""
    known = sorted({p for m in mappings for p in m.paths} | {m.list for m in mappings if m.list})
    return F.array_except(paths, F.array(*map(F.lit, known)))


def _renamed(m: Mapping):
    def use(x: Column) -> Column:
        role = F.coalesce(x[m.role], F.lit(""))
        named = role
        for old, new in m.roles.items():
            named = F.when(role == old, new).otherwise(named)
        return F.struct(named.alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text"))

    return use


def canonical_turns(record: Column, paths: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The turns of a variant record by the mapping that its fingerprint selects; null if there is none."""
    out = F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        if m.list:
            kind = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
            turns = F.transform(F.try_variant_get(record, f"$.{m.list}", kind), _renamed(m))
        else:
            each = [F.struct(F.lit(r).alias("role"), F.coalesce(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")).alias("text")) for r, f in m.fields]
            turns = F.filter(F.array(*each), lambda x: (x["text"] != "") | (x["role"] == "assistant"))
        read = F.array_intersect(paths, F.array(*map(F.lit, m.paths)))
        out = F.when(fingerprint(read) == hashlib.sha256("\n".join(m.paths).encode()).hexdigest(), turns).otherwise(out)
    return out


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_turns(turns: Column, trained: tuple[str, ...] = ("assistant",)) -> tuple[Column, Column]:
    """(formatted string, loss mask) of an array of turns."""
    escaped = F.transform(turns, lambda t: F.struct(escape(t["role"]).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*trained).alias("loss")))
    whole = F.array_join(F.transform(escaped, lambda x: F.concat(F.lit(TURN), x["head"], F.lit(BODY), x["body"], F.lit(END))), "")
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.lit(len(TURN) + len(BODY)) + F.length(x["head"])
        size = F.length(x["body"])
        here = F.when(x["loss"], F.array(F.struct(start.alias("start"), size.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((start + size + len(END)).alias("at"), F.concat(a["spans"], here).alias("spans"))

    return whole, F.aggregate(escaped, first, step)["spans"]


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|turn\|>", -1)) - 1, F.lit(0)))
    cut = lambda p: F.split(F.substring(p, F.lit(1), F.length(p) - len(END)), r"<\|text\|>", 2)
    return F.transform(pieces, lambda p: F.struct(unescape(cut(p)[0]).alias("role"), unescape(cut(p)[1]).alias("text")))


def format_records(df: DataFrame, record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All columns, and ``layout`` (fingerprint of all paths), ``unknown`` (paths that no mapping reads), ``turns``, ``formatted``, ``loss_spans``."""
    df = df.withColumn("_paths", field_paths(record, mappings))
    df = df.withColumn("layout", fingerprint(F.col("_paths"))).withColumn("unknown", unknown_paths(F.col("_paths"), mappings))
    df = df.withColumn("turns", canonical_turns(record, F.col("_paths"), mappings)).drop("_paths")
    whole, spans = format_turns(F.col("turns"))
    return df.withColumn("formatted", whole).withColumn("loss_spans", spans)


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): one variant record for each conversation of a table with a row for each turn. By the id it is of one of
    three layouts: messages, turns, or messages with further fields."""
    rows = rows.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    plain = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    other = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("text")))
    more = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), F.struct(t["turn"].alias("number")).alias("meta")))
    which = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0))
    layouts = (
        F.to_variant_object(F.struct(plain.alias("messages"))), F.to_variant_object(F.struct(other.alias("turns"))),
        F.to_variant_object(F.struct(F.col("conv_id").alias("id"), more.alias("messages"), F.struct(F.lit("table").alias("kind")).alias("origin"))),
    )
    return whole.select("conv_id", F.when(which == 0, layouts[0]).when(which == 1, layouts[1]).otherwise(layouts[2]).alias("record"))


def chat_digest(rows: DataFrame) -> DataFrame:
    """Formats every conversation and one more, -1, of control strings; digests of what the output reads back to."""
    spark = rows.sparkSession
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    out = format_records(from_rows(rows), F.col("record")).select("conv_id", "formatted", "loss_spans")
    lines = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    out = out.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), lines.alias("lines"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = r"length(regexp_replace({c}, '([\\<\[])', '\1\\', 'g'))"
ORACLE_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum({len(TURN) + len(BODY) + len(END)} + {_ESCAPED.format(c='role')} + {_ESCAPED.format(c='text')})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
