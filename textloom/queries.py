"""Registered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import matches as M
from .operators import rewrite as R
from .operators import shapes as S
from .rules.spec import RuleSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query, with SQL where there is any."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


CHAIN = [
    RuleSpec("of the", "OF-THE"),
    RuleSpec(r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", "$2 at $1", regex=True),
    RuleSpec("license", "LICENCE", ignore_case=True),
    RuleSpec("OF-THE", "of_the"),
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rewrite(table(spark, sf_dir, "documents"), CHAIN).select("doc_id", "new_text", "changed")


def _rewritten(spark, sf_dir, *rules) -> DataFrame:
    out = R.rewrite(table(spark, sf_dir, "documents"), list(rules))
    return out.select("doc_id", "new_text", "changed", F.col("hits")[0].alias("hits"))


def _oracle(pattern: str, new: str, flags: str = "") -> str:
    return f"SELECT doc_id, regexp_replace(text, '{pattern}', '{new}', 'g{flags}') AS new_text, regexp_replace(text, '{pattern}', '{new}', 'g{flags}') <> text AS changed, len(regexp_extract_all(text, '{'(?i)' if flags else ''}{pattern}')) AS hits FROM documents"


@query("q01_literal", "SELECT doc_id, replace(text, 'and', 'AND') AS new_text, replace(text, 'and', 'AND') <> text AS changed, ((length(text) - length(replace(text, 'and', ''))) / 3)::BIGINT AS hits FROM documents")
def q01(spark, sf_dir):
    """Literal text rule."""
    return _rewritten(spark, sf_dir, RuleSpec("and", "AND"))


@query("q02_relaxed_space", _oracle(r"of\s+the", "OF THE"))
def q02(spark, sf_dir):
    """Literal rule whose spaces match any run of white space."""
    return _rewritten(spark, sf_dir, RuleSpec("of the", "OF THE"))


@query("q03_groups", _oracle(r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", r"\2 at \1"))
def q03(spark, sf_dir):
    """Regular expression with groups in the template."""
    return _rewritten(spark, sf_dir, RuleSpec(r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", "$2 at ${1}", regex=True))


@query("q04_ignore_case", _oracle("license", "LICENCE", "i"))
def q04(spark, sf_dir):
    """Case-insensitive literal."""
    return _rewritten(spark, sf_dir, RuleSpec("license", "LICENCE", ignore_case=True))


#: A sign that is part of no word, and one pass of a whole-word rule; neighbours share such a sign, so it takes two passes.
_NO_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_whole = lambda text: rf"regexp_replace({text}, '(^|{_NO_WORD})the($|{_NO_WORD})', '\1THE\2', 'g')"


@query("q05_whole_word", f"SELECT doc_id, {_whole(_whole('text'))} AS new_text FROM documents")
def q05(spark, sf_dir):
    """Whole words in any script."""
    return R.rewrite(table(spark, sf_dir, "documents"), [RuleSpec("the", "THE", whole_word=True)]).select("doc_id", "new_text")


def _chain_sql(text: str) -> str:
    out = rf"regexp_replace({text}, 'of\s+the', 'OF-THE', 'g')"
    out = rf"regexp_replace({out}, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', '\2 at \1', 'g')"
    return f"replace(regexp_replace({out}, 'license', 'LICENCE', 'gi'), 'OF-THE', 'of_the')"


@query("q06_chain", f"SELECT doc_id, {_chain_sql('text')} AS new_text, {_chain_sql('text')} <> text AS changed FROM documents")
def q06(spark, sf_dir):
    """A chain of rules, each on what the one before it wrote."""
    return flagship(spark, sf_dir)


@query("q07_pages", "SELECT conv_id, turn, CASE WHEN turn + 1 BETWEEN 1 AND 2 OR turn + 1 = 4 OR turn + 1 >= 6 THEN replace(text, 'the', 'THE') ELSE text END AS new_text FROM conversations")
def q07(spark, sf_dir):
    """Page ranges."""
    turns = table(spark, sf_dir, "conversations").withColumn("page", F.col("turn") + 1)
    return R.rewrite(turns, [RuleSpec("the", "THE", pages="1-2, 4, 6-")], page_col="page").select("conv_id", "turn", "new_text")


@query("q08_link_rules", "SELECT page_id, replace(url, '://', '+secure://') AS new_uri, replace(url, '://', '+secure://') <> url AS changed FROM pages")
def q08(spark, sf_dir):
    """Link rule; page ranges don't bind it."""
    return R.rewrite_links(table(spark, sf_dir, "pages"), [RuleSpec("://", "+secure://", pages="7", targets=("links",))], "url").select("page_id", "new_uri", "changed")


@query("q09_links", """SELECT page_id, (unnest(generate_series(1, len(l))) - 1)::INT AS ord, unnest(l) AS uri FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def q09(spark, sf_dir):
    """Links in order."""
    return R.extract_links(table(spark, sf_dir, "pages"), "html", ["page_id"])


@query("q10_rule_stats", r"SELECT 0 AS rule_idx, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS matches, count(*) FILTER (WHERE contains(text, 'the')) AS rows FROM documents UNION ALL SELECT 1, sum(len(regexp_extract_all(replace(text, 'the', 'that'), 'that')))::BIGINT, count(*) FILTER (WHERE contains(replace(text, 'the', 'that'), 'that')) FROM documents")
def q10(spark, sf_dir):
    """Totals by rule, the second counted on the first one's output."""
    return R.rule_stats(R.rewrite(table(spark, sf_dir, "documents"), [RuleSpec("the", "that"), RuleSpec("that", "THAT")]))


@query("q11_changed_by_language", "SELECT lang, count(*) FILTER (WHERE contains(text, 'the')) AS changed, count(*) AS docs FROM documents GROUP BY lang")
def q11(spark, sf_dir):
    """Changed documents by language."""
    out = R.rewrite(table(spark, sf_dir, "documents"), [RuleSpec("the", "THE")])
    return out.groupBy("lang").agg(F.count_if("changed").alias("changed"), F.count(F.lit(1)).alias("docs"))


@query("q12_untouched", "SELECT doc_id, md5(text) AS before, md5(text) AS after FROM documents WHERE NOT contains(text, 'the')")
def q12(spark, sf_dir):
    """What no rule matches stays as it was."""
    out = R.rewrite(table(spark, sf_dir, "documents"), [RuleSpec("the", "THE")]).where("not changed")
    return out.select("doc_id", F.md5("text").alias("before"), F.md5("new_text").alias("after"))


@query("q13_dump", "SELECT conv_id, turn, concat('=== page ', turn + 1, ' ===', chr(10), text, chr(10)) AS dump FROM conversations")
def q13(spark, sf_dir):
    """Text dump with page labels."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("=== page "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), "text", F.lit("\n")).alias("dump"))


_PREFIX = "list_max(list_filter(range(0, least(length({a}), length({b}))::BIGINT + 1), lambda n: left({a}, n) = left({b}, n)))"


@query(
    "q14_minimal_edit",
    f"WITH p AS (SELECT p_partkey, a, b, {_PREFIX.format(a='a', b='b')} AS f FROM (SELECT p_partkey, p_name AS a, replace(p_name, 'e', 'ee') AS b FROM part)), "
    f"q AS (SELECT *, reverse(substr(a, f + 1)) AS ra, reverse(substr(b, f + 1)) AS rb FROM p) "
    f"SELECT p_partkey, f::INT AS keep_front, {_PREFIX.format(a='ra', b='rb')}::INT AS keep_back, substr(b, f + 1, length(b) - f - {_PREFIX.format(a='ra', b='rb')}) AS edit_text FROM q",
)
def q14(spark, sf_dir):
    """The smallest edit between a string and its replacement."""
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("old"), F.replace("p_name", F.lit("e"), F.lit("ee")).alias("new"))
    return M.minimal_edit(pairs, "old", "new").select("p_partkey", "keep_front", "keep_back", "edit_text")


@query(
    "q15_match_offsets",
    "WITH s AS (SELECT doc_id, string_split(text, 'license') AS l FROM documents), u AS (SELECT doc_id, unnest(generate_series(1, len(l) - 1)) AS i, l FROM s) "
    "SELECT doc_id, (i - 1)::INT AS match_no, (list_sum([length(x) FOR x IN l[1:i]]) + 7 * (i - 1))::INT AS cs, (list_sum([length(x) FOR x IN l[1:i]]) + 7 * i)::INT AS ce FROM u",
)
def q15(spark, sf_dir):
    """Matches with positions."""
    return M.matches(table(spark, sf_dir, "documents"), [RuleSpec("license", "licence")], "doc_id").select("doc_id", "match_no", "cs", "ce")


_GLYPHS = "SELECT l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER w AS step, l_discount * 10 - lag(l_discount) OVER w * 10 AS rise, row_number() OVER w AS n FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)"


def _glyphs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return S.first_wins(lines, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount")])


@query("q16_separators", f"SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN '' WHEN abs(rise) > 0.5 OR step < -0.5 THEN chr(10) WHEN step > 0.15 THEN ' ' ELSE '' END AS sep FROM ({_GLYPHS})")
def q16(spark, sf_dir):
    """What is between neighbours, inferred from their positions."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    step = F.col("l_quantity") - F.lag("l_quantity").over(w)
    rise = F.col("l_discount") * 10 - F.lag("l_discount").over(w) * 10
    glyphs = _glyphs(spark, sf_dir).withColumns({"step": step, "rise": rise})
    return S.separators(glyphs, ["l_orderkey"], [F.col("l_linenumber")], F.col("step"), F.col("rise")).select("l_orderkey", "l_linenumber", "sep")


@query("q17_next_kept", "SELECT l_orderkey, l_linenumber, l_partkey, first_value(CASE WHEN l_returnflag <> 'N' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_part FROM lineitem")
def q17(spark, sf_dir):
    """The next neighbour that stays."""
    lines = table(spark, sf_dir, "lineitem")
    out = S.next_kept(lines, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")], F.col("l_partkey"), F.col("l_returnflag") != "N", "next_part")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "next_part")


@query("q18_first_wins", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey, o_totalprice) = 1")
def q18(spark, sf_dir):
    """The newest entry of each key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return S.first_wins(orders, ["o_custkey"], [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"), F.col("o_totalprice")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "q19_walk",
    "WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), "
    "w AS (SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS root, 0 AS hops FROM region UNION ALL SELECT child, root, hops + 1 FROM w JOIN e ON parent = node) SELECT root, hops, count(*) AS nodes FROM w GROUP BY root, hops",
)
def q19(spark, sf_dir):
    """A tree walk with a guard against cycles."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    seen = S.walk(edges, region.select(name("r", "r_regionkey").alias("root")))
    return seen.groupBy("root", "hops").agg(F.count(F.lit(1)).alias("nodes"))


_CHARS = "SELECT DISTINCT {g} unnest(string_split({t}, '')) AS ch FROM {f}"


@query("q20_missing_characters", f"SELECT lang, ch FROM (SELECT DISTINCT lang, n.ch FROM documents, ({_CHARS.format(g='', t='text', f='benchmark')}) n) EXCEPT SELECT lang, ch FROM ({_CHARS.format(g='lang,', t='text', f='documents')})")
def q20(spark, sf_dir):
    """Characters that the benchmark needs and a language's documents never use (languages and characters are few)."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    needed = S.characters(bench.withColumn("g", F.lit(0)), "g", "text").agg(F.collect_set("ch").alias("all"))
    langs = docs.groupBy("lang").agg(F.lit(0).alias("g")).select("lang", F.lit(needed.first()["all"]).alias("all"))
    return S.missing(langs.select("lang", F.explode("all").alias("ch")), S.characters(docs, "lang", "text"), ["lang", "ch"])


@query("q21_size_guard", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 200)) WHERE before < 500000")
def q21(spark, sf_dir):
    """The largest candidates until a budget is met."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.within_budget(docs, F.col("n_chars"), F.col("doc_id"), 500_000)


@query("q22_islands", "SELECT l_suppkey, min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT l_suppkey, k, sum(new) OVER (PARTITION BY l_suppkey ORDER BY k) AS i FROM (SELECT l_suppkey, k, CASE WHEN k - lag(k) OVER (PARTITION BY l_suppkey ORDER BY k) <= 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT l_suppkey, l_orderkey AS k FROM lineitem))) GROUP BY l_suppkey, i")
def q22(spark, sf_dir):
    """Runs of numbers, holes of one bridged."""
    keys = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("k")).distinct()
    return S.islands(keys, ["l_suppkey"], "k")


@query("q25_map_order", "SELECT p_name AS search, (row_number() OVER (ORDER BY octet_length(encode(p_name)) DESC, p_name) - 1)::INT AS rule_idx FROM (SELECT DISTINCT p_name FROM part)")
def q25(spark, sf_dir):
    """Rules of a map, longest search first."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("search")).distinct()
    at = F.row_number().over(Window.orderBy(F.octet_length("search").desc(), "search")) - 1
    return names.select("search", at.alias("rule_idx"))


_FONTS = ["Helvetica-Bold", "ABCDEF+TimesNewRomanPS-ItalicMT", "CMTT10", "XYZABC+Consolas-Bold", "Unknown", "NimbusRomNo9L-Medi", "AAAAAA+", "Georgia-BoldItalic"]
_STEM = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FONTS)) + " END"
_STYLE = (
    "SELECT p_partkey, CASE WHEN regexp_matches(low, 'courier|mono|consolas|menlo|typewriter|cmtt') THEN 'mono' WHEN regexp_matches(low, 'sans|helvetica|arial|calibri|verdana|tahoma|roboto|cmss') THEN 'sans' WHEN regexp_matches(low, '" + "|".join(T.SERIF) + "') THEN 'serif' ELSE 'sans' END AS family, "
    f"regexp_matches(low, 'bold|black|heavy|cmbx|-bd|demi|medi-|medi$') AS bold, regexp_matches(low, 'italic|oblique|cmti|-it') AS italic FROM (SELECT p_partkey, lower(regexp_replace({_STEM} || CASE p_partkey % 3 WHEN 0 THEN p_name ELSE '' END, '^[A-Z]{{6}}\\+(.)', '\\1')) AS low FROM part)"
)


@query("q26_font_style", f"SELECT *, CASE family WHEN 'serif' THEN 'Times' WHEN 'mono' THEN 'Courier' ELSE 'Helvetica' END || CASE WHEN bold OR italic THEN '-' WHEN family = 'serif' THEN '-Roman' ELSE '' END || CASE WHEN bold THEN 'Bold' ELSE '' END || CASE WHEN italic THEN CASE family WHEN 'serif' THEN 'Italic' ELSE 'Oblique' END ELSE '' END AS font FROM ({_STYLE})")
def q26(spark, sf_dir):
    """Font styles from names, and the standard font of each."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.expr(_STEM), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(""))
    family, bold, italic = T.font_style(name)
    out = part.select("p_partkey", family.alias("family"), bold.alias("bold"), italic.alias("italic"))
    return out.withColumn("font", T.standard_font(F.col("family"), F.col("bold"), F.col("italic")))


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on each row of a table of two columns, over Arrow batches; it gives rows."""
    from collections.abc import Iterator

    import pyarrow as pa

    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [r for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in work(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _pdfs(df: DataFrame, make) -> DataFrame:
    """(path, content): a PDF from each (path, value)."""
    return _mapped(df, "path string, content binary", lambda path, x: [(path, make(path, x))])


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over several tasks a core. Making a file of a row costs far more than moving it, and a small table is one task."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _turn_pdfs(spark, sf_dir, marked: bool = False) -> DataFrame:
    """A PDF for each turn, in a font with a glyph for each of its characters."""
    from .pdf.make import any_text_pdf

    return _pdfs(_turns(spark, sf_dir), lambda _, text: any_text_pdf([text], marked=marked))


def _normal(text: str) -> str:
    for sign, letters in T.LIGATURES.items():
        text = f"replace({text}, '{sign}', '{letters}')"
    return f"replace({text}, chr(160), ' ')"


_TEXT = "coalesce(text, '')"
#: What a page shows of a text: runs of line ends are one, and none stands at either end.
_SHOWN = rf"trim(regexp_replace({_normal(_TEXT)}, '\n+', chr(10), 'g'), chr(10))"
_PATH = "concat_ws('-', conv_id, turn)"
_CODECS = ("Flate", "Hex", "Ascii85", "Lzw", "RunLength", "Up", "Tiff")


@query("q23_codecs", f"SELECT doc_id, codec, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents, (SELECT unnest({list(_CODECS)!r}) AS codec)")
def q23(spark, sf_dir):
    """What every codec and predictor gives back."""

    def work(doc_id, text):
        import hashlib

        from .pdf.codecs import decode
        from .pdf.make import encoded

        data = (text or "").encode()
        for codec in _CODECS:
            back = decode(*encoded(codec, data))[: len(data)]
            yield doc_id, codec, len(back), hashlib.md5(back).hexdigest()

    return _mapped(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, codec string, size long, digest string", work)


@query("q24_pdf_text", f"SELECT {_PATH} AS path, 1 AS page, {_SHOWN} AS text FROM conversations")
def q24(spark, sf_dir):
    """Text of PDF files."""
    from .sources.pdf import extract_text

    return extract_text(_turn_pdfs(spark, sf_dir)).select("path", "page", "text")


@query("q27_pdf_rewrite", f"SELECT {_PATH} AS path, contains(coalesce(text, ''), 'the') AS changed, replace({_SHOWN}, 'the', 'THOSE') AS text FROM conversations")
def q27(spark, sf_dir):
    """A rule on PDF files, read back from the new files; letters that a font lacks come from a standard font."""
    from .sources.pdf import extract_text, rewrite_pdf

    out = rewrite_pdf(_turn_pdfs(spark, sf_dir), [RuleSpec("the", "THOSE")]).select(F.concat_ws("|", "path", "changed").alias("path"), "content")
    parts = F.split("path", r"\|")
    return extract_text(out).select(parts[0].alias("path"), (parts[1] == "true").alias("changed"), "text")


_FORMS = ("table", "linearized", "packed", "damaged", "rc4", "aes128", "aes256")


@query("q28_pdf_containers", f"SELECT conv_id, {list(_FORMS)!r}[conv_id % 7 + 1] AS form, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text))::INT AS page, conv_id % 7 >= 4 AS locked, conv_id % 7 = 2 AS packed, replace({_SHOWN}, 'and', 'AND') AS text FROM conversations")
def q28(spark, sf_dir):
    """A rule on files in every container and encryption, a page for each turn; read back from what was written."""
    from .sources.pdf import rewrite_pdf

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    books = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(F.col("conv_id").cast("string").alias("path"), F.col("t.text").alias("pages"))

    def make(path, pages):
        from .pdf.make import any_text_pdf

        return any_text_pdf(pages, _FORMS[int(path) % 7])

    def read(path, data):
        from .pdf.engine import Engine

        engine = Engine(data)
        for page, _, text in engine.text():
            yield int(path), _FORMS[int(path) % 7], page, engine.doc.crypt is not None, engine.doc.use_xref_stream, text

    out = rewrite_pdf(_pdfs(books, make), [RuleSpec("and", "AND")])
    return _mapped(out.select("path", "content"), "conv_id long, form string, page int, locked boolean, packed boolean, text string", read)


@query("q29_pdf_links", "SELECT page_id::VARCHAR AS path, 1 AS page, replace(coalesce(url, ''), '://', '+secure://') AS uri FROM pages")
def q29(spark, sf_dir):
    """A link rule on PDF files, addresses in annotations or as objects of their own."""
    from .pdf.make import link_pdf
    from .sources.pdf import extract_links, rewrite_pdf

    urls = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.coalesce("url", F.lit("")).alias("url"))
    made = _pdfs(urls, lambda path, url: link_pdf([url], int(path) % 2 == 1))
    return extract_links(rewrite_pdf(made, [RuleSpec("://", "+secure://", pages="7", targets=("links",))])).select("path", "page", "uri")


@query("q30_pdf_alternates", f"SELECT {_PATH} AS path, 1 AS page, replace(coalesce(text, ''), 'the', 'THOSE') AS text FROM conversations")
def q30(spark, sf_dir):
    """Replacement texts of marked content change with the glyphs."""
    from .sources.pdf import extract_alternates, rewrite_pdf

    out = rewrite_pdf(_turn_pdfs(spark, sf_dir, True), [RuleSpec("the", "THOSE")])
    return extract_alternates(out).select("path", "page", "text")


@query("q31_pdf_skipped", f"SELECT {_PATH} AS path, 0::BIGINT AS replaced, len(regexp_extract_all({_SHOWN}, 'e'))::BIGINT AS skipped, {_SHOWN} AS text FROM conversations")
def q31(spark, sf_dir):
    """Matches whose replacement no font can show are left as they are and reported."""
    from .sources.pdf import extract_text, rewrite_pdf

    out = rewrite_pdf(_turn_pdfs(spark, sf_dir), [RuleSpec("e", "Ж")])
    out = out.select(F.concat_ws("|", "path", F.col("stats")[0]["text"], F.size(F.col("stats")[0]["skipped"])).alias("path"), "content")
    part = F.split("path", r"\|")
    return extract_text(out).select(part[0].alias("path"), part[1].cast("long").alias("replaced"), part[2].cast("long").alias("skipped"), "text")


@query("q32_pdf_glyph_names", "SELECT p_partkey::VARCHAR AS path, p_name AS text FROM part")
def q32(spark, sf_dir):
    """Text in fonts that know their glyphs by name only."""
    from .pdf.make import named_glyphs_pdf
    from .sources.pdf import extract_text

    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name")
    return extract_text(_pdfs(_spread(names), lambda _, name: named_glyphs_pdf(name))).select("path", "text")


@query("q33_pdf_shared_forms", "SELECT n_nationkey::VARCHAR AS path, page::INT AS page, text FROM (SELECT n_nationkey, unnest(range(1, n_nationkey % 4 + 2)) AS page, '' AS text FROM nation UNION ALL SELECT n_nationkey, 1, n_name FROM nation)")
def q33(spark, sf_dir):
    """A form that many pages draw belongs to the first of them."""
    from .pdf.make import stamped_pdf
    from .sources.pdf import extract_text

    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), "n_name")
    return extract_text(_pdfs(names, lambda path, name: stamped_pdf(int(path) % 4 + 1, name))).select("path", "page", "text")


@query("q34_pdf_gaps", "SELECT p_partkey::VARCHAR AS path, trim(regexp_replace(replace(replace(p_name, ' ', 'q'), 'q', ' '), ' +', ' ', 'g')) AS text FROM part")
def q34(spark, sf_dir):
    """A space in a font without one becomes a gap, which reads as a space again."""
    from .pdf.make import any_text_pdf
    from .sources.pdf import extract_text, rewrite_pdf

    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.replace("p_name", F.lit(" "), F.lit("q")).alias("name"))
    return extract_text(rewrite_pdf(_pdfs(_spread(names), lambda _, name: any_text_pdf([name])), [RuleSpec("q", " ")])).select("path", "text")


@query("q35_text_strings", f"SELECT doc_id, md5(coalesce(text, '')) AS wide, md5(coalesce(text, '')) AS marked, md5({_normal(_TEXT)}) AS normal FROM documents")
def q35(spark, sf_dir):
    """Text strings of documents decoded by their mark, and texts in normal form."""
    text = F.coalesce("text", F.lit(""))
    wide, marked = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")), F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.text_string(wide)).alias("wide"), F.md5(T.text_string(marked)).alias("marked"), F.md5(T.normalize(text)).alias("normal"))


@query("q36_numbers", r"SELECT l_orderkey, l_linenumber, regexp_replace(format('{:.4f}', l_extendedprice), '\.?0+$', '') AS price, CASE WHEN l_discount = 0 THEN '0' ELSE regexp_replace(format('{:.4f}', -l_discount), '\.?0+$', '') END AS less FROM lineitem")
def q36(spark, sf_dir):
    """Numbers in their short form."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.short_number(F.col("l_extendedprice")).alias("price"), T.short_number(-F.col("l_discount")).alias("less"))
