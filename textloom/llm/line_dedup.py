"""Line dedup with a segment-partition edit join, with built-in functions only.

Lines (split at \\n) are one class if they are equal, or linked by an edit distance of at most ``threshold``
between lines of at least ``least`` code points (shorter ones are only compared whole; blank ones, of white space alone, are
never dropped). Of each class the first line (least document id, then line number) stays, the others go.

Two lines within t edits share one of t + 1 even segments of the shorter line, at a place that the number of
edits to its left and right bounds. Equal lines are merged first. Each line is then indexed by its segments, keyed by length, segment
number and content, and probes with its substrings at those places for its own and the t next smaller lengths. One shuffle
brings index and probes together and is joined with itself. An entry also holds how often each of 12 signs occurs in its line, modulo 4 in a Gray code: an edit changes
two of these counts by one at most, which flips one bit each, so the join itself drops pairs that differ in more than 2t bits and loses none. What is left are distinct pairs of
different lines; they must share enough of 2t + 2 smaller segments, and
what is left between their common start and end is verified by a bit-parallel edit distance on the
band of 2t + 1 diagonals, one machine word however long the lines are.

Equal lines are known by their md5, 128 bits; in the index by another hash of 63 bits, behind which texts are verified. A line that very many documents share costs one entry, and its first place is
an aggregate that is combined before the shuffle.

Null texts have no lines; empty texts have one blank line. Null ids sort first. Repeated rows: the second
copy's lines repeat the first's and go. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: From 12 code points on, each of the three segments of a line has three at least (of the next smaller lengths, too).
THRESHOLD, LEAST = 2, 12
#: Texts of candidates are fetched by a broadcast join up to so many lines (16 bytes each), else by a shuffle.
BROADCAST_IDS = 100_000
#: The signs that are counted.
SIGNS = "acdghilnorsu"


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(first position from 1, size) of segment i (from 0) of a line cut into even parts, longer ones last."""
    base, longer = F.call_function("div", length, F.lit(parts)).cast("int"), F.pmod(length, F.lit(parts))
    return base * i + F.greatest(longer + (i - parts), F.lit(0)) + 1, base + (longer >= parts - i).cast("int")


def keys(line: Column, length: Column, t: int) -> Column:
    """What a line is found by, the first t + 1 entries, and what else it looks for. A piece that would end
    beyond the line is a shorter one, which may make a needless candidate."""
    own, other = [], []
    for less in range(t + 1):
        for i in range(t + 1):
            place, size = segment(length - less, i, t + 1)
            for d in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                key = F.xxhash64(F.substring(line, place + d, size), F.lit(i), length - less)
                (own if less == d == 0 else other).append(key)
    return F.array(*own, *other)


def sign_counts(line: Column) -> Column:
    """Two bits for each of SIGNS: how often it occurs modulo 4, as 0, 1, 3, 2. Counts that differ by one differ in one bit."""
    bits = F.lit(0).cast("long")
    for i, c in enumerate(SIGNS):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 4
        bits = bits.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).cast("long"), 2 * i))
    return bits


def banded_distance(a: Column, b: Column, t: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most t; anything over t means "more".

    Bit d of a word is the cell on diagonal d - t of the current column; vertical and horizontal differences are
    one bit vector each for +1 and -1, and one addition carries matches down the column."""
    width = 2 * t + 1
    full = (1 << width) - 1
    def measured(s: Column) -> Column:
        p, q, m = s["p"], s["q"], F.size(s["p"])
        state = F.struct(F.lit(((1 << (t + 1)) - 1) << t).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(t)).alias("dist"))

        def column(x: Column, j: Column) -> Column:
            c = F.get(q, j)
            same = sum((F.when(F.get(p, j + (d - t)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)), F.lit(0)).cast("long")

            def vertical(z: Column) -> Column:
                def moves(y: Column) -> Column:
                    hp = x["vn"].bitwiseOR(F.bitwise_not(y["d0"].bitwiseOR(x["vp"])).bitwiseAND(F.lit(full)))
                    hn = y["d0"].bitwiseAND(x["vp"])
                    down = F.shiftrightunsigned(y["d0"], 1)

                    def settle(h: Column) -> Column:
                        last = F.lit(width - 2) - (j - (m - t))
                        diagonal = F.when(y["d0"].bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
                        across = F.expr("0") + F.when(j < m - t, diagonal).otherwise((F.call_function("shiftright", h["hp"], F.greatest(last, F.lit(0))) % 2 - F.call_function("shiftright", h["hn"], F.greatest(last, F.lit(0))) % 2).cast("int"))
                        vp = h["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(h["hp"])).bitwiseAND(F.lit(full)))
                        return F.struct(vp.alias("vp"), down.bitwiseAND(h["hp"]).alias("vn"), (x["dist"] + across).alias("dist"))

                    return let(F.struct(hp.alias("hp"), hn.alias("hn")), settle)

                carry = (z.bitwiseAND(x["vp"]) + x["vp"]).bitwiseXOR(x["vp"]).bitwiseAND(F.lit(full))
                return let(F.struct(carry.bitwiseOR(z).bitwiseOR(x["vn"]).alias("d0")), moves)

            return let(same, vertical)

        return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), state, column)["dist"]

    return let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q")), measured)


def common_start(a: Column, b: Column) -> Column:
    """How many characters two strings share in front: found by halving, with whole pieces compared at once."""
    n = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1))

    def step(p: Column, e: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), e)
        return F.when((p + size <= n) & (F.substring(a, p + 1, size) == F.substring(b, p + 1, size)), p + size).otherwise(p)

    return F.aggregate(steps, F.lit(0), step)


def edit_distance(a: Column, b: Column, t: int) -> Column:
    """The banded distance of what is left between the common start and the common end, which no edit touches."""

    def without_start(x: Column) -> Column:
        def cut_start(n: Column) -> Column:
            return F.struct(F.reverse(F.substr(x["a"], n + 1)).alias("a"), F.reverse(F.substr(x["b"], n + 1)).alias("b"))

        return let(common_start(x["a"], x["b"]), cut_start)

    def middle(z: Column) -> Column:
        x, y = z["a"], z["b"]
        # both ends differ now, which takes an edit each: of t - 1 pieces of what lies between, one is whole in the other
        core, n, parts = F.substring(x, F.lit(2), F.length(x) - 2), F.length(x) - 2, max(t - 1, 1)
        whole_piece = F.lit(t < 2) | (n < parts)
        for i in range(parts):
            place, size = segment(n, i, parts)
            whole_piece = whole_piece | F.contains(y, F.substring(core, place, size))
        return F.when(x == "", F.length(y)).when(y == "", F.length(x)).when(~whole_piece, F.lit(t + 1)).otherwise(banded_distance(x, y, t))

    whole = F.struct(a.alias("a"), b.alias("b"))
    return let(let(let(whole, without_start), without_start), middle)


def segments_fit(a: Column, b: Column, t: int) -> Column:
    """True unless too few of 2t + 2 even segments of the shorter string occur in the other one within t places:
    t edits damage t segments at most, so no pair is lost."""
    parts = 2 * t + 2

    def count(x: Column) -> Column:
        short, long, n = x["s"], x["l"], x["n"]
        total = F.lit(0)
        for i in range(parts):
            place, size = segment(n, i, parts)
            near = F.substring(long, F.greatest(place - t, F.lit(1)), size + 2 * t)
            total = total + F.contains(near, F.substring(short, place, size)).cast("int")
        return total >= parts - t

    swap = F.length(a) > F.length(b)
    return let(F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("l"), F.least(F.length(a), F.length(b)).alias("n")), count)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of the ids in (a, b) links, the least id being the root: each round takes the least root around, then that one's root."""
    total = F.sum(F.xxhash64("root").cast("decimal(38,0)"))
    links = scratch.keep(links.union(links.select("b", "a")))
    roots = scratch.keep(links.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), total=total)
    while True:
        near = links.join(roots, links["a"] == roots["id"]).select(F.col("b").alias("id"), "root")
        step = near.union(roots).groupBy("id").agg(F.min("root").alias("root"))
        up = roots.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
        now = scratch.keep(step.join(up, step["root"] == up["_id"], "left").select("id", F.least("root", F.coalesce("_up", "root")).alias("root")), total=total)
        same = scratch.seen(now)["total"] == scratch.seen(roots)["total"]
        scratch.drop(roots)
        roots = now
        if same:
            scratch.drop(links)
            return roots


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def near_links(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(a, b): ids of different lines within the threshold. docs: text."""
    scratch = Scratch(docs.sparkSession)
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where((F.length("line") >= max(least, threshold + 1)) & ~is_blank(F.col("line")))
    short = F.xxhash64("line").bitwiseAND(F.lit((1 << 63) - 1))
    merged = lines.distinct().select("line", F.length("line").alias("len"), short.alias("e"), F.coalesce(sign_counts(F.col("line")), F.lit(0).cast("long")).alias("signs"))
    # The keys are a column of their own first, where what they share is computed once. An outer explode, though no array is empty, and
    # a default for signs, though none is missing: else the optimizer asks for sizes and nulls before the lines are merged.
    merged = merged.select("e", "signs", keys(F.col("line"), F.col("len"), threshold).alias("keys"))
    rows = merged.select("e", "signs", F.posexplode_outer("keys").alias("place", "key"))
    # both sides of the join read one shuffle; the sign bit tells entries of the index from probes
    indexed = F.when(F.col("place") <= threshold, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
    rows = rows.select("key", F.col("e").bitwiseOR(indexed).alias("e"), "signs")
    bare = lambda c: F.col(c).bitwiseAND(F.lit((1 << 63) - 1))
    alike = F.bit_count(F.col("l.signs").bitwiseXOR(F.col("r.signs"))) <= 2 * threshold
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.e").bitwiseOR(F.col("r.e")) < 0) & alike & (bare("l.e") < bare("r.e"))
    pairs = rows.alias("l").join(rows.alias("r"), met)
    pairs = scratch.keep(pairs.select(bare("l.e").alias("a"), bare("r.e").alias("b")).distinct())
    wanted = scratch.keep(pairs.select(F.col("a").alias("e")).union(pairs.select(F.col("b").alias("e"))).distinct(), n=F.count(F.lit(1)))
    small = scratch.seen(wanted)["n"] <= BROADCAST_IDS
    named = lines.select(short.alias("e"), "line").join(F.broadcast(wanted) if small else wanted, "e", "left_semi").distinct()
    texts = scratch.keep(named.select("e", "line", line_id(F.col("line")).alias("id")))
    left, right = (texts.select(F.col("e").alias(e), F.col("id").alias(f"{e}_id"), F.col("line").alias(f"{e}_line")) for e in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").where(segments_fit(F.col("a_line"), F.col("b_line"), threshold))
    links = scratch.keep(both.where(edit_distance(F.col("a_line"), F.col("b_line"), threshold) <= threshold).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    scratch.drop(pairs, wanted, texts)
    return links


def line_decisions(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, lines, gone) for every document: how many lines it has, null for a null text, and the sorted numbers of those that
    go. Rows are numbered here unless ``row_col`` tells them apart."""
    scratch = Scratch(docs.sparkSession)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = F.transform(F.split("text", "\n", -1), lambda x: F.when(~is_blank(x), line_id(x)))
    every = scratch.keep(docs.select("row", "doc_id", ids.alias("ids")))
    roots = components(near_links(docs, threshold, least), scratch)
    places = every.select("row", "doc_id", F.posexplode("ids").alias("pos", "id")).where("id is not null")
    first = places.groupBy("id").agg(F.min(F.struct("doc_id", "pos", "row")).alias("first")).join(roots, "id", "left")
    first = first.groupBy(F.coalesce("root", "id").alias("class")).agg(F.min("first").alias("first"))
    stay = first.groupBy(F.col("first.row").alias("row")).agg(F.collect_list("first.pos").alias("stay"))
    filled = F.filter(F.transform("ids", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    gone = F.array_sort(F.array_except(filled, F.coalesce("stay", F.array().cast("array<int>"))))
    lines = F.when(F.col("ids").isNotNull(), F.size("ids"))
    return every.join(stay, "row", "left").select("row", "doc_id", lines.alias("lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): the numbers of the lines that go, for every document."""
    decided = line_decisions(docs)
    return decided.select("doc_id", F.coalesce("lines", F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join("gone", ",").alias("dropped"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(doc_id, text): the documents with the lines that go taken out, for use outside of reports. Null texts stay null."""
    docs = Scratch(docs.sparkSession).keep(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    decided = line_decisions(docs, threshold, least, row_col="row").where(F.size("gone") > 0).select("row", "gone")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    left = let(F.split("text", "\n", -1), rest)
    return docs.join(decided, "row", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))
