import pytest

from textloom.operators import matches as M
from textloom.operators import rewrite as R
from textloom.rules.dialect import compile_rule, java_template, parse_template, translate
from textloom.rules.spec import RuleError, RuleSpec, literal, load_rules, parse_pages


def test_script_shapes():
    assert len(load_rules('{"rules":[{"search":"a","replace":"b","regex":true}]}')) == 1
    assert len(load_rules('[{"search":"a","replace":"b"}]')) == 1
    assert [r.search for r in load_rules('{"replacements":{"ab":"x","é":"z","abc":"y"}}')] == ["abc", "ab", "é"]


@pytest.mark.parametrize("bad", ['{"rules":[{"search":"a","replace":"b","bogus":1}]}', "{}", "3", "[3]", '[{"search":1,"replace":"b"}]', "nonsense", '[{"search":"a","replace":"b","targets":["x"]}]'])
def test_bad_scripts(bad):
    with pytest.raises(RuleError):
        load_rules(bad)


def test_pages():
    rule = compile_rule(RuleSpec("a", "b", pages="1-2, 5, 9-"))
    assert [p for p in (1, 2, 3, 5, 8, 40) if rule.applies_to(p)] == [1, 2, 5, 40]
    assert parse_pages("7-3") == [(7, 3)]
    for bad in ("", ",", "-3", "a", "1-b"):
        with pytest.raises(RuleError):
            parse_pages(bad)


@pytest.mark.parametrize("bad", ["(?=a)", r"(a)\1", "[a--b]", "(", "a++", "(?<!x)y"])
def test_unsupported_patterns(bad):
    with pytest.raises(RuleError):
        translate(bad)


def test_templates():
    groups = (None, "name")
    assert parse_template("$1a-${1}a-$name-$$-$9", groups) == ["-", 1, "a-", 2, "-", "$", "-"]
    assert java_template([1, "0 \\$"]) == "$1\\0 \\\\\\$"


CASES = [
    (literal("Acme  Corp.", "X"), "an Acme\n Corp. and AcmeCorp.", "an X and AcmeCorp."),
    (RuleSpec(r"(\d+)-(\d+)", "$2-$1", regex=True), "12-34 and ٣-5", "34-12 and 5-٣"),
    (RuleSpec("straße", "X", ignore_case=True), "STRAßE straße", "X X"),
    (RuleSpec("the", "X", whole_word=True), "the other thé the", "X other thé X"),
    (RuleSpec("a*", "-", regex=True), "baaac", "b-c"),
    (RuleSpec("a.c$", "!", regex=True), "abc\rabc", "abc\r!"),
    (RuleSpec("(?P<first_one>a)b", "${first_one}$first_one", regex=True), "ab", "aa"),
    (RuleSpec("$5 (x)", "$1"), "it is $5 (x)", "it is $1"),
    (RuleSpec(" ", "_"), "a \n b", "a_b"),
]


def test_rules_on_text(spark):
    for spec, text, want in CASES:
        out = R.rewrite(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), [spec]).orderBy("id").collect()
        assert out[0]["new_text"] == want, spec
        assert out[0]["changed"] is (want != text)
        assert out[1]["new_text"] is None and out[1]["changed"] is False and out[1]["hits"] == [0]


def test_links_see_empty_matches_and_no_pages(spark):
    df = spark.createDataFrame([("baaac",)], "uri string")
    row = R.rewrite_links(df, [RuleSpec("a*", "-", regex=True, pages="9")]).first()
    assert (row["new_uri"], row["hits"]) == ("-b-c-", [3])


def test_chain_counts_pages_and_targets(spark):
    df = spark.createDataFrame([(1, 1, "a a"), (1, 2, "a")], "doc int, page int, text string")
    rules = [RuleSpec("a", "b", pages="1"), RuleSpec("b", "c"), RuleSpec("c", "d", targets=("links",))]
    out = R.rewrite(df, rules, page_col="page")
    assert [r["new_text"] for r in out.orderBy("page").collect()] == ["c c", "a"]
    assert [tuple(r) for r in R.rule_stats(out).orderBy("rule_idx").collect()] == [(0, 2, 1), (1, 2, 1), (2, 0, 0)]


def test_matches_give_the_smallest_edit(spark):
    df = spark.createDataFrame([(7, "for Acme Corp now"), (8, None), (9, "")], "id int, text string")
    row = M.matches(df, [RuleSpec("Acme Corp", "Acme Inc")], "id").collect()
    assert [(r["id"], r["cs"], r["ce"], r["edit_cs"], r["edit_ce"], r["edit_text"]) for r in row] == [(7, 4, 13, 9, 13, "Inc")]


def test_trimmed_edit_gives_the_same_text():
    for old, new in (("abc", "abc"), ("aa", "a"), ("", "x"), ("xay", "xby"), ("aba", "a")):
        front, back, rest = M.trim_common(old, new)
        assert old[:front] + rest + old[len(old) - back :] == new


def test_dry_and_strict_runs(spark):
    df = spark.createDataFrame([("a", ["why"]), ("b", [])], "text string, skipped array<string>")
    seen = []
    assert R.run(df, [literal("a", "b")], dry_run=True, sink=seen.append).status == 0 and not seen
    assert R.run(df, [literal("a", "b")], strict=True, skipped_col="skipped", sink=seen.append).status == 2 and not seen
    assert R.run(df, [literal("a", "b")], sink=seen.append).stats == [(0, 1, 1)] and len(seen) == 1
