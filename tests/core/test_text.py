"""Text vectors, search and rendering."""

import pytest
from pyspark.sql import functions as F

from cordage.functions import text as T
from cordage.operators import reports as R
from cordage.operators import search as S
from cordage.sources import render


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.split_camel, "ULyraGameplayAbility", "U Lyra Gameplay Ability"), (S.augmented, "Uses AbilitySystemComponent", "Uses AbilitySystemComponent Ability System Component"), (S.augmented, "a GAS and Word here", "a GAS and Word here"),
        (T.simple_type, "Dictionary<ETB_CARD_TYPE, List<InGameShopProduct>>", "InGameShopProduct"), (T.cpp_type, "std::vector<MyClass*>", "MyClass"), (T.cpp_type, "const class Foo& /* x */", "Foo"),
        (T.class_of_file, "/a/BattleCore@Calculator.cs", "BattleCore"), (T.slug, "  How does: GAS  work?! ", "how-does-gas-work"), (T.strip_frontmatter, "---\ntitle: x\n---\n\nbody", "body"), (T.file_safe, 'a<b>:"c', "a_b___c"),
    ],
)
def test_functions(spark, f, given, want):
    assert one(spark, f, given) == want


def test_type_names(spark):
    assert one(spark, lambda c: T.type_names(c, ["int"]), "Dictionary<int, A.B.Foo[]>?") == ["Dictionary", "Foo"]


def test_match_expression():
    q = "GAS ability zombie"
    assert S.match_expression(q) == '"GAS" OR "ability" OR "zombie"' and S.match_expression(q, "and") == '"GAS" AND "ability" AND "zombie"'
    assert S.match_expression(q, "phrase") == f'"{q}"' and S.match_expression("Lyra*") == '"Lyra"*'


def test_api_score(spark):
    rows = spark.createDataFrame([(t,) for t in ("health", "HealthBar", "MaxHealth", "Mana")], "text string")
    assert {r.text: r.score for r in S.api_search(rows, "Health").collect()} == {"health": 100, "HealthBar": 80, "MaxHealth": 70}


def test_sizes_and_coverage(spark):
    df = spark.createDataFrame([(0.0,), (1536.0,), (1048576.0,)], "s double")
    assert [r[0] for r in df.select(R.human_size(F.col("s"))).collect()] == ["0.0 B", "1.5 KB", "1.0 MB"]
    assert spark.range(1).select(R.coverage(F.lit(2), F.lit(3)), R.coverage(F.lit(0), F.lit(0))).first()[:] == (66.7, 0.0)


BODY = """
if (x == null) { return; }
lock (gate) { Save(); }
foreach (var e in list) { if (e.ok) { e.Run(1); } else { Skip(e); } }
Task.Run(() => { Work(); });
await Load();
switch (k) { case 1: Go(); break; }
// Hidden();
Last("a(b)");
"""


def test_calls():
    found = T.calls_of(BODY)
    got = {m: (r, c, x) for r, m, c, x in found if m != "Run"}
    assert "Hidden" not in got and "a" not in got
    assert got["Save"][2] == "lock" and [r for r, m, _, _ in found if m == "Run"] == ["e", "Task"]
    assert got["Skip"][1] == "!(e.ok)" and got["Go"][1] == "switch: k" and got["Load"][2] == "await" and got["Work"][2] == "thread"


def test_control_flow(spark):
    kinds = [k for _, k, _ in T.control_flow(BODY)]
    assert kinds[0] == "Guard" and "Loop" in kinds and "Switch" in kinds and kinds[-1] == "Always"
    spark.udtf.register("control_flow", T.control_flow_udtf())
    rows = spark.sql("SELECT c.* FROM VALUES ('try { A(); } catch (E e) { B(); } while (x) { C(); }') AS t(b), LATERAL control_flow(b) c").collect()
    assert [r.kind for r in rows] == ["Exception", "Loop"]


def notes(spark):
    rows = [("1", "class", "Health bar", "Shows health of the hero"), ("2", "class", "Mana", "Shows mana, never health"), ("3", "asset", "Other", "Nothing here"), ("4", "asset", "AbilitySystem", "x")]
    return spark.createDataFrame(rows, "id string, type string, title string, body string")


def test_bm25_and_fallback(spark):
    n = notes(spark)
    found = S.bm25(n, ["health"]).orderBy("score").collect()
    assert [r.id for r in found] == ["1", "2"] and S.bm25(n, ["health", "mana"], require_all=True).first().id == "2"
    assert [r.id for r in S.search(n, ["zzz"], "AbilitySys").collect()] == ["4"]
    assert [r.id for r in S.phrase_search(n, ["of", "the"]).collect()] == ["1"]
    assert n.filter("id = 1").select(S.snippet(F.col("body"), "health")).first()[0] == "Shows **health** of the hero"


def test_report_edges(spark):
    body = "# Depends on\n- `Foo` x\n- Bar\n- lower\n# Used by\n- Foo\n- Self\n"
    got = S.extract_edges(spark.createDataFrame([("class:Self", body)], "id string, body string"), {"Depends on": "depends_on", "Used by": "referenced_by"})
    assert {tuple(r) for r in got.collect()} == {("class:Self", "Foo", "depends_on"), ("class:Self", "Bar", "depends_on"), ("class:Self", "Foo", "referenced_by")}


def test_rendering(spark, tmp_path):
    e = spark.createDataFrame([("A.B", "C", ""), ("C", "A.B", "calls")], "src string, dst string, label string")
    assert [r.line for r in render.mermaid(e).collect()] == ["graph TD", '    A_B["A.B"] --> C["C"]', '    C["C"] -->|calls| A_B["A.B"]']
    assert [r.line for r in render.dot(e).collect()] == ["digraph G {", '    "A.B" -> "C";', '    "C" -> "A.B";', "}"]
    assert render.tree([["A", "B"], ["A", "C"]]) == "A\n  B\n  C"
    n = notes(spark).withColumn("fingerprint", F.lit("f"))
    assert render.pages(n).filter("path = 'class/Mana.md'").count() == 1 and render.index(n).count() == 2
    made = []
    for _ in range(2):
        df = render.cached(spark, f"file://{tmp_path}/cache", "f1", lambda: made.append(1) or notes(spark))
    assert df.count() == 4 and made == [1]
    assert render.as_json(e.limit(1)).first().json.startswith("{")
