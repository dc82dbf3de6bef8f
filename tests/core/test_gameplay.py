"""Names of states and notifies, numbers of types, and the filter of abilities."""

from pyspark.sql import functions as F

from cordage.operators import gameplay as P


def test_states(spark):
    names = {"Idle": True, "Run Fast": True, "RunFast": True, "Loop": False, "Event Graph": False, "EventGraph": False, "Blend Poses by bool": False, "The Run": False, "walk around": False, "Start Run": True, "Guard/Evade": False, "x" * 31: False, "Is Falling": False, "Parry": True, "": False}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", P.likely_state(F.col("name")).alias("s"))
    assert {r.name: r.s for r in rows.collect()} == names


def test_notifies_and_numbers(spark):
    rows = spark.createDataFrame([("AN_gaSp", "9"), ("Footstep", "7"), ("launchRocket", "0"), (None, None)], "name string, n string")
    got = [tuple(r) for r in rows.select(P.ability_notify(F.col("name")), P.named_by(F.col("n"), P.PARAMETER_TYPES), P.named_by(F.col("n"), P.BLEND_TYPES)).collect()]
    assert got == [(True, "Bool", "9"), (False, "7", "7"), (True, "Float", "1D"), (None, None, None)]


def test_abilities(spark):
    rows = spark.createDataFrame([("GA_Dash", ["Event.Move"]), ("GA_Fire", ["Eventful.X", None]), ("GA_Eventide", None), (None, ["EVENT"])], "name string, tags array<string>")
    names = lambda **k: [r.name for r in P.abilities_matching(rows, **k).collect()]
    assert names() == ["GA_Dash", "GA_Fire", "GA_Eventide", None]
    assert names(category="event") == ["GA_Dash", None]
    assert names(keyword="event") == ["GA_Dash", "GA_Fire", "GA_Eventide", None]
    assert names(category="Event", keyword="fire") == ["GA_Fire"]
    assets = spark.createDataFrame([("BP_Boss", ["GA_Dash"], None), ("BP_Dog", None, ["a.DASH"]), ("Dashboard", [], []), ("Other", [None], ["x"])], "name string, classes array<string>, tags array<string>")
    assert [r.name for r in P.assets_matching(assets, "dash").collect()] == ["BP_Boss", "BP_Dog", "Dashboard"] and P.assets_matching(assets).count() == 4
