"""Rules: each a filter over method, member or file rows that yields issues (rule_id, severity, cls, method, file_path, detail).

Relations: method (cls, name, return_type, specifiers, bases, body_text, file_path), member (cls, name, type, is_replicated,
specifiers, file_path), file (path, text). A rule's pass is one projection of its relation; rules are joined by bag union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and patterns that the rules look for.
UNITY_FRAME_METHODS = ["Update", "FixedUpdate", "LateUpdate"]
UNITY_HEAVY_CALLS = ["GetComponent", "Find", "FindGameObjectWithTag", "FindWithTag", "FindObjectsOfType", "FindObjectOfType"]
UNITY_VALUE_TYPES = ["Vector2", "Vector3", "Vector4", "Quaternion", "Color", "Ray"]
UNITY_HEAVY_IN_COROUTINE = ["FindObjectOfType", "FindObjectsOfType", "Resources.Load", "Resources.LoadAll", "GameObject.Find"]
UE_HEAVY_IN_TICK = ["SpawnActor", "NewObject", "FindObject", "LoadObject", "GetAllActorsOfClass"]
UE_OVERRIDES = ["BeginPlay", "EndPlay", "Tick", "OnConstruction"]
UE_ABILITY_METHODS = ["ActivateAbility", "K2_ActivateAbility"]
UE_EXPENSIVE = [r"\bGetAllActorsOfClass\b", r"\bUGameplayStatics::GetAllActors\b", r"\bFindObject<\b", r"\bLoadObject<\b"]
UE_PLAIN_TYPES = ["bool", "float", "int32", "uint8"]
COLUMNS = ["rule_id", "severity", "cls", "method", "file_path", "detail"]

#: Fix texts by rule; {cls} and {method} are filled in.
FIXES = {
    "UNI-PERF-001": "Look it up once, in Awake of {cls}, and keep the reference instead of asking in {method}.",
    "UNI-PERF-002": "Take objects that {method} makes each frame from a pool, or make them once.",
    "UE5-BASE-001": "Call Super::{method}(...) first in {cls}::{method}.",
    "UNI-ASYNC-001": "Yield inside the endless loop of {method}.",
    "AXM-PERF-001": "Look the child up once, when {cls} enters, and keep the pointer.",
    "AXM-MEM-001": "Release in {cls}'s destructor what it retains.",
    "AXM-EVENT-001": "Remove {cls}'s listeners when it exits.",
}


def _issue(rows: DataFrame, rule: str, severity: str, detail: Column | None = None, method: Column | None = None) -> DataFrame:
    d = F.lit("") if detail is None else detail
    m = (F.col("name") if "name" in rows.columns else F.lit("")) if method is None else method
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "cls", m.alias("method"), "file_path", d.alias("detail"))


def _each(rows: DataFrame, body: Column, patterns: list[str]) -> DataFrame:
    """One row per pattern that the body matches."""
    hits = F.filter(F.array(*[F.when(body.rlike(p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())
    return rows.select("*", F.explode(hits).alias("hit"))


def unity_frame_rules(methods: DataFrame) -> DataFrame:
    """Heavy calls and allocations in per-frame methods, or in a helper of the same class that one calls directly."""
    frame = methods.filter(F.col("name").isin(*UNITY_FRAME_METHODS)).select("cls", "name", "file_path", "body_text")
    called = frame.select("cls", F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"(?<![\w.])(\w+)\s*\("), F.lit(1)))).alias("name"))
    helper = methods.select("cls", "name", "file_path", "body_text").join(called.filter(~F.col("name").isin(*UNITY_FRAME_METHODS)), ["cls", "name"])
    scope = frame.withColumn("context", F.col("name")).unionByName(helper.select("cls", F.col("caller").alias("name"), "file_path", "body_text", F.concat_ws(" > ", "caller", "name").alias("context")))
    heavy = scope.select("cls", "name", "file_path", F.explode(F.regexp_extract_all("body_text", F.lit(r"\b(" + "|".join(UNITY_HEAVY_CALLS) + r")\s*(?:<[^<>]*>)?\s*\("), F.lit(1))).alias("hit"))
    camera = scope.filter(F.col("body_text").rlike(r"\bCamera\.main\b")).select("cls", "name", "file_path", F.lit("Camera.main").alias("hit"))
    made = scope.select("cls", "name", "file_path", F.explode(F.concat(F.regexp_extract_all("body_text", F.lit(r"\b(Instantiate)\s*(?:<[^<>]*>)?\s*\("), F.lit(1)), F.regexp_extract_all("body_text", F.lit(r"\bnew\s+([A-Za-z_][\w.]*(?:<[^()]*>)?)"), F.lit(1)))).alias("hit"))
    made = made.filter(~F.col("hit").isin(*UNITY_VALUE_TYPES))
    return _issue(heavy.unionByName(camera), "UNI-PERF-001", "Warning", F.col("hit")).unionByName(_issue(made, "UNI-PERF-002", "Warning", F.col("hit")))


def unity_coroutine_rules(methods: DataFrame) -> DataFrame:
    """Endless loops that never yield (one issue a method) and heavy calls (one each) in IEnumerator methods."""
    rows = methods.filter(F.col("return_type").contains("IEnumerator"))
    loops = F.regexp_extract_all("body_text", F.lit(r"while\s*\(\s*true\s*\)\s*\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1))
    stuck = rows.filter(F.exists(loops, lambda b: ~b.rlike(r"\byield\b")))
    names = "|".join(n.replace(".", r"\.") for n in sorted(UNITY_HEAVY_IN_COROUTINE, key=len, reverse=True))
    heavy = rows.select("*", F.explode(F.regexp_extract_all("body_text", F.lit(rf"\b({names})\b"), F.lit(1))).alias("hit"))
    return _issue(stuck, "UNI-ASYNC-001", "Error").unionByName(_issue(heavy, "UNI-ASYNC-002", "Warning", F.col("hit")))


def ue_rules(methods: DataFrame, members: DataFrame) -> DataFrame:
    """Rules over Unreal classes."""
    body, low = F.col("body_text"), F.lower("name")
    tick = low.contains("tick")
    lower_specifiers = F.transform("specifiers", lambda s: F.lower(s))
    ability = methods.filter(F.exists("bases", lambda b: b.contains("GameplayAbility")))
    named = lambda c: F.array_contains(lower_specifiers, c)
    exposed = methods.filter(named("blueprintcallable")).groupBy("cls").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path")).filter("n > 10")
    const = F.concat(F.coalesce(body, F.lit("")), F.coalesce("return_type", F.lit(""))).contains("const")
    silent = members.filter(F.col("is_replicated") & ~F.exists(lower_specifiers, lambda s: s.contains("replicatedusing")) & ~F.col("type").isin(*UE_PLAIN_TYPES))
    parts = [
        _issue(_each(methods.filter(tick), body, [rf"\b{op}\b" for op in UE_HEAVY_IN_TICK]), "UE5-PERF-001", "Error", F.replace("hit", F.lit(r"\b"), F.lit(""))),
        _issue(methods.filter(~tick & (low.contains("beginplay") | low.contains("nativeconstruct")) & body.contains("LoadObject")), "UE5-PERF-002", "Warning"),
        _issue(methods.filter(F.col("name").isin(*UE_OVERRIDES) & (F.length(body) > 0) & ~F.contains(body, F.concat(F.lit("Super::"), "name"))), "UE5-BASE-001", "Warning"),
        _issue(ability.filter(F.col("name").isin(*UE_ABILITY_METHODS) & (F.length(body) > 0) & ~body.contains("CommitAbility")), "UE5-GAS-001", "Warning"),
        _issue(_each(ability, body, UE_EXPENSIVE), "UE5-GAS-002", "Warning", F.col("hit")),
        _issue(exposed, "UE5-GAS-003", "Info", F.col("n").cast("string"), F.lit("")),
        _issue(methods.filter(named("blueprintpure") & ~const & ~F.coalesce("return_type", F.lit("")).isin("void", "")), "UE5-GAS-004", "Info"),
        _issue(silent, "UE5-NET-001", "Info", F.col("type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _bare(name: Column) -> Column:
    return F.lower(F.when(F.substring(name, 1, 1).isin("U", "A", "F", "I"), F.substring(name, 2, 1 << 30)).otherwise(name))


def blueprint_rules(assets: DataFrame, types: DataFrame, methods: DataFrame, engine_bases: list[str]) -> DataFrame:
    """Assets (asset, parent, overrides) whose parent class is unknown, and K2 overrides that their parent doesn't have."""
    known = types.select(_bare(F.col("name")).alias("bare")).distinct()
    parents = assets.withColumn("bare", _bare(F.col("parent")))
    orphan = parents.filter(~F.col("parent").isin(*engine_bases)).join(known, "bare", "left_anti")
    have = methods.select(_bare(F.col("cls")).alias("bare"), F.col("name").alias("override")).distinct()
    overrides = parents.join(known, "bare", "left_semi").select("asset", "parent", "bare", F.explode("overrides").alias("override"))
    missing = overrides.join(have, ["bare", "override"], "left_anti")
    shaped = lambda d: d.withColumns({"cls": F.col("parent"), "file_path": F.col("asset")})
    return _issue(shaped(orphan), "UE5-BP-001", "Warning", F.col("asset"), F.lit("")).unionByName(_issue(shaped(missing), "UE5-BP-002", "Warning", F.col("asset"), F.col("override")))


def broken_script_rule(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Script GUIDs that no script has, each once."""
    from cordage.operators.reports import broken_references

    rows = broken_references(refs, known, "guid")
    return _issue(rows.select(F.col("guid").alias("cls"), F.col("asset").alias("file_path")), "UNI-ASSET-001", "Warning", F.col("cls"), F.lit(""))


def axmol_rules(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Rules over C++ files (path, text) and methods of a cocos-like engine."""
    text = F.col("text")
    owner = F.coalesce(F.nullif(F.regexp_extract("text", r"\b(\w+)::\w+\s*\(", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"\b(?:class|struct)\s+(\w+)", 1), F.lit("")), F.regexp_extract("path", r"([^/\\]+?)(?:\.\w+)?$", 1))
    rows = files.select("text", F.col("path").alias("file_path"), owner.alias("cls"))
    child = methods.filter("name = 'update'").withColumn("hit", F.regexp_extract("body_text", r"\b(getChildBy(?:Name|Tag))\s*(?:<[^<>]*>)?\s*\(", 1)).filter("hit != ''")
    kept = rows.filter(text.rlike(r"->\s*retain\s*\(\s*\)") & ~text.rlike(r"->\s*release\s*\(\s*\)"))
    listening = rows.filter(text.rlike(r"\baddEventListenerWith\w+") & ~text.rlike(r"\bremoveEventListener\w*|\bremoveAllEventListeners\b"))
    none = F.lit("")
    parts = [_issue(child, "AXM-PERF-001", "Warning", F.col("hit")), _issue(kept, "AXM-MEM-001", "Warning", none, none), _issue(listening, "AXM-EVENT-001", "Info", none, none)]
    return reduce(DataFrame.unionByName, parts)


def cycle_rule(cycles: DataFrame) -> DataFrame:
    """One issue per cycle (path), for its first node."""
    rows = cycles.select(F.col("path")[0].cast("string").alias("cls"), F.lit("").alias("file_path"), F.array_join(F.transform("path", lambda x: x.cast("string")), " → ").alias("p"))
    return _issue(rows, "GEN-ARCH-001", "Warning", F.col("p"), F.lit(""))


def with_fixes(issues: DataFrame) -> DataFrame:
    """Adds fix, null where a rule has none."""
    texts = F.create_map(*[F.lit(x) for kv in FIXES.items() for x in kv])
    return issues.withColumn("fix", F.replace(F.replace(F.try_element_at(texts, F.col("rule_id")), F.lit("{cls}"), F.coalesce("cls", F.lit(""))), F.lit("{method}"), F.coalesce("method", F.lit(""))))


def type_patterns(types: DataFrame, methods: DataFrame, members: DataFrame) -> DataFrame:
    """cls, pattern, category, confidence: architectural patterns of Unreal classes (types: name, base_types)."""
    per_member = members.groupBy(F.col("cls").alias("name")).agg(F.count_if(F.col("type").contains("Component")).alias("components"), F.count_if(F.col("type").rlike("Delegate|FOn|Event|Multicast")).alias("delegates"), F.count_if("is_replicated").alias("replicated"))
    rows = types.join(per_member, "name", "left").na.fill(0, ["components", "delegates", "replicated"])
    base = lambda *words: F.exists("base_types", lambda b: reduce(lambda x, y: x | y, [b.contains(w) for w in words]))
    interface = F.exists("base_types", lambda b: b.rlike("^I[A-Z]"))
    rules = [
        ("Subsystem Pattern", "architecture", base("Subsystem")), ("Component Composition", "architecture", F.col("components") >= 2), ("GAS Ability", "architecture", base("GameplayAbility")),
        ("GAS Attribute Set", "data", base("AttributeSet")), ("Event Delegate", "communication", F.col("delegates") > 0), ("Network Replication", "communication", F.col("replicated") > 0),
        ("Interface Implementation", "architecture", interface), ("Behavior Tree Node", "architecture", base("BTTask", "BTService", "BTDecorator")),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit("high").alias("confidence"))) for p, c, test in rules]), lambda x: x.isNotNull())
    return rows.select(F.col("name").alias("cls"), F.explode(found).alias("m")).select("cls", "m.*")


def script_patterns(types: DataFrame, files: DataFrame) -> DataFrame:
    """The same for Unity scripts: the last three look at the whole file, so all its classes match."""
    rows = types.join(files.select(F.col("path").alias("file_path"), "text"), "file_path")
    mono = F.exists("base_types", lambda b: b.contains("MonoBehaviour"))
    text = F.col("text")
    rules = [
        ("Singleton Pattern", "architecture", "high", mono & text.rlike(r"static\s+\w+\s+(?:Instance|instance|_instance)\b")), ("Coroutine Workflow", "lifecycle", "high", mono & (F.regexp_count("text", F.lit(r"IEnumerator\s+\w+")) >= 2)),
        ("ScriptableObject Data", "data", "high", F.exists("base_types", lambda b: b == "ScriptableObject")), ("Event/Observer", "communication", "medium", text.rlike(r"\bUnityEvent|event\s+\w+|Action<|(?i)OnNotify|Subscribe|AddListener|observer")),
        ("Object Pooling", "architecture", "medium", text.rlike("(?i)Queue<|Stack<|pool")), ("State Machine", "architecture", "medium", text.rlike(r"(?i)enum\s+\w*State|currentState|_state\s*=")),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit(k).alias("confidence"))) for p, c, k, test in rules]), lambda x: x.isNotNull())
    return rows.select(F.col("name").alias("cls"), F.explode(found).alias("m")).select("cls", "m.*")


def all_issues(methods: DataFrame, members: DataFrame, files: DataFrame, assets: DataFrame, types: DataFrame, refs: DataFrame, known: DataFrame, cycles: DataFrame, engine_bases: list[str]) -> DataFrame:
    """The issues of every rule, as a bag."""
    parts = [unity_frame_rules(methods), unity_coroutine_rules(methods), broken_script_rule(refs, known), ue_rules(methods, members), blueprint_rules(assets, types, methods, engine_bases), axmol_rules(files, methods), cycle_rule(cycles)]
    return reduce(DataFrame.unionByName, parts)


def watch_summary(issues: DataFrame) -> DataFrame:
    """errors, warnings, cycles: what a change watch reports; cycles are counted apart."""
    cycle = F.col("rule_id") == "GEN-ARCH-001"
    return issues.agg(F.count_if((F.col("severity") == "Error") & ~cycle).alias("errors"), F.count_if((F.col("severity") == "Warning") & ~cycle).alias("warnings"), F.count_if(cycle).alias("cycles"))
