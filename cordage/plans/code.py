"""Code relations (method, member, file, type, asset) bound to tables, and the same in SQL.

Every document is a method: a statement chosen by its id, followed by its whole text as a comment, so that rules read texts of
real lengths. Thirty-two documents make a class. Pages are members, parts are assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.plans.bindings import table

CLASS_SIZE = 32
BODIES = [
    "GetComponent<Rigidbody>(); Spin();",
    "items = new List<int>(); Instantiate(prefab);",
    "while (true) { Step(); }",
    'while (true) { yield return null; } r = Resources.Load("a");',
    "w->SpawnActor(c); o = NewObject<UThing>();",
    "t = LoadObject<UTexture>(0);",
    "Super::BeginPlay(); Start();",
    "CommitAbility(); GetAllActorsOfClass(w);",
    'c = getChildByName("a");',
    "node->retain();",
    "addEventListenerWithSceneGraphPriority(l, this);",
    "node->retain(); node->release();",
    "return const_value;",
    "Camera.main.x = new Vector3(0, 0, 0);",
    "FindObjectOfType<Enemy>(); Spin();",
    "if (ready) { Go(); }",
]
NAMES = ["Update", "Spin", "BeginPlay", "Tick", "ActivateAbility", "NativeConstruct", "update", "LateUpdate"]
RETURNS = ["void", "IEnumerator", "int32"]
SPECIFIERS = [["BlueprintCallable"], ["BlueprintCallable"], ["BlueprintPure"], [], ["BlueprintCallable", "Server"]]
METHOD_BASES = [["UGameplayAbility"], ["AActor"], []]
TYPE_BASES = [["UGameInstanceSubsystem"], ["UGameplayAbility", "IHit"], ["UAttributeSet"], ["MonoBehaviour"], ["ScriptableObject"], ["UBTTask_Base"]]
MEMBER_TYPES = ["UTexture*", "bool", "int32", "FOnHit", "USceneComponent*", "FVector"]
MEMBER_SPECIFIERS = [["ReplicatedUsing=OnRep"], ["EditAnywhere"], ["Transient"]]
ENGINE_BASES = ["UC7"]


def _pick(values: list, at: Column) -> Column:
    one = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.element_at(F.array(*[one(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def _by(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def methods(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, cls, name, return_type, specifiers, bases, body_text, file_path."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    cls = F.concat(F.lit("C"), _by("doc_id", CLASS_SIZE).cast("string"))
    body = F.concat(_pick(BODIES, F.col("doc_id")), F.lit(" // "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    return d.select(
        "doc_id", cls.alias("cls"), _pick(NAMES, _by("doc_id", 16)).alias("name"), _pick(RETURNS, _by("doc_id", 3)).alias("return_type"), _pick(SPECIFIERS, F.col("doc_id")).alias("specifiers"),
        _pick(METHOD_BASES, _by("doc_id", 2)).alias("bases"), body.alias("body_text"), F.concat(F.lit("src/"), cls, F.lit(".cpp")).alias("file_path"),
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    """cls, name, type, is_replicated, specifiers, file_path."""
    p = table(spark, sf, "pages").select("page_id")
    cls = F.concat(F.lit("C"), _by("page_id", 8).cast("string"))
    return p.select(cls.alias("cls"), F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("name"), _pick(MEMBER_TYPES, F.col("page_id")).alias("type"), (F.col("page_id") % 2 == 0).alias("is_replicated"), _pick(MEMBER_SPECIFIERS, _by("page_id", 2)).alias("specifiers"), F.concat(F.lit("src/"), cls, F.lit(".h")).alias("file_path"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """path, text: one file per method."""
    m = methods(spark, sf)
    return m.select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".cpp")).alias("path"), F.concat(F.lit("void "), "cls", F.lit("::run() { "), "body_text", F.lit(" }")).alias("text"))


def types(spark: SparkSession, sf: str) -> DataFrame:
    """name, base_types, file_path: a class's file is its first method's."""
    k = table(spark, sf, "documents").select(_by("doc_id", CLASS_SIZE).alias("k")).distinct()
    return k.select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("name"), _pick(TYPE_BASES, F.col("k")).alias("base_types"), F.concat(F.lit("src/f"), (F.col("k") * CLASS_SIZE).cast("string"), F.lit(".cpp")).alias("file_path"))


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """asset, parent, overrides."""
    p = table(spark, sf, "part").select("p_partkey")
    return p.select(F.concat(F.lit("BP_"), F.col("p_partkey").cast("string")).alias("asset"), F.concat(F.lit("UC"), (F.col("p_partkey") % 500).cast("string")).alias("parent"), F.array(_pick(NAMES, F.col("p_partkey")), F.lit("K2_Foo")).alias("overrides"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values: list, at: str) -> str:
    one = lambda v: ("[" + ", ".join(map(_text, v)) + "]" if v else "CAST([] AS VARCHAR[])") if isinstance(v, list) else _text(v)
    return f"list_extract([{', '.join(map(one, values))}], CAST(({at}) % {len(values)} AS INTEGER) + 1)"


METHODS = (
    f"method AS (SELECT doc_id, 'C' || (doc_id // {CLASS_SIZE}) AS cls, {_list(NAMES, 'doc_id // 16')} AS name, {_list(RETURNS, 'doc_id // 3')} AS return_type, {_list(SPECIFIERS, 'doc_id')} AS specifiers, "
    f"{_list(METHOD_BASES, 'doc_id // 2')} AS bases, {_list(BODIES, 'doc_id')} || ' // ' || replace(coalesce(text, ''), chr(10), ' ') AS body, 'src/C' || (doc_id // {CLASS_SIZE}) || '.cpp' AS file_path FROM documents)"
)
MEMBERS = f"member AS (SELECT 'C' || (page_id // 8) AS cls, 'm' || page_id AS name, {_list(MEMBER_TYPES, 'page_id')} AS type, page_id % 2 = 0 AS is_replicated, {_list(MEMBER_SPECIFIERS, 'page_id // 2')} AS specifiers, 'src/C' || (page_id // 8) || '.h' AS file_path FROM pages)"
FILES = "file AS (SELECT 'src/f' || doc_id || '.cpp' AS path, cls, 'void ' || cls || '::run() { ' || body || ' }' AS text FROM method)"
TYPES = f"type AS (SELECT 'C' || k AS name, {_list(TYPE_BASES, 'k')} AS base_types, 'src/f' || k * {CLASS_SIZE} || '.cpp' AS file_path FROM (SELECT DISTINCT doc_id // {CLASS_SIZE} AS k FROM documents))"
ASSETS = f"asset AS (SELECT 'BP_' || p_partkey AS asset, 'UC' || (p_partkey % 500) AS parent, [{_list(NAMES, 'p_partkey')}, 'K2_Foo'] AS overrides FROM part)"

# The 19 rules in SQL, over those relations and ``cyc`` (path).
_SCOPE = r"""frame AS (SELECT doc_id, cls, name, file_path, body FROM method WHERE name IN ('Update', 'FixedUpdate', 'LateUpdate')),
called AS (SELECT cls, name AS caller, unnest(list_distinct(regexp_extract_all(body, '(^|[^\w.])(\w+)\s*\(', 2))) AS name FROM frame),
scope AS (SELECT cls, name, file_path, body FROM frame UNION ALL SELECT m.cls, c.caller, m.file_path, m.body FROM method m JOIN called c ON m.cls = c.cls AND m.name = c.name WHERE m.name NOT IN ('Update', 'FixedUpdate', 'LateUpdate'))"""
_HEAVY = r"'\b(GetComponent|Find|FindGameObjectWithTag|FindWithTag|FindObjectsOfType|FindObjectOfType)\s*(?:<[^<>]*>)?\s*\('"
_LOOP = r"'while\s*\(\s*true\s*\)\s*\{((?:[^{}]|\{[^{}]*\})*)\}'"
_ABILITY = "len(list_filter(bases, lambda b: contains(b, 'GameplayAbility'))) > 0"
_TICK = "contains(lower(name), 'tick')"
_RULES = [
    ("UNI-PERF-001", "Warning", f"SELECT cls, name, file_path, unnest(regexp_extract_all(body, {_HEAVY}, 1)) FROM scope UNION ALL SELECT cls, name, file_path, 'Camera.main' FROM scope WHERE regexp_matches(body, '\\bCamera\\.main\\b')"),
    ("UNI-PERF-002", "Warning", r"SELECT * FROM (SELECT cls, name, file_path, unnest(list_concat(regexp_extract_all(body, '\b(Instantiate)\s*(?:<[^<>]*>)?\s*\(', 1), regexp_extract_all(body, '\bnew\s+([A-Za-z_][\w.]*(?:<[^()]*>)?)', 1))) AS hit FROM scope) WHERE hit NOT IN ('Vector2', 'Vector3', 'Vector4', 'Quaternion', 'Color', 'Ray')"),
    ("UNI-ASYNC-001", "Error", f"SELECT cls, name, file_path, '' FROM method WHERE contains(return_type, 'IEnumerator') AND len(list_filter(regexp_extract_all(body, {_LOOP}, 1), lambda b: NOT regexp_matches(b, '\\byield\\b'))) > 0"),
    ("UNI-ASYNC-002", "Warning", r"SELECT cls, name, file_path, unnest(regexp_extract_all(body, '\b(Resources\.LoadAll|FindObjectsOfType|FindObjectOfType|GameObject\.Find|Resources\.Load)\b', 1)) FROM method WHERE contains(return_type, 'IEnumerator')"),
    ("UNI-ASSET-001", "Warning", "SELECT CAST(l_partkey AS VARCHAR), '', min(CAST(l_orderkey AS VARCHAR)), CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY l_partkey"),
    ("UE5-PERF-001", "Error", f"SELECT cls, name, file_path, op FROM method, (SELECT unnest(['SpawnActor', 'NewObject', 'FindObject', 'LoadObject', 'GetAllActorsOfClass']) AS op) WHERE {_TICK} AND regexp_matches(body, '\\b' || op || '\\b')"),
    ("UE5-PERF-002", "Warning", f"SELECT cls, name, file_path, '' FROM method WHERE NOT {_TICK} AND (contains(lower(name), 'beginplay') OR contains(lower(name), 'nativeconstruct')) AND contains(body, 'LoadObject')"),
    ("UE5-BASE-001", "Warning", "SELECT cls, name, file_path, '' FROM method WHERE name IN ('BeginPlay', 'EndPlay', 'Tick', 'OnConstruction') AND length(body) > 0 AND NOT contains(body, 'Super::' || name)"),
    ("UE5-GAS-001", "Warning", f"SELECT cls, name, file_path, '' FROM method WHERE {_ABILITY} AND name IN ('ActivateAbility', 'K2_ActivateAbility') AND length(body) > 0 AND NOT contains(body, 'CommitAbility')"),
    ("UE5-GAS-002", "Warning", f"SELECT cls, name, file_path, op FROM method, (SELECT unnest(['\\bGetAllActorsOfClass\\b', '\\bUGameplayStatics::GetAllActors\\b', '\\bFindObject<\\b', '\\bLoadObject<\\b']) AS op) WHERE {_ABILITY} AND regexp_matches(body, op)"),
    ("UE5-GAS-003", "Info", "SELECT cls, '', min(file_path), CAST(count(*) AS VARCHAR) FROM method WHERE list_contains(specifiers, 'BlueprintCallable') GROUP BY cls HAVING count(*) > 10"),
    ("UE5-GAS-004", "Info", "SELECT cls, name, file_path, '' FROM method WHERE list_contains(specifiers, 'BlueprintPure') AND NOT contains(body || return_type, 'const') AND return_type NOT IN ('void', '')"),
    ("UE5-NET-001", "Info", "SELECT cls, name, file_path, type FROM member WHERE is_replicated AND len(list_filter(specifiers, lambda s: contains(lower(s), 'replicatedusing'))) = 0 AND type NOT IN ('bool', 'float', 'int32', 'uint8')"),
    ("UE5-BP-001", "Warning", "SELECT parent, '', asset, asset FROM asset WHERE parent <> 'UC7' AND substring(parent, 2) NOT IN (SELECT name FROM type)"),
    ("UE5-BP-002", "Warning", "SELECT parent, o, asset, asset FROM (SELECT parent, asset, unnest(overrides) AS o FROM asset WHERE substring(parent, 2) IN (SELECT name FROM type)) WHERE (substring(parent, 2), o) NOT IN (SELECT cls, name FROM method)"),
    ("AXM-PERF-001", "Warning", r"SELECT * FROM (SELECT cls, name, file_path, regexp_extract(body, '\b(getChildBy(?:Name|Tag))\s*(?:<[^<>]*>)?\s*\(', 1) AS hit FROM method WHERE name = 'update') WHERE hit <> ''"),
    ("AXM-MEM-001", "Warning", r"SELECT cls, '', path, '' FROM file WHERE regexp_matches(text, '->\s*retain\s*\(\s*\)') AND NOT regexp_matches(text, '->\s*release\s*\(\s*\)')"),
    ("AXM-EVENT-001", "Info", r"SELECT cls, '', path, '' FROM file WHERE regexp_matches(text, '\baddEventListenerWith\w+') AND NOT regexp_matches(text, '\bremoveEventListener\w*|\bremoveAllEventListeners\b')"),
    ("GEN-ARCH-001", "Warning", "SELECT CAST(path[1] AS VARCHAR), '', '', array_to_string(list_transform(path, lambda x: CAST(x AS VARCHAR)), ' → ') FROM cyc"),
]
ISSUES = ", ".join([METHODS, MEMBERS, FILES, TYPES, ASSETS, _SCOPE, "issue AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, * FROM ({q}) AS t(cls, method, file_path, detail)" for r, s, q in _RULES) + ")"])

_MEMBER_COUNTS = "mc AS (SELECT cls, count(*) FILTER (contains(type, 'Component')) AS components, count(*) FILTER (regexp_matches(type, 'Delegate|FOn|Event|Multicast')) AS delegates, count(*) FILTER (is_replicated) AS replicated FROM member GROUP BY cls)"
_BASE = lambda *words: "len(list_filter(base_types, lambda b: " + " OR ".join(f"contains(b, '{w}')" for w in words) + ")) > 0"
_PATTERNS = [
    ("Subsystem Pattern", "architecture", "high", _BASE("Subsystem")),
    ("Component Composition", "architecture", "high", "components >= 2"),
    ("GAS Ability", "architecture", "high", _BASE("GameplayAbility")),
    ("GAS Attribute Set", "data", "high", _BASE("AttributeSet")),
    ("Event Delegate", "communication", "high", "delegates > 0"),
    ("Network Replication", "communication", "high", "replicated > 0"),
    ("Interface Implementation", "architecture", "high", "len(list_filter(base_types, lambda b: regexp_matches(b, '^I[A-Z]'))) > 0"),
    ("Behavior Tree Node", "architecture", "high", _BASE("BTTask", "BTService", "BTDecorator")),
    ("Singleton Pattern", "architecture", "high", _BASE("MonoBehaviour") + r" AND regexp_matches(text, 'static\s+\w+\s+(?:Instance|instance|_instance)\b')"),
    ("Coroutine Workflow", "lifecycle", "high", _BASE("MonoBehaviour") + r" AND len(regexp_extract_all(text, 'IEnumerator\s+\w+')) >= 2"),
    ("ScriptableObject Data", "data", "high", "list_contains(base_types, 'ScriptableObject')"),
    ("Event/Observer", "communication", "medium", r"regexp_matches(text, '\bUnityEvent|event\s+\w+|Action<|(?i:OnNotify|Subscribe|AddListener|observer)')"),
    ("Object Pooling", "architecture", "medium", "regexp_matches(text, '(?i)Queue<|Stack<|pool')"),
    ("State Machine", "architecture", "medium", r"regexp_matches(text, '(?i)enum\s+\w*State|currentState|_state\s*=')"),
]
PATTERNS = ", ".join([METHODS, MEMBERS, FILES, TYPES, _MEMBER_COUNTS, "x AS (SELECT type.name, base_types, text, coalesce(components, 0) AS components, coalesce(delegates, 0) AS delegates, coalesce(replicated, 0) AS replicated FROM type LEFT JOIN mc ON mc.cls = type.name JOIN file ON file.path = type.file_path)", "pattern AS (" + " UNION ALL ".join(f"SELECT name AS cls, '{p}' AS pattern, '{c}' AS category, '{k}' AS confidence FROM x WHERE {test}" for p, c, k, test in _PATTERNS) + ")"])
