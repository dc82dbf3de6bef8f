"""Small files in the formats that the sources read."""

import pytest
from pyspark.sql import functions as F

from cordage.operators import lint as L
from cordage.sources import assets as A
from cordage.sources import trees as S

CS = {
    "Hero.cs": """
namespace Game.Core {
  // class Ghost : MonoBehaviour { }
  public partial class Hero : MonoBehaviour, IUnit {
    public static Hero Instance;
    [SerializeField] private List<Weapon> weapons = new List<Weapon>();
    public Stats Stats { get; set; }
    void Update() { Helper(); var p = new Vector3(1, 2, 3); var b = new Bullet(); }
    void Helper() { GetComponent<Body>(); Camera.main.Shake(); }
    IEnumerator Loop() { while (true) { Step(); } }
    IEnumerator Fine() { while (true) { yield return null; } GameObject.Find("x"); }
    public int Damage(Weapon weapon, int n) => weapon.Power * n;
  }
}""",
    "Hero.Part.cs": "namespace Game.Core { public partial class Hero : MonoBehaviour { private Shield shield; } public class Box<T> : Base<T> where T : X { } }",
}
CPP = {
    "Hero.h": """
UCLASS()
class GAME_API AHero : public ACharacter, public IUnit {
  GENERATED_BODY()
public:
  UPROPERTY(Replicated) UHealth* Health;
  UPROPERTY(ReplicatedUsing=OnRep_Mana) UMana* Mana;
  UFUNCTION(BlueprintPure) int32 GetLevel();
  virtual void BeginPlay() override;
  virtual void Tick(float Dt) override;
private:
  int32 Level;
};
enum class EState { Idle };
""",
    "Hero.cpp": """
void AHero::BeginPlay() { LoadObject(x); }
void AHero::Tick(float Dt) { Super::Tick(Dt); GetWorld()->SpawnActor(x); NewObject<UFoo>(); }
int32 AHero::GetLevel() { return Level; }
""",
    "Scene.cpp": "void Scene::update(float d) { getChildByName(\"a\"); }\nvoid Scene::init() { node->retain();\n  addEventListenerWithSceneGraphPriority(CC_CALLBACK_1(Scene::onTouch), this); }",
    "build/Skip.cpp": "class Skip { };",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {**CS, **CPP}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return f"file://{root}"


def test_csharp(spark, tree):
    f = S.files(spark, tree, "*.cs")
    types = {(r.name, r.kind, r.namespace, tuple(r.base_types)) for r in S.types_of(f).collect()}
    assert types == {("Hero", "class", "Game.Core", ("MonoBehaviour", "IUnit")), ("Hero", "class", "Game.Core", ("MonoBehaviour",)), ("Box", "class", "Game.Core", ("Base",))}
    members = {(r.cls, r.name, r.type) for r in S.members_of(f).collect()}
    assert {("Hero", "Instance", "Hero"), ("Hero", "weapons", "List<Weapon>"), ("Hero", "Stats", "Stats"), ("Hero", "shield", "Shield")} <= members
    methods = S.methods_of(f)
    assert {r.name for r in methods.collect()} == {"Update", "Helper", "Loop", "Fine", "Damage"}
    edges = {(r.src, r.dst, r.kind) for r in S.edges_of(S.types_of(f), S.members_of(f), methods, deep=True).collect()}
    assert {("Hero", "IUnit", "Inheritance"), ("Hero", "Weapon", "Field"), ("Hero", "Weapon", "Parameter"), ("Hero", "Bullet", "Field"), ("Hero", "Shield", "Field")} <= edges
    calls = {(r.caller_method, r.receiver, r.callee_method) for r in S.calls_in(methods).collect()}
    assert ("Update", "", "Helper") in calls


def test_unity_rules(spark, tree):
    m = S.methods_of(S.files(spark, tree, "*.cs"))
    got = sorted((r.rule_id, r.method, r.detail) for r in L.unity_frame_rules(m).unionByName(L.unity_coroutine_rules(m)).collect())
    assert got == [("UNI-ASYNC-001", "Loop", ""), ("UNI-ASYNC-002", "Fine", "GameObject.Find"), ("UNI-PERF-001", "Update", "Camera.main"), ("UNI-PERF-001", "Update", "GetComponent"), ("UNI-PERF-002", "Update", "Bullet")]
    fixed = {r.rule_id: r.fix for r in L.with_fixes(L.unity_coroutine_rules(m)).collect()}
    assert fixed["UNI-ASYNC-002"] is None and "Loop" in fixed["UNI-ASYNC-001"]
    types, files = S.types_of(S.files(spark, tree, "Hero.cs")), S.files(spark, tree, "Hero.cs")
    assert {r.pattern for r in L.script_patterns(types, files).collect()} == {"Singleton Pattern", "Coroutine Workflow"}


def test_cpp(spark, tree):
    f = S.files(spark, tree, "*.h", "*.cpp")
    types = {(r.name, r.kind, tuple(r.base_types)) for r in S.types_of(f, "cpp").collect()}
    assert types == {("AHero", "class", ("ACharacter", "IUnit")), ("EState", "enum", ())}
    members = {(r.name, r.type, r.access, r.is_replicated) for r in S.members_of(f, "cpp").collect()}
    assert {("Health", "UHealth*", "public", True), ("Level", "int32", "private", False)} <= members
    methods = S.merged_methods(S.methods_of(f, "cpp"))
    issues = {(r.rule_id, r.method, r.detail) for r in L.ue_rules(methods, S.members_of(f, "cpp")).collect()}
    assert issues == {("UE5-PERF-001", "Tick", "SpawnActor"), ("UE5-PERF-001", "Tick", "NewObject"), ("UE5-PERF-002", "BeginPlay", ""), ("UE5-BASE-001", "BeginPlay", ""), ("UE5-GAS-004", "GetLevel", ""), ("UE5-NET-001", "Health", "UHealth*")}
    axmol = {(r.rule_id, r.cls) for r in L.axmol_rules(f, methods).collect()}
    assert axmol == {("AXM-PERF-001", "Scene"), ("AXM-MEM-001", "Scene"), ("AXM-EVENT-001", "Scene")}
    bound = A.event_bindings(f).collect()
    assert [(r.line, r.event, r.callback) for r in bound] == [(3, "addEventListenerWithSceneGraphPriority", "Scene::onTouch")]
    assert {r.cls: r.file_path.rsplit("/", 1)[1] for r in A.class_file(S.methods_of(f, "cpp").filter("access = ''")).collect()} == {"AHero": "Hero.cpp", "Scene": "Scene.cpp"}


def test_ignored(spark):
    df = spark.createDataFrame([("/a/Gen/x.cs",), ("/a/b/Foo.Gen.cs",), ("/a/c.cs",)], "p string")
    assert [r[0] for r in df.select(S.ignored(F.col("p"), ["**/gen/**", "*.GEN.cs"])).collect()] == [True, True, False]


def test_unity_assets(spark, tmp_path):
    g1, g2 = "a" * 32, "b" * 32
    (tmp_path / "Hero.cs.meta").write_text(f"fileFormatVersion: 2\nguid: {g1}\n")
    (tmp_path / "a.prefab").write_text(f"m_Script: {{fileID: 11500000, guid: {g1}, type: 3}}\nm_Script: {{fileID: 11500000, guid: {g2}, type: 3}}\nm_PersistentCalls:\n  m_Calls:\n  - m_TargetAssemblyTypeName: Hero, Assembly\n    m_MethodName: OnClick\n")
    (tmp_path / "c.controller").write_text("%YAML\n--- !u!91 &1\nAnimatorController:\n  m_Name: C\n--- !u!1107 &2\nAnimatorStateMachine:\n  m_Name: Base\n    m_State: {fileID: 3}\n--- !u!1102 &3\nAnimatorState:\n  m_Name: Idle\n  m_Motion: {fileID: 4}\n--- !u!206 &4\nBlendTree:\n  m_Name: Blend\n")
    (tmp_path / "n.md").write_text("---\ntitle: Hero\ntype: class\ncreated: 2024-01-01\nupdated: 2024-02-01\nsource_fingerprint: f\nstale: false\n---\n\nBody")
    root = f"file://{tmp_path}"
    known, refs = A.guid_map(spark, root), A.guid_references(spark, root)
    assert [(r.guid, r.name) for r in known.collect()] == [(g1, "Hero")] and refs.count() == 2
    assert [r.cls for r in L.broken_script_rule(refs, known).collect()] == [g2]
    assert [(r.target, r.method) for r in A.persistent_calls(spark, root).collect()] == [("Hero", "OnClick")]
    assert [tuple(r)[1:] for r in A.animator_states(A.animator_blocks(spark, root)).collect()] == [("Base", "Idle", "blend")]
    note = A.notes(spark, root).first()
    assert (note.id, note.fingerprint, note.stale, note.body) == ("class:Hero", "f", False, "Body")


def test_binary_assets(spark, tmp_path):
    (tmp_path / "BP_Hero.uasset").write_bytes(b"\xc1\x83\x2a\x9e" + b"\0" * 300 + b"NativeParentClass\0/Script/Game.AHero\0/Game/Art/Sword\0K2_Activate\0Ability.Melee.Slash\0/Script/Engine.Foo_C\0")
    (tmp_path / "BT_Boss.uasset").write_bytes(b"\0" * 300 + b"BTTask_Attack\0BTTask_Attack\0")
    (tmp_path / "GA_Jump.uasset").write_text(A.LFS_HEADER + "\noid sha256:0\nsize 1\n")
    a = A.binary_assets(spark, f"file://{tmp_path}")
    assert {(r.name, r.is_stub) for r in a.collect()} == {("BP_Hero", False), ("BT_Boss", False), ("GA_Jump", True)}
    assert {r.cls for r in A.class_references(a).collect()} == {"AHero", "Foo"} and A.path_references(a).first().ref == "/Game/Art/Sword"
    b = A.blueprints(a).first()
    assert (b.parent, b.overrides, b.tags) == ("AHero", ["K2_Activate"], ["Ability.Melee.Slash"])
    assert A.ai_assets(a).first().nodes == ["BTTask_Attack"]
    types, methods = spark.createDataFrame([("UHero",)], "name string"), spark.createDataFrame([("UHero", "K2_Other")], "cls string, name string")
    assert [r.rule_id for r in L.blueprint_rules(A.blueprints(a), types, methods, ["AActor"]).collect()] == ["UE5-BP-002"]
    tags = spark.createDataFrame([("Ability.Melee",), ("a.b",), ("Ab.Xyz",), ("DEADBEEF.FACE01",)], "t string")
    assert [r[0] for r in tags.select(A.likely_tag(F.col("t"))).collect()] == [True, False, False, False]
    assert spark.range(1).select(A.asset_role(F.lit("ABP_X")), A.asset_role(F.lit("Sword"))).first()[:] == ("animation", "other")


def test_detect(tmp_path):
    (tmp_path / "Assets").mkdir()
    (tmp_path / "ProjectSettings").mkdir()
    (tmp_path / "a.sln").write_text("")
    assert A.detect(str(tmp_path / "Assets")) == ("unity", str(tmp_path))


def test_type_patterns(spark):
    types = spark.createDataFrame([("UMy", ["UGameInstanceSubsystem", "IThing"])], "name string, base_types array<string>")
    members = spark.createDataFrame([("UMy", "a", "UMeshComponent", True), ("UMy", "b", "UBoxComponent", False)], "cls string, name string, type string, is_replicated boolean")
    assert {r.pattern for r in L.type_patterns(types, types.limit(0), members).collect()} == {"Subsystem Pattern", "Component Composition", "Network Replication", "Interface Implementation"}


def test_parsed_once(spark, tree):
    f = S.source_files(spark, tree)
    p = S.parsed(f)
    for of in (S.types_of, S.members_of, S.methods_of):
        assert sorted(map(str, of(p).collect())) == sorted(map(str, of(f).collect())) and of(p).columns == of(f).columns
    cpp = S.files(spark, tree, "*.h", "*.cpp")
    assert sorted(map(str, S.methods_of(S.parsed(cpp, "cpp"), "cpp").collect())) == sorted(map(str, S.methods_of(cpp, "cpp").collect()))


def test_diagrams(spark):
    from cordage.sources import render as D

    calls = spark.createDataFrame([("A", "run", "A", "go", "", False), ("A", "run", "B", "hit", 'x == "y"', False), ("A", "run", None, "fly", "", True)], "caller_cls string, caller_method string, callee_cls string, callee_method string, condition string, is_dynamic boolean")
    lines = [r.line for r in D.flow_chart(calls).collect()]
    assert lines[0] == "flowchart TD" and len(lines) == 4
    assert any('["go"]' in x for x in lines) and any('["B.hit"]' in x and '|"x == ' in x for x in lines) and any('["⇢ ?.fly"]' in x for x in lines)
    edges = spark.createDataFrame([("A", "Base", "Inheritance", ""), ("A", "B", "Field", "b")], "src string, dst string, kind string, member string")
    assert {r.line.strip() for r in D.class_diagram(edges).collect()} == {"classDiagram", "Base <|-- A", "A --> B : b"}


def test_git_snapshot(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    (tmp_path / "A.cs").write_text("class A {}")
    (tmp_path / "b.txt").write_text("no code")
    git("add", "-A")
    git("commit", "-qm", "first")
    first = git("rev-parse", "HEAD")
    (tmp_path / "A.cs").write_text("class A : B {}")
    git("commit", "-qam", "second")
    assert [tuple(r) for r in A.git_snapshot(spark, str(tmp_path), first).collect()] == [("A.cs", "class A {}")]
    assert A.git_snapshot(spark, str(tmp_path), first, ".none").count() == 0
