"""Game assets as rows: references by GUID in text assets, references by path and class in binary ones, and notes in Markdown."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.sources.trees import files

# Kinds of a project by what its root holds, in order of precedence; name prefixes of assets.
PROJECT_KINDS = [("unity", ["Assets", "ProjectSettings"]), ("axmol", ["axmol", "core/axmol.h"]), ("cocos2dx", ["cocos2d"]), ("unreal", ["*.uproject"]), ("dotnet", ["*.sln", "*.csproj"]), ("cpp", ["CMakeLists.txt", "*.vcxproj"]), ("python", ["pyproject.toml", "setup.py"]), ("react", ["package.json"])]
ASSET_ROLES = [("GA_", "ability"), ("GE_", "effect"), ("AS_", "attribute_set"), ("ABP_", "animation"), ("AM_", "montage"), ("BT_", "behavior_tree"), ("ST_", "state_tree"), ("BB_", "blackboard"), ("WBP_", "widget"), ("BPI_", "interface"), ("BP_", "blueprint")]
LFS_HEADER = "version https://git-lfs.github.com/spec/v1"


def detect(path: str, up: int = 6) -> tuple[str, str]:
    """(kind, root): the first kind whose marks a folder or one above it holds."""
    at = Path(path).resolve()
    for folder in [at, *at.parents][: up + 1]:
        for kind, marks in PROJECT_KINDS:
            hits = [bool(list(folder.glob(m))) for m in marks]
            if all(hits) if kind == "unity" else any(hits):
                return kind, str(folder)
    return "unknown", str(at)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.\w+)?$", 1)


def guid_map(spark: SparkSession, root: str, of: str = ".cs") -> DataFrame:
    """guid, path, name of the assets whose .meta files are there."""
    rows = files(spark, root, f"*{of}.meta")
    return rows.select(F.regexp_extract("text", r"(?m)^guid:\s*([0-9a-f]{32})", 1).alias("guid"), F.regexp_replace("path", r"\.meta$", "").alias("path")).filter("guid != ''").withColumn("name", stem(F.col("path")))


def guid_references(spark: SparkSession, root: str, scripts_only: bool = True) -> DataFrame:
    """guid, asset: references in prefabs, scenes and assets, each once an asset."""
    rows = files(spark, root, "*.prefab", "*.unity", "*.asset")
    pattern = r"fileID:\s*11500000,\s*guid:\s*([0-9a-f]{32})" if scripts_only else r"guid:\s*([0-9a-f]{32})"
    return rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("guid"), F.col("path").alias("asset"))


def persistent_calls(spark: SparkSession, root: str) -> DataFrame:
    """asset, pos, target, method of the calls that events in prefabs and scenes keep."""
    parts = files(spark, root, "*.prefab", "*.unity").select(F.col("path").alias("asset"), F.posexplode(F.split("text", "m_PersistentCalls:")).alias("pos", "block")).filter("pos > 0")
    calls = parts.select("asset", "pos", F.explode(F.regexp_extract_all("block", F.lit(r"(?s)(m_TargetAssemblyTypeName:[^\n]*\n\s*m_MethodName:[^\n]*)"), F.lit(1))).alias("c"))
    return calls.select("asset", "pos", F.regexp_extract("c", r"TypeName:\s*([\w.]+)", 1).alias("target"), F.regexp_extract("c", r"m_MethodName:\s*(\w+)", 1).alias("method")).filter("method != ''")


def animator_blocks(spark: SparkSession, root: str) -> DataFrame:
    """asset, file_id, kind, name, motion: the documents of animator controllers."""
    rows = files(spark, root, "*.controller").select(F.col("path").alias("asset"), F.explode(F.split("text", r"\n--- ")).alias("b"))
    return rows.select("asset", F.regexp_extract("b", r"&(-?\d+)", 1).alias("file_id"), F.regexp_extract("b", r"(?m)^(Animator\w*|BlendTree):", 1).alias("kind"), F.regexp_extract("b", r"(?m)^\s*m_Name:[ \t]*(.*)$", 1).alias("name"), F.regexp_extract("b", r"m_Motion:\s*\{fileID:\s*(-?\d+)", 1).alias("motion"), F.col("b").alias("body")).filter("kind != ''")


def animator_states(blocks: DataFrame) -> DataFrame:
    """asset, machine, state, motion_kind: states under the state machine that lists them."""
    machines = blocks.filter("kind = 'AnimatorStateMachine'").select("asset", F.col("name").alias("machine"), F.explode(F.regexp_extract_all("body", F.lit(r"m_State:\s*\{fileID:\s*(-?\d+)"), F.lit(1))).alias("file_id"))
    states = blocks.filter("kind = 'AnimatorState'").select("asset", "file_id", F.col("name").alias("state"), "motion")
    trees = blocks.filter("kind = 'BlendTree'").select("asset", F.col("file_id").alias("motion"), F.lit("blend").alias("motion_kind"))
    return machines.join(states, ["asset", "file_id"]).join(trees, ["asset", "motion"], "left").select("asset", "machine", "state", F.coalesce("motion_kind", F.lit("clip")).alias("motion_kind"))


def binary_assets(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size, text (bytes as Latin-1), is_stub (a pointer to large-file storage) of Unreal assets and maps."""
    found = None
    for g in ("*.uasset", "*.umap"):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", g).load(root)
        found = one if found is None else found.unionAll(one)
    rows = found.select("path", F.col("length").alias("size"), F.decode("content", "ISO-8859-1").alias("text"))
    return rows.withColumns({"name": stem(F.col("path")), "is_stub": (F.col("size") < 300) & F.col("text").startswith(LFS_HEADER)})


def class_references(assets: DataFrame) -> DataFrame:
    """cls, asset: native classes that binary assets name, the generated-class ending dropped."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"/Script/\w+\.(\w+)"), F.lit(1)), lambda x: F.regexp_replace(x, "_C$", "")))
    return assets.filter("NOT is_stub").select(F.explode(names).alias("cls"), F.col("path").alias("asset"))


def path_references(assets: DataFrame) -> DataFrame:
    """ref, asset: game paths that binary assets name."""
    return assets.filter("NOT is_stub").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(/Game/[\w/]+)"), F.lit(1)))).alias("ref"), F.col("path").alias("asset"))


def blueprints(assets: DataFrame) -> DataFrame:
    """asset, name, parent, overrides, tags, variables of Blueprint assets."""
    text = F.col("text")
    distinct = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))
    rows = assets.filter(~F.col("is_stub") & text.contains("NativeParentClass"))
    return rows.select(F.col("path").alias("asset"), "name", F.regexp_extract("text", r"NativeParentClass[\s\S]{0,200}?/Script/\w+\.(\w+)", 1).alias("parent"), distinct(r"\b(K2_\w+)").alias("overrides"), distinct(r"(?<![/\w.])([A-Z]\w{2,}(?:\.[A-Z]\w{2,})+)\b").alias("tags"), distinct(r"\b(b[A-Z]\w+)").alias("variables"))


def ai_assets(assets: DataFrame) -> DataFrame:
    """asset, name, kind, nodes: behaviour and state trees with the node classes that they use."""
    kind = F.when(F.col("name").startswith("BT_"), "behavior_tree").when(F.col("name").startswith("ST_"), "state_tree")
    return assets.filter(~F.col("is_stub")).withColumn("kind", kind).filter("kind IS NOT NULL").select(F.col("path").alias("asset"), "name", "kind", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:BTTask|BTService|BTDecorator|StateTreeTask)_\w+)"), F.lit(1))).alias("nodes"))


def likely_tag(tag: Column) -> Column:
    """At least two parts of 3 letters or more that start with a capital, digits below a third."""
    parts = F.split(tag, r"\.")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: (F.length(p) >= 3) & p.rlike("^[A-Z]") & ~p.rlike("^[0-9A-F]{6,}$") & (F.length(F.regexp_replace(p, r"\D", "")) <= F.length(p) * 0.3))


def asset_role(name: Column) -> Column:
    out = F.lit("other")
    for prefix, role in reversed(ASSET_ROLES):
        out = F.when(name.startswith(prefix), role).otherwise(out)
    return out


def event_bindings(rows: DataFrame) -> DataFrame:
    """file_path, line, event, callback, cls of listeners and schedules in C++ files (path, text)."""
    lines = rows.select(F.col("path").alias("file_path"), F.regexp_extract("text", r"\b(\w+)::\w+\s*\(", 1).alias("cls"), F.posexplode(F.split("text", "\n")).alias("n", "t"))
    event = F.regexp_extract("t", r"\b(addEventListenerWith\w+|addCustomEventListener|schedule\w*|addClickEventListener|addTouchEventListener)\s*\(", 1)
    callback = F.regexp_extract("t", r"CC_CALLBACK_\d\(\s*([\w:]+)|(?:schedule_selector|AX_SCHEDULE_SELECTOR|CC_SCHEDULE_SELECTOR)\(\s*([\w:]+)|&([\w:]+)", 0)
    return lines.withColumn("event", event).filter("event != ''").select("file_path", (F.col("n") + 1).cast("long").alias("line"), "event", F.regexp_extract(callback, r"([\w:]+)\s*$", 1).alias("callback"), "cls")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """id, type, title, created_at, updated_at, fingerprint, stale, body, file_path of Markdown notes."""
    key = lambda k: F.trim(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*(.*)$", 1))
    rows = files(spark, root, "*.md").withColumn("head", F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)).filter("head != ''")
    out = rows.select(key("type").alias("type"), key("title").alias("title"), key("created").alias("created_at"), key("updated").alias("updated_at"), key("source_fingerprint").alias("fingerprint"), (F.lower(key("stale")) == "true").alias("stale"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n*", "").alias("body"), F.col("path").alias("file_path"))
    return out.withColumn("id", F.concat_ws(":", "type", "title"))


def static_accessors(path: str) -> dict[str, dict[str, str]]:
    """A hints file's static accessors: class, property, type."""
    return json.loads(Path(path).read_text()).get("staticAccessors", {})


def git_snapshot(spark: SparkSession, repo: str, commit: str, ending: str = ".cs") -> DataFrame:
    """path, text of a commit's files. The driver asks git for the names; tasks ask it for the texts, so they must see the repository's folder."""
    listed = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "--name-only", commit], capture_output=True, text=True, check=True).stdout
    names = [(n,) for n in listed.splitlines() if n.endswith(ending)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [subprocess.run(["git", "-C", repo, "show", f"{commit}:{n}"], capture_output=True, text=True, check=True).stdout for n in b["path"]]
            yield pd.DataFrame({"path": b["path"], "text": texts})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.createDataFrame(names, "path string").repartition(parts).mapInPandas(run, "path string, text string")


def fingerprint(rows: DataFrame) -> DataFrame:
    """fingerprint of all files (path, modified) together: md5 of their sorted lines."""
    return rows.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("modified").cast("string")))), "\n").cast("binary")).alias("fingerprint"))


def class_file(methods: DataFrame) -> DataFrame:
    """cls, file_path: the file with the most method bodies of the class, of equal ones the first."""
    per = methods.groupBy("cls", "file_path").agg(F.count("*").alias("n"))
    return per.groupBy("cls").agg(F.min(F.struct((-F.col("n")).alias("n"), "file_path")).alias("m")).select("cls", F.col("m.file_path").alias("file_path"))


def is_test_file(path: Column) -> Column:
    """A folder named for tests, or a name that says so."""
    low = F.lower(path)
    return low.rlike(r"(^|[/\\])(tests?|specs?)[/\\]") | F.lower(stem(path)).rlike(r"^test_|test$|tests$|_test$|spec$")
