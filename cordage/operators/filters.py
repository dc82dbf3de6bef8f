"""Filters, partitions and small lookups over types, calls, members and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes and calls that a flow leaves out, beginnings of accessors, engine versions by tier. They must match the studied tool's.
NOISE_CLASSES = ["Math", "MathF", "Convert", "BitConverter", "Enum", "BigInteger", "Complex", "Enumerable", "Queryable", "ParallelEnumerable", "StringBuilder", "Regex", "Encoding", "Debug", "Mathf", "Vector2", "Vector3", "Vector4", "Quaternion", "Color", "Color32", "Time", "Input", "Screen", "Physics", "Physics2D", "Resources", "PlayerPrefs", "Random", "Gizmos", "GL"]
NOISE_CALLS = [
    "Add", "Remove", "Clear", "Count", "Contains", "ContainsKey", "ContainsValue", "Any", "Where", "Select", "ToList", "ToArray", "ToDictionary", "ToHashSet", "First", "FirstOrDefault", "Last", "LastOrDefault",
    "Single", "SingleOrDefault", "Skip", "Take", "OrderBy", "OrderByDescending", "GroupBy", "Distinct", "Zip", "TryAdd", "TryGetValue", "TryRemove", "AddRange", "InsertRange", "RemoveAll", "RemoveRange", "Keys", "Values", "Entries",
    "ToString", "GetHashCode", "Equals", "GetType", "GetLength", "Parse", "TryParse", "Format", "Concat", "Join", "Split", "Trim", "IsNullOrEmpty", "IsNullOrWhiteSpace", "Log", "LogWarning", "LogError", "LogException",
    "GetComponent", "GetComponentInChildren", "GetComponentInParent", "FindObjectOfType", "FindObjectsOfType", "Instantiate", "Destroy", "DestroyImmediate", "SetActive", "DontDestroyOnLoad",
    "StartCoroutine", "StopCoroutine", "StopAllCoroutines", "WaitForSeconds", "WaitForEndOfFrame", "WaitUntil", "WaitWhile", "WhenAll", "WhenAny", "Delay", "Forget", "GetAwaiter", "GetResult", "ConfigureAwait", "RunOnThreadPool", "RunOnMainThread",
    "GetInt", "GetFloat", "GetString", "SetInt", "SetFloat", "SetString", "HasKey", "DeleteKey", "DeleteAll", "Save", "InvokeRepeating", "CancelInvoke",
]
ACCESSOR_STARTS = ["get_", "set_", "op_", "add_", "remove_"]
VALIDATED_VERSIONS = ["5.0", "5.1", "5.2", "5.3", "5.4", "5.5", "5.6"]
EXPERIMENTAL_VERSIONS = ["5.7", "5.8", "5.9"]


def in_namespace(nodes: DataFrame, wanted: str) -> DataFrame:
    """Nodes whose namespace contains ``wanted``, letters in either case; a null namespace contains nothing."""
    return nodes.filter(F.lower("namespace").contains(wanted.lower()))


def is_noise_class(name: Column) -> Column:
    """A base class of a library, System's, or Unity's own unless it says Custom."""
    return name.isin(*NOISE_CLASSES) | name.startswith("System.") | (name.startswith("UnityEngine.") & ~name.contains("Custom"))


def is_noise_call(name: Column) -> Column:
    """A collection, string, log or engine call, or an accessor."""
    out = name.isin(*NOISE_CALLS)
    for start in ACCESSOR_STARTS:
        out = out | name.startswith(start)
    return out


def without_noise(calls: DataFrame) -> DataFrame:
    """Calls (callee_cls, callee_method) but for noise; an unknown class is none."""
    return calls.filter(~is_noise_call(F.col("callee_method")) & ~F.coalesce(is_noise_class(F.col("callee_cls")), F.lit(False)))


def by_access(members: DataFrame) -> DataFrame:
    """cls, public, protected, private: members of each class by access; one without an access counts as private."""
    access = F.coalesce("access", F.lit(""))
    counted = [F.count_if(access == a).alias(a) for a in ("public", "protected")]
    return members.groupBy("cls").agg(*counted, F.count_if(~access.isin("public", "protected")).alias("private"))


def engine_tier(version: Column) -> Column:
    """validated, experimental, unsupported or unknown by how an engine's version begins."""
    begins = lambda starts: version.rlike("^(" + "|".join(re.escape(s) for s in starts) + ")")
    return F.when(begins(VALIDATED_VERSIONS), "validated").when(begins(EXPERIMENTAL_VERSIONS), "experimental").when(version.startswith("4."), "unsupported").otherwise("unknown")


def cycle_partition(cycles: DataFrame) -> DataFrame:
    """direct, indirect: cycles (length) of two nodes, and of more."""
    return cycles.agg(F.count_if(F.col("length") <= 2).alias("direct"), F.count_if(F.col("length") > 2).alias("indirect"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that the character at ``offset`` (from 0) is on."""
    return (F.length(F.regexp_replace(F.left(text, offset.cast("int")), "[^\\n]", "")) + 1).cast("long")


def namespaces(*kinds: DataFrame) -> DataFrame:
    """namespace, types: over classes, structs and enums together; an empty or null one is "(None)"."""
    every = kinds[0].select("namespace", "name")
    for k in kinds[1:]:
        every = every.unionByName(k.select("namespace", "name"))
    ns = F.when(F.coalesce("namespace", F.lit("")) == "", "(None)").otherwise(F.col("namespace"))
    return every.groupBy(ns.alias("namespace")).agg(F.count("*").alias("types"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    first = F.min(F.struct(*order, *[c for c in rows.columns if c not in order and c not in key]))
    return rows.groupBy(*key).agg(first.alias("_f")).select(*[F.col(c) if c in key else F.col(f"_f.{c}") for c in rows.columns])
