"""Source trees as rows: files, then types, members, methods and calls extracted from C# and C++ text.

Files are read whole, one row each, and extracted in Arrow batches; what follows is DataFrame operators. Extraction follows
declarations and brackets, not a full grammar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.functions.text import balanced, calls_of, cpp_type_text, simple_type_text, without_comments
from cordage.plans.iterate import cut

# Folders that hold no sources of a project, and types that are no nodes.
IGNORED_DIRS = ["bin", "obj", ".git", ".vs", "Library", "Temp", "Intermediate", "Saved", "Binaries", "DerivedDataCache", "node_modules", "build"]
PRIMITIVES = ["", "void", "int", "uint", "long", "ulong", "short", "ushort", "byte", "sbyte", "float", "double", "decimal", "bool", "char", "string", "object", "var", "dynamic", "nint", "nuint"]
CPP_PRIMITIVES = ["", "void", "int", "unsigned", "long", "short", "float", "double", "bool", "char", "auto", "size_t", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "string", "FString", "FName", "FText", "FVector", "FRotator", "TArray", "TMap", "TSet"]
UE_LIFECYCLE = ["BeginPlay", "EndPlay", "Tick", "OnConstruction", "PostInitializeComponents", "NativeConstruct", "NativeDestruct"]

TYPE_SCHEMA = "name string, kind string, namespace string, file_path string, base_types array<string>"
MEMBER_SCHEMA = "cls string, name string, type string, access string, is_static boolean, is_const boolean, is_replicated boolean, specifiers array<string>, file_path string"
METHOD_SCHEMA = "cls string, name string, return_type string, params array<string>, access string, is_virtual boolean, is_override boolean, is_static boolean, is_async boolean, is_lifecycle boolean, specifiers array<string>, bases array<string>, body_text string, file_path string"
CALL_SCHEMA = "caller_cls string, caller_method string, receiver string, callee_method string, condition string, context string, ord long, file_path string"


def files(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """path, text of every file under ``root`` whose name fits a pattern, ignored folders left out."""
    found = None
    for g in globs:
        one = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", g).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        found = one if found is None else found.unionAll(one)
    return found.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS])))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path fits a pattern, letters in either case: ** means contains, a leading * ends with, others contain."""
    low = F.lower(path)
    out = F.lit(False)
    for p in (p.lower() for p in patterns):
        if "**" in p:
            out = out | low.contains(p.replace("**", "").strip("/"))
        elif p.startswith("*"):
            out = out | low.endswith(p[1:])
        else:
            out = out | low.contains(p)
    return out


_CS_TYPE = re.compile(r"((?:\b(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref)\s+)*)\b(class|struct|interface|record)\s+(\w+)\s*(?:<[^{>]*>)?\s*(?::\s*([^{;]+?))?\s*(?:where\s[^{]*)?\{")
_CS_METHOD = re.compile(r"((?:\[[^\]]*\]\s*)*)((?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|extern|new|unsafe)\s+)*)([\w.<>\[\],?]+(?:\s*<[^()]*>)?)\s+(\w+)\s*(?:<[^()>]*>)?\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:where[^{;]*)?(\{|=>|;)")
_CS_MEMBER = re.compile(r"((?:\[[^\]]*\]\s*)*)((?:(?:public|private|protected|internal|static|readonly|const|volatile|virtual|override|new|event)\s+)*)([\w.]+(?:<[^;={}()]*>)?(?:\[\])?\??)\s+(\w+)\s*(=(?!>)[^;]*;|;|\{\s*\}|=>)")


def _top_level(body: str) -> str:
    """The body with what is inside its blocks blanked, brackets kept."""
    out, depth = [], 0
    for c in body:
        if c == "}":
            depth -= 1
        out.append(c if depth == 0 or c == "\n" else " ")
        if c == "{":
            depth += 1
    return "".join(out)


def _split_top(text: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(c, 0)
        if c == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def _access(words: str, default: str) -> str:
    return next((w for w in ("public", "protected", "internal", "private") if w in words.split()), default)


def parse_csharp(path: str, text: str) -> tuple[list, list, list]:
    """(types, members, methods) of a file as tuples of the schemas."""
    text = without_comments(text)
    space = re.search(r"\bnamespace\s+([\w.]+)", text)
    types, members, methods = [], [], []
    for m in _CS_TYPE.finditer(text):
        end = balanced(text, m.end() - 1)
        body = text[m.end() : end - 1 if end > 0 else len(text)]
        bases = [simple_base(b) for b in _split_top(re.sub(r"\bwhere\b.*", "", m[4] or "", flags=re.S))]
        name = m[3]
        types.append((name, m[2], space[1] if space else "", path, bases))
        flat = _top_level(body)
        taken: list[tuple[int, int]] = []
        for f in _CS_METHOD.finditer(flat):
            if f[3] in ("return", "new", "else", "await", "throw", "using") or f[4] in ("if", "for", "while", "switch", "foreach", "lock", "using"):
                continue
            taken.append(f.span())
            words, code = f[2], ""
            if f[6] == "{":
                stop = balanced(body, f.end() - 1)
                code = body[f.end() : stop - 1 if stop > 0 else len(body)]
            elif f[6] == "=>":
                code = body[f.end() : body.find(";", f.end())]
            methods.append((name, f[4], f[3].strip(), _split_top(f[5]), _access(words, "private"), "virtual" in words, "override" in words, "static" in words, "async" in words, False, re.findall(r"\[(\w+)", f[1]), bases, code, path))
        for f in _CS_MEMBER.finditer(flat):
            if any(a <= f.start() < b for a, b in taken) or f[3] in ("return", "using", "class", "struct", "interface", "enum", "namespace", "public", "private", "get", "set"):
                continue
            members.append((name, f[4], f[3], _access(f[2], "private"), "static" in f[2], "const" in f[2], False, re.findall(r"\[(\w+)", f[1]), path))
    return types, members, methods


def simple_base(base: str) -> str:
    return re.sub(r"<.*", "", base.strip(), flags=re.S).rsplit(".", 1)[-1].strip()


_CPP_TYPE = re.compile(r"((?:\bU(?:CLASS|STRUCT|INTERFACE)\s*\([^)]*\)\s*)?)\b(class|struct|enum(?:\s+class)?|namespace)\s+(?:[A-Z_]+_API\s+)?(\w+)\s*(?:final\s*)?(?::\s*([^{;()]+?))?\s*\{")
_CPP_METHOD = re.compile(r"(UFUNCTION\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*)?((?:(?:virtual|static|inline|explicit|FORCEINLINE)\s+)*)([\w:]+(?:<[^;{}()]*>)?(?:\s*[*&]+|\s)\s*|~)(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*((?:const|override|final|noexcept|\s)*)(\{|;|=\s*0\s*;)")
_CPP_MEMBER = re.compile(r"(UPROPERTY\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*)?((?:(?:static|const|mutable|constexpr)\s+)*)([A-Za-z_][\w:]*(?:<[^;{}()]*>)?\s*[*&]*)\s+(\w+)\s*(?:=[^;]*|\{[^}]*\}|\[[^\]]*\])?;")
_CPP_BODY = re.compile(r"([\w:<>*&\s]+?[\s*&])?(\w+)::(~?\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:const|override|noexcept|\s)*(?::[^{;]*)?\{")


def _specifiers(text: str | None) -> list[str]:
    return [s.strip() for s in _split_top(text or "")]


def parse_cpp(path: str, text: str) -> tuple[list, list, list]:
    """The same for C++: classes, structs, enums, namespaces, Unreal macros, and bodies defined outside of their class."""
    text = re.sub(r"\b(?:GENERATED_(?:UCLASS_|USTRUCT_)?BODY|GENERATED_BODY)\s*\(\s*\)", "", without_comments(text))
    types, members, methods = [], [], []
    bases_of: dict[str, list[str]] = {}
    for m in _CPP_TYPE.finditer(text):
        kind, name = m[2].split()[0], m[3]
        bases = [cpp_type_text(re.sub(r"\b(?:public|protected|private|virtual)\b", "", b)) for b in _split_top(m[4] or "")] if kind in ("class", "struct") else []
        bases_of[name] = bases
        types.append((name, kind, "", path, bases))
        if kind == "enum":
            continue
        end = balanced(text, m.end() - 1)
        body = text[m.end() : end - 1 if end > 0 else len(text)]
        flat = _top_level(body)
        labels = [(x.start(), x[1]) for x in re.finditer(r"\b(public|protected|private)\s*(?:\w+\s*)?:(?!:)", flat)]
        flat = re.sub(r"\b(?:public|protected|private)\s*:(?!:)", lambda x: " " * len(x[0]), flat)
        access_at = lambda at, d="private" if kind == "class" else "public", ls=labels: next((a for p, a in reversed(ls) if p < at), d)  # noqa: E731, B008
        taken: list[tuple[int, int]] = []
        for f in _CPP_METHOD.finditer(flat):
            if f[4].strip() in ("return", "new", "else", "delete", "throw") or f[5] in ("if", "for", "while", "switch", "UPROPERTY", "UFUNCTION"):
                continue
            taken.append(f.span())
            stop = balanced(body, f.end() - 1) if f[8] == "{" else -1
            code = body[f.end() : stop - 1] if stop > 0 else ""
            methods.append((name, f[5], f[4].strip(), _split_top(f[6]), access_at(f.start()), "virtual" in f[3], "override" in f[7], "static" in f[3], False, f[5] in UE_LIFECYCLE, _specifiers(f[2]), bases, code, path))
        for f in _CPP_MEMBER.finditer(flat):
            if any(a <= f.start() < b for a, b in taken) or f[4].strip() in ("return", "using", "class", "struct", "enum", "typedef", "friend", "namespace", "delete"):
                continue
            s = _specifiers(f[2])
            members.append((name, f[5], f[4].strip(), access_at(f.start()), "static" in f[3], "const" in f[3], any(x.lower().startswith("replicated") for x in s), s, path))
    for f in _CPP_BODY.finditer(text):
        end = balanced(text, f.end() - 1)
        methods.append((f[2], f[3], (f[1] or "").strip(), _split_top(f[4]), "", False, False, False, False, f[3] in UE_LIFECYCLE, [], bases_of.get(f[2], []), text[f.end() : end - 1 if end > 0 else len(text)], path))
    return types, members, methods


def _extracted(rows: DataFrame, parse, part: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for p, t in zip(b["path"], b["text"], strict=True) for r in parse(p, t or "")[part]]
            yield pd.DataFrame(out, columns=names)

    return rows.select("path", "text").mapInPandas(run, schema)


def parsed(rows: DataFrame, language: str = "cs") -> DataFrame:
    """types, members, methods of every file (path, text), each parsed once. The three functions below take it in place of the files."""
    schemas = {"types": TYPE_SCHEMA, "members": MEMBER_SCHEMA, "methods": METHOD_SCHEMA}
    names = [[c.split()[0] for c in s.split(", ")] for s in schemas.values()]
    parse = parse_csharp if language == "cs" else parse_cpp

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(p, t or "") for p, t in zip(b["path"], b["text"], strict=True)]
            yield pd.DataFrame({k: [[dict(zip(n, r, strict=True)) for r in f[i]] for f in found] for i, (k, n) in enumerate(zip(schemas, names, strict=True))})

    fields = ", ".join(f"{k} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in s.split(', '))}>>" for k, s in schemas.items())
    return cut(rows.select("path", "text").mapInPandas(run, fields))


def source_files(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """path, text of C# files, or those that match; generated ones (ending _PROTO.cs) are left out."""
    return files(spark, root, *(globs or ("*.cs",))).filter(~F.col("path").endswith("_PROTO.cs"))


def types_of(rows: DataFrame, language: str = "cs") -> DataFrame:
    return rows.select(F.inline("types")) if "types" in rows.columns else _extracted(rows, parse_csharp if language == "cs" else parse_cpp, 0, TYPE_SCHEMA)


def members_of(rows: DataFrame, language: str = "cs") -> DataFrame:
    return rows.select(F.inline("members")) if "members" in rows.columns else _extracted(rows, parse_csharp if language == "cs" else parse_cpp, 1, MEMBER_SCHEMA)


def methods_of(rows: DataFrame, language: str = "cs") -> DataFrame:
    return rows.select(F.inline("methods")) if "methods" in rows.columns else _extracted(rows, parse_csharp if language == "cs" else parse_cpp, 2, METHOD_SCHEMA)


def merged_methods(methods: DataFrame) -> DataFrame:
    """One row per class, method and parameters: declaration and body from wherever they are, body of the first file that has one."""
    key = ["cls", "name", F.size("params").alias("n")]
    pick = lambda c, test: F.min_by(c, F.when(test, F.col("file_path"))).alias(c)
    declared = F.col("access") != ""
    return methods.groupBy(*key).agg(
        *[pick(c, declared) for c in ("return_type", "access", "is_virtual", "is_override", "is_static", "specifiers")],
        F.max_by("bases", F.size("bases")).alias("bases"), pick("body_text", F.col("body_text") != ""), F.min("file_path").alias("file_path"),
    ).drop("n").withColumn("specifiers", F.coalesce("specifiers", F.array().cast("array<string>"))).withColumn("body_text", F.coalesce("body_text", F.lit("")))


def calls_in(methods: DataFrame) -> DataFrame:
    """Every call in every method body, in order."""
    names = [c.split()[0] for c in CALL_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(c, m, *call, i, p) for c, m, t, p in zip(b["cls"], b["name"], b["body_text"], b["file_path"], strict=True) for i, call in enumerate(calls_of(t or ""))]
            yield pd.DataFrame(out, columns=names)

    return methods.select("cls", "name", "body_text", "file_path").mapInPandas(run, CALL_SCHEMA)


def edges_of(types: DataFrame, members: DataFrame, methods: DataFrame, language: str = "cs", deep: bool = False) -> DataFrame:
    """src, dst, kind, member, ord: inheritance, field and parameter edges; with ``deep`` also types made and named in bodies."""
    skip = PRIMITIVES if language == "cs" else CPP_PRIMITIVES
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
    parts = [
        types.select(F.col("name").alias("src"), F.explode("base_types").alias("dst"), F.lit("Inheritance").alias("kind"), F.lit("").alias("member"), "file_path"),
        members.select(F.col("cls").alias("src"), F.explode(names(F.col("type"))).alias("dst"), F.lit("Field").alias("kind"), F.col("name").alias("member"), "file_path"),
        methods.select(F.col("cls").alias("src"), F.explode(F.array_distinct(F.flatten(F.transform("params", lambda p: F.regexp_extract_all(F.regexp_replace(p, r"\s+\w+\s*(?:=.*)?$", ""), F.lit(r"[A-Za-z_]\w*"), F.lit(0)))))).alias("dst"), F.lit("Parameter").alias("kind"), F.col("name").alias("member"), "file_path"),
    ]
    if deep:
        used = F.array_distinct(F.concat(F.regexp_extract_all("body_text", F.lit(r"\bnew\s+(\w+)"), F.lit(1)), F.regexp_extract_all("body_text", F.lit(r"\b([A-Z]\w*)\s*(?:\.|::)\s*\w+"), F.lit(1))))
        parts.append(methods.select(F.col("cls").alias("src"), F.explode(used).alias("dst"), F.lit("Field").alias("kind"), F.col("name").alias("member"), "file_path"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.filter(~F.col("dst").isin(*skip, "const", "ref", "out", "in", "params", "this") & (F.col("src") != F.col("dst"))).withColumn("ord", F.concat_ws("/", "file_path", "member"))


def simple_types(names: list[str]) -> list[str]:
    return [simple_type_text(n) for n in names]
