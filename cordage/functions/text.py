"""Scalar functions over names, types and source text: built-in functions where they suffice, Arrow-batched Python for nesting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CAMEL = (("([a-z])([A-Z])", 1), ("([A-Z]+)([A-Z][a-z])", 2))


def split_camel(name: Column) -> Column:
    """Words of a name apart: after a small letter, then before the last capital of a row of them."""
    for pattern, _ in _CAMEL:
        name = F.regexp_replace(name, pattern, "$1 $2")
    return name


def split_camel_text(name: str) -> str:
    for pattern, _ in _CAMEL:
        name = re.sub(pattern, r"\1 \2", name)
    return name


def type_names(type_text: Column, primitives: list[str]) -> Column:
    """All names in a type, without their namespaces and without primitives."""
    parts = F.transform(F.split(type_text, r"[<>,?\[\] ]"), lambda x: F.element_at(F.split(x, r"\."), -1))
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*primitives))


def cut_generic(type_text: Column) -> Column:
    """The type up to its first angle bracket."""
    return F.trim(F.split(type_text, "<")[0])


def strip_frontmatter(text: Column) -> Column:
    """Without the block between the first line's three hyphens and the next such line."""
    return F.regexp_replace(text, r"\A---[\s\S]*?\n---\n*", "")


def node_id(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def slug(title: Column, most: int = 40) -> Column:
    """Small letters and digits of any script, hyphens between, ``most`` characters."""
    words = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", ""), r"[\s_]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, most), "-+$", "")


def safe_id(name: Column) -> Column:
    """For diagrams: other characters than letters, digits and underscores as underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def class_of_file(path: Column) -> Column:
    """The class that a changed file stands for: Battle@Calculator.cs is part of Battle."""
    stem = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.split(F.split(stem, "@")[0], r"\.")[0]


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def simple_type_text(text: str) -> str:
    """The last generic argument, and so on inward, without namespace and question mark."""
    text = text.strip().rstrip("?").strip()
    low = text.find("<")
    if low >= 0 and text.endswith(">"):
        depth, last = 0, low + 1
        for i in range(low + 1, len(text) - 1):
            depth += {"<": 1, ">": -1}.get(text[i], 0)
            if text[i] == "," and depth == 0:
                last = i + 1
        return simple_type_text(text[last:-1])
    return text.rsplit(".", 1)[-1]


def cpp_type_text(text: str) -> str:
    """The class that a C++ type is about: without keywords, pointers, references and arrays; of templates the first argument."""
    text = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)
    text = re.sub(r"\b(?:const|class|struct|enum|typename|mutable|volatile|static)\b", " ", text)
    if (low := text.find("<")) >= 0 and (high := text.rfind(">")) > low:
        depth, end = 0, high
        for i in range(low + 1, high):
            depth += {"<": 1, ">": -1}.get(text[i], 0)
            if text[i] == "," and depth == 0:
                end = i
                break
        return cpp_type_text(text[low + 1 : end])
    text = re.sub(r"\[[^\]]*\]|[*&]", " ", text).strip()
    name = text.split()[-1].split("::")[-1] if text else ""
    return name if re.match(r"[A-Za-z_]", name) else ""


def _series(f):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else f(x))

    return run


def simple_type(c: Column) -> Column:
    return _series(simple_type_text)(c)


def cpp_type(c: Column) -> Column:
    return _series(cpp_type_text)(c)


def without_comments(text: str) -> str:
    """Comments as blanks; strings stay."""
    return re.sub(r'"(?:\\.|[^"\\\n])*"|/\*.*?\*/|//[^\n]*', lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def balanced(text: str, at: int, pair: str = "{}") -> int:
    """Just after the bracket that closes the one at ``at``, strings skipped; -1 if none does."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[' + re.escape(pair) + "]").finditer(text, at):
        if m[0] == pair[0]:
            depth += 1
        elif m[0] == pair[1]:
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


_KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "new", "delete", "throw", "else", "do", "case", "using", "lock", "foreach", "typeof", "nameof"}


def calls_of(body: str) -> list[tuple[str, str, str, str]]:
    """(receiver, method, condition, context) of every call in a body, in order.

    Condition: the innermost if (or its else, negated), switch, while or foreach around it. Context: lock, thread, lambda or await.
    """
    text = without_comments(body)
    out = []
    for m in re.finditer(r"(?:(\w+(?:\(\))?)\s*(?:\.|->|::)\s*)?(\w+)\s*(?:<[\w\s,<>*&]*>)?\s*\(", text):
        receiver, name = m[1] or "", m[2]
        if name in _KEYWORDS or len(name) < 2 or re.fullmatch(r"[A-Z][A-Z0-9_]+", name):
            continue
        if re.search(r"\bnew\s+$", text[: m.start(2)]):
            continue
        out.append((receiver, name, condition_at(text, m.start()), context_at(text, m.start())))
    return out


def _blocks_around(text: str, at: int) -> Iterator[tuple[int, str]]:
    """(start of the opening brace, text before it) of the blocks around a place, from the inside out."""
    depth = 0
    for i in range(at - 1, -1, -1):
        if text[i] == "}":
            depth += 1
        elif text[i] == "{":
            if depth == 0:
                yield i, text[:i]
            else:
                depth -= 1


def _head(before: str) -> tuple[str, str]:
    """The keyword and the text in brackets that ``before`` ends with, or two empty texts."""
    before = before.rstrip()
    if not before.endswith(")"):
        return "", ""
    depth = 0
    for i in range(len(before) - 1, -1, -1):
        depth += {")": 1, "(": -1}.get(before[i], 0)
        if depth == 0:
            m = re.search(r"\b(if|while|switch|foreach)\s*$", before[:i])
            return (m[1], " ".join(before[i + 1 : -1].split())) if m else ("", "")
    return "", ""


def condition_at(text: str, at: int) -> str:
    for _, before in _blocks_around(text, at):
        word, expr = _head(before)
        if word:
            expr = expr if len(expr) <= 80 else expr[:77] + "..."
            return expr if word == "if" else f"{word}: {expr}"
        if re.search(r"\belse\s*$", before):
            opened = before.rstrip()[:-4].rstrip()
            depth = 0
            for i in range(len(opened) - 1, -1, -1):
                depth += {"}": 1, "{": -1}.get(opened[i], 0)
                if depth == 0:
                    word, expr = _head(opened[:i])
                    return f"!({expr})" if word == "if" else "else"
            return "else"
    return ""


def context_at(text: str, at: int) -> str:
    if re.search(r"\bawait\s+[\w.]*$", text[:at]):
        return "await"
    for _, before in _blocks_around(text, at):
        tail = before[-200:]
        if re.search(r"\block\s*\([^{}]*\)\s*$", tail):
            return "lock"
        if re.search(r"\b(?:Task\.Run|new\s+Thread|ThreadPool\.\w+|std::thread)\b[^;{}]*$", tail):
            return "thread"
        if re.search(r"(?:=>|\]\s*\([^()]*\)(?:\s*(?:mutable|->\s*\w+))*)\s*$", tail):
            return "lambda"
    return ""


def control_flow(body: str) -> list[tuple[int, str, str]]:
    """(number, kind, text) of a body's top-level steps: Guard (an if that leaves), Branch, Loop, Switch, Exception and Always (a call)."""
    text = without_comments(body)
    at, out = 0, []
    step = re.compile(r"\b(if|for|foreach|while|switch|try)\b\s*|(?:[\w.>:-]+)\s*\([^;{}]*\)\s*;")
    while m := step.search(text, at):
        at = m.end()
        if not m[1]:
            out.append((len(out) + 1, "Always", " ".join(m[0].rstrip("; \n").split())))
            continue
        head = ""
        if m[1] != "try" and at < len(text) and text[at] == "(":
            end = balanced(text, at, "()")
            if end < 0:
                break
            head, at = " ".join(text[at + 1 : end - 1].split()), end
        rest = text[at:].lstrip()
        at = len(text) - len(rest)
        if rest.startswith("{"):
            end = balanced(text, at)
            if end < 0:
                break
            block, at = text[at:end], end
        else:
            end = text.find(";", at) + 1 or len(text)
            block, at = text[at:end], end
        while other := re.compile(r"\s*(?:else\s+if|else|catch|finally)\b[^{;]*").match(text, at):
            at = other.end()
            end = balanced(text, at) if text[at : at + 1] == "{" else text.find(";", at) + 1
            if end <= 0:
                break
            at = end
        leaves = re.search(r"\b(?:return|throw|break|continue)\b", block) and len(block) < 200
        kind = {"if": "Guard" if leaves else "Branch", "switch": "Switch", "try": "Exception"}.get(m[1], "Loop")
        out.append((len(out) + 1, kind, head))
    return out


class ControlFlow:
    """The same as a table function: register it with spark.udtf.register(name, control_flow_udtf())."""

    def eval(self, body: str):
        yield from control_flow(body or "")


def control_flow_udtf():
    return F.udtf(ControlFlow, returnType="step int, kind string, text string")
