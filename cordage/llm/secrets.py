"""Secret scans: every rule in one pass over the bytes of whole texts (see automaton.py).

Defined cases: a null text counts as empty; rows that repeat a doc_id each get a row; offsets are code points, end exclusive;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm.automaton import END, Automaton, Rule
from cordage.llm.common import trimmed

#: The contract's kinds, in its order: a run's least length counts the run alone.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 8, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
]
#: Further kinds.
MORE = [
    Rule("private_key", r"-----BEGIN( [A-Z0-9]+)* PRIVATE KEY", "-", 5),
    Rule("code_host", r"gh[opsur]_", "[A-Za-z0-9]", 36),
    Rule("cloud_key", r"AIza", "[A-Za-z0-9_-]", 35),
    Rule("chat_token", r"xox[abprs]-", "[A-Za-z0-9-]", 10),
]
#: Bytes scanned at a time.
STRETCH = 2_000_000


def scan(automaton: Automaton, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, rule, end) in code points, sorted."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\xff".join(raw), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    points: dict[int, np.ndarray] = {}
    for start, end, rule in automaton.matches(data):
        i = int(np.searchsorted(ends, start, "right"))
        base = int(ends[i]) - len(raw[i])
        a, b = start - base, end - base
        if len(raw[i]) != len(texts[i]):
            if i not in points:  # code points before every byte of the text, counted once
                points[i] = np.concatenate(([0], np.cumsum((data[base : ends[i]] & 0xC0) != 0x80)))
            a, b = int(points[i][a]), int(points[i][b])
        spans[i].append((a, rule, b))
    for s in spans:
        s.sort()
    return spans


def _written(rules: list[Rule], spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[r].name}:{a}:{b}" for a, r, b in spans)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scanner(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton.value
        for batch in batches:
            ids, texts, size = [], [], 0
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k])
                texts.append(batch.column(1)[k].as_py() or "")
                size += len(texts[-1])
                if size < STRETCH and k < batch.num_rows - 1:
                    continue
                rows = []
                for spans in scan(dfa, texts):
                    base = [s for s in spans if s[1] < len(BASE)]
                    counts = [sum(s[1] == r for s in base) for r in range(len(BASE))]
                    rows.append((*counts, hashlib.sha256(_written(dfa.rules, base).encode()).hexdigest(), _written(dfa.rules, spans)))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)
                ids, texts, size = [], [], 0

    return trimmed(run)


def find_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, and all spans, of every document."""
    automaton = spark.sparkContext.broadcast(Automaton(BASE + MORE))
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_scanner(automaton), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
