import random
import re

import pytest

pytest.importorskip("cordage.llm")
from cordage.llm import line_dedup as M


def reach(lines, i, run=3, passage=50):
    """Lines of the window that starts at line i: fewer than ``run`` if they hold ``passage`` words; 0 where the text ends before."""
    for m in range(1, run):
        if i + m <= len(lines) and sum(len(re.findall("[^\x20\x09-\x0d]+", x)) for x in lines[i : i + m]) >= passage:
            return m
    return run if i + run <= len(lines) else 0


def plain(rows, run=3):
    """What is left of every document, from the definition."""
    seen, out = {}, {}
    order = sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in order:
        lines = (t or "").split("\n")
        for i in range(len(lines)):
            if m := reach(lines, i, run):
                seen.setdefault(tuple(lines[i : i + m]), (d, i))
    for d, t in order:
        lines = (t or "").split("\n")
        gone = {j for i in range(len(lines)) if (m := reach(lines, i, run)) and seen[tuple(lines[i : i + m])] != (d, i) for j in range(i, i + m)}
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_equals_definition(spark):
    rng = random.Random(1)
    pool = [[f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 7))] for _ in range(15)]
    rows = [(d, "\n".join(x for _ in range(rng.randrange(5)) for x in rng.choice(pool))) for d in range(200)]
    rows += [(300, None), (301, "same\n" * 50), (302, "\n\n\n\n\n"), (None, rows[3][1]), (303, "x" * 100000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, line int")
    got = {r.doc_id: r.text for r in M.dedup_lines(spark, df).collect()}
    assert got == plain(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "z\na\nb\nc\ny"), (2, "a\nb\nc\nd")]
    got = sorted((r.doc_id, r.text) for r in M.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d"), (2, "z\ny")]
    assert M.dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_few_lines(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long, short, pair = words(60), words(49), (words(30), words(25))
    rows = [(1, long), (2, f"{words(3)}\n{long}\n{words(4)}"), (3, short), (4, short), (5, "\n".join(pair)), (6, "\n".join([words(2), *pair, words(2)])), (7, f"{pair[0]}\n{words(30)}")]
    rows += [(10 + d, "\n".join(rng.choice([long, short, *pair, words(5), "", words(70)]) for _ in range(rng.randrange(6)))) for d in range(60)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, windows string")
    got = {r.doc_id: r.text for r in M.dedup_lines(spark, df).collect()}
    assert got == plain(rows)
    assert got[1] == long and long not in got[2] and got[4] == short and got[6].count("\n") == 1 and got[7] == rows[6][1]


def test_fingerprints_are_selected_lines(spark):
    text = "\n".join(f"line {i * 7 % 50}" for i in range(50))
    rows = M.fingerprints(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, text_hash long")).collect()
    assert len({r.at for r in rows}) == len(rows) < 40 and sum(len(r.windows) for r in rows) == 48
    assert all(r.at - 2 <= w.line <= r.at for r in rows for w in r.windows)
