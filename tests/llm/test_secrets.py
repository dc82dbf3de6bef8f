import random
import re

import numpy as np
import pytest

pytest.importorskip("cordage.llm")
from cordage.llm.automaton import Automaton, Rule
from cordage.llm.secrets import BASE, MORE, find_secrets, scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = re.compile(r"[ſK]")


def plain(text):
    """The contract's base spans by Python's own expressions."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(KEYWORDS.sub("é", text)) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "deadbeef", "é", "日本", "ſecret", "toKen", "x", ".", "/", "+", "\n", "abcdefgh", "ghp_", "a1B2" * 9, "AIza", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----"]


@pytest.fixture(scope="module")
def dfa():
    return Automaton(BASE + MORE)


def test_equals_plain_expressions(dfa):
    rng = random.Random(5)
    texts = ["", "token=secret: abcdefgh12345", "password==abcdefgh"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text, spans in zip(texts, scan(dfa, texts), strict=True):
        assert [s for s in spans if s[1] < 3] == plain(text), text


def test_lanes_agree_with_one_walk(dfa):
    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice(PARTS) for _ in range(3000)).encode() + b"0a" * 5000, np.uint8)
    state, walked = 0, []
    for b in data.tolist():
        state = int(dfa.table[state + int(dfa.kind_of_byte[b])])
        walked.append(state)
    assert dfa.run(data).tolist() == walked


def test_minimised_keeps_the_language():
    two = Automaton([Rule("x", "a(b|c)*d", "[0-9]", 2)])
    assert two.states <= 5
    assert two.matches(np.frombuffer(b"abcbd12 ad1 abd123", np.uint8)) == [(0, 7, 0), (12, 18, 0)]


def test_more_kinds(dfa):
    text = "x ghp_" + "a1B2" * 9 + " AIza" + "z" * 35 + " xoxb-1234567890 -----BEGIN RSA PRIVATE KEY-----"
    assert [dfa.rules[r].name for _, r, _ in scan(dfa, [text])[0]] == ["code_host", "cloud_key", "chat_token", "private_key"]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "token = abcdefgh", None), (2, "é" * 70000 + " secret:abcdefgh", "c")]
    got = {(r.doc_id, r.spans) for r in find_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert got == {(1, ""), (None, "assign:0:16"), (2, "assign:70001:70016")}
    assert find_secrets(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
