import hashlib
import random
import re

from sonolith.llm.automaton import BASE_RULES, EXTRA_RULES
from sonolith.llm.secrets import digest, scan_secrets

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base = sorted(spans)
    extra = [(m.start(), 3, "github", m.end()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]+", text) if len(m[0]) >= 40]
    extra += [(m.start(), 4, "slack", m.end()) for m in re.finditer("xox[abprs]-[A-Za-z0-9-]+", text) if len(m[0]) >= 15]
    return base, sorted(base + extra)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def test_against_regular_expressions(spark):
    rng = random.Random(7)
    bits = ["password", "PassWD", "secret", "token", "api_key", "apikey", "pass", "tok", "sec", "=", ":", " ", "  ", '"', "'", "AKIA", "AK", "ABCDEF0123456789", "0123456789abcdef", "abc", "é", "日本", "+/_.=-", "x" * 9, "Z" * 13, "deadbeefdeadbeef", "ghp_" + "a1" * 18, "xoxb-1234567890a", "\n", "-", "_"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "token=secret=abcdefabcdef12", "token=secret: abcdefghijklmn", "passecret = abcdefghijkl", "password" + " " * 50 + "=" + " " * 9 + "'abcdefghijkl", "password==abcdefghijk", "AKIA" * 6, "f" * 15, "f" * 16, "é" * 3 + "f" * 16, "word " * 40000 + "token:" + "q" * 12, "ſecret=abcdefghijkl"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "token=abcdefghijkl", "clash")] + [(5, texts[5], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in digest(scan_secrets(df)).collect())
    want = []
    for i, t, _ in rows:
        base, every = brute(t)
        n = [sum(k == r.kind for _, _, k, _ in base) for r in BASE_RULES]
        want.append((-1 if i is None else i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    assert got == sorted(want)
    assert len(EXTRA_RULES) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert digest(scan_secrets(df)).count() == 0
