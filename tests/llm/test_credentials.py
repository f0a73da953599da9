"""Secret scan beside a version with Python's regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import documents
from weekcast.llm import credentials
from weekcast.llm.credentials import KINDS, SCOPE, scan_secrets, span_digests

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def plain_spans(text):
    base = plain_base(text)
    weak = [
        (m.start(), r, m.end()) for r, k in enumerate(KINDS) if k.wants
        for m in re.finditer(k.pattern, text) if len(m.group(k.value)) >= k.least
    ]
    every = base + weak
    near = lambda s, o: o[0] <= s[2] + SCOPE and o[2] >= s[0] - SCOPE
    return sorted(base + [s for s in weak if any(KINDS[o[1]].part == KINDS[s[1]].wants and near(s, o) for o in every)])


def shown(spans):
    return ",".join(f"{KINDS[r].name}:{a}:{b}" for a, r, b in spans)


def check(spark, rows):
    found = {r.doc_id: r for r in span_digests(scan_secrets(documents(spark, rows))).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base, row = plain_base(text or ""), found[i]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == r for s in base) for r in range(3)), text
        assert row.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest(), text
        assert row.spans == shown(plain_spans(text or "")), text
    return found


def test_random_texts(spark):
    draw = random.Random(8)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", ": ", " = ", "=", "\"", "'", "AKIA", "A1B2C3D4E5F6G7H8",
            "0123456789abcdef", "deadbeef00", "é", "😀", "\n", " ", "xyz", "user", "login: bob", "client_id=abc", "ſecret=abcdefg",
            "toKen=abcdefg", "https://a.b/c?d=1", "Q" * 25, "w/+x" * 6, "pad " * 30, ":", "abc"]
    rows = [(i, "".join(draw.choices(bits, k=draw.randint(0, 40)))) for i in range(400)]
    found = check(spark, rows)
    assert sum("weak" in r.spans for r in found.values()) > 50
    assert sum(r.n_assign + r.n_access + r.n_hex for r in found.values()) > 100


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "secret: token: abcdefg"), (4, "token=token=abcdef"), (5, "AKIAAKIA" + "Z" * 16),
        (6, "user: bob" + " " * SCOPE + "secret=abcdefgh"), (7, "user: bob" + " " * (SCOPE + 1) + "secret=abcdefgh"),
        (8, "password=" + "a1" * 30000 + " user=bob"), (9, ("secret=abcdef user=bob " * 1500)), (10, "https://x.y/z"),
    ]
    found = check(spark, rows)
    assert found[3].n_assign == 0 and found[4].n_assign == 1
    assert "weak_id" in found[6].spans and "weak_id" not in found[7].spans and found[10].spans == ""


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = check(spark, rows)
    assert any(r.spans for r in found.values())


def test_repeats_null_ids_and_clashing_columns(spark):
    text = "user=bob secret=abcdefgh"
    rows = documents(spark, [(1, text), (1, text), (None, text), (1, "other")], ["1 AS base", "2 AS weak", "3 AS _key", "4 AS found"])
    found = span_digests(scan_secrets(rows)).collect()
    assert sorted((r.doc_id or 0, r.spans.count(",")) for r in found) == [(0, 1), (1, 0), (1, 1), (1, 1)]


def test_many_matches_in_a_text(spark):
    """A log of 100,000 secrets, and texts around the number of matches that are placed together."""
    import time

    one = "token=abcdef1 "
    for n in (1, 127, 128, 129, 257):
        found = credentials.scan_secrets(documents(spark, ["é " + one * n])).first()
        assert [(s.start, s.end) for s in found.base] == [(2 + 14 * i, 15 + 14 * i) for i in range(n)]
    began = time.time()
    found = credentials.scan_secrets(documents(spark, [one * 100_000])).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    assert (found.n, found["last"].start) == (100_000, 14 * 99_999)
    assert time.time() - began < 30
