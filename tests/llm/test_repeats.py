"""Periodic runs beside a version that tries every lag."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tests.llm.helpers import documents
from weekcast.llm import repeats
from weekcast.llm.queries import op13_runs


def plain_runs(words):
    """(start, length, period) of all runs: longest agreements along every diagonal, smallest period by trial."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - q:
            start = at
            while at < len(words) - q and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if at > start and length >= max(6, 4 * q):
                run = words[start : start + length]
                if not any(all(run[x] == run[x + d] for x in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            at += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))

    def digest(shown):
        return hashlib.sha256(shown.encode()).hexdigest()

    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query_against_all_lags(spark, folder):
    got = op13_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [tuple(r) for r in got.collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(rows, key=key) == sorted((plain(r.doc_id, r.text) for r in docs), key=key)
    assert sum(r[1] > 0 for r in rows) > 5


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_words(letters):
    draw = random.Random(letters)
    for _ in range(300):
        words = [draw.randrange(letters) for _ in range(draw.randrange(90))]
        for _ in range(draw.randrange(3)):
            start, q = draw.randrange(90), draw.randrange(1, 12)
            for x in range(start + q, min(len(words), start + draw.randrange(70))):
                words[x] = words[x - q]
        got = sorted(repeats.find_runs(np.array(words, dtype=np.int64)), key=lambda r: (r[0], r[2]))
        assert got == plain_runs(words), words


def test_lengths_at_the_limits():
    for q, length, want in ((1, 5, 0), (1, 6, 1), (2, 7, 0), (2, 8, 1), (3, 11, 0), (3, 12, 1), (40, 159, 0), (40, 160, 1)):
        words = [100, *[i % q for i in range(length)], 200]
        assert repeats.find_runs(np.array(words)) == [(1, length, q)] * want


def test_awkward_rows(spark):
    base = "a b a b a b a b c"
    texts = [(1, None), (2, ""), (3, " \n\t\v\f\r"), (None, base), (4, base), (4, base), (5, base.upper()), (6, "  " * 9)]
    rows = documents(spark, texts, ["1 AS runs", "2 AS salt", "3 AS id", "4 AS collapsed", "5 AS n_words"])
    found = sorted(tuple(r) for r in repeats.periodic_runs(rows).fillna({"doc_id": -1}).collect())
    kept = [(0, 8, 2)]
    assert found == [
        (-1, 9, kept, "a b c"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 9, kept, "a b c"), (4, 9, kept, "a b c"),
        (5, 9, kept, "A B C"), (6, 9, [(0, 9, 1)], " "),
    ]
    assert repeats.periodic_runs(rows.limit(0)).count() == 0


def test_runs_do_not_cross_documents(spark):
    found = repeats.periodic_runs(documents(spark, ["x x x x x"] * 4 + ["x"] * 9).coalesce(1))
    assert [r.runs for r in found.collect()] == [[]] * 13


def test_long_texts_take_no_square(spark):
    began = time.time()
    same, cycle = np.zeros(300_000, np.int64), np.arange(300_000) % 20_011
    assert repeats.find_runs(same) == [(0, 300_000, 1)] and repeats.find_runs(cycle) == [(0, 300_000, 20_011)]
    assert len(repeats.find_runs(np.arange(300_000) // 6)) == 50_000
    assert time.time() - began < 30
