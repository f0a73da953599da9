"""SimHash near-duplicates beside a version that compares all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import components, documents
from weekcast.llm import simhash
from weekcast.llm.queries import op7_simhash


def plain_print(text):
    """Bit by bit, from the definition."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = {i: plain_print(t) for i, t in rows}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    links = []
    for n, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values[n + 1 :] ^ values[n]) <= 3)
        links += [(i, ids[n + 1 + k]) for k in near]
    return prints, components(ids, links)


def test_query_against_all_pairs(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints, found = plain_components(rows)
    got = op7_simhash(spark, folder).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", found[i]) for i in prints
    }


def test_fingerprints_of_odd_texts():
    for text in ("", " \t\n\x0b\x0c\r", "A", "a B", "İ ſ K Ä", "x y z\x0bw", "a\xa0b c d", "é " * 100, "w " * 70000):
        assert int.from_bytes(simhash.fingerprint(text), "big") == plain_print(text)


@pytest.mark.parametrize("seed", range(6))
def test_trie_walk_finds_each_pair_once(seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**63, size=3, dtype=np.uint64)

    def some(n, top):
        v = base[draw.integers(0, 3, n)].copy()
        for _ in range(seed % 5):
            v ^= np.uint64(1) << draw.integers(0, 56, n).astype(np.uint64)
        return np.unique(v & np.uint64(2**56 - 1) | np.uint64(top << 56))

    for lead, a, b in ((8, some(90, 5), some(70, 5)), (0, some(90, 5), some(70, 7)), (58, some(90, 5), some(70, 5)[:0])):
        for same, x, y in ((True, a, a), (False, a, b)):
            got = [(int(i), int(j)) for p, q in simhash.trie_links(x, y, same, 3, lead) for i, j in zip(p, q, strict=True)]
            got = [(min(g), max(g)) if same else g for g in got]
            apart = x[:, None] ^ y[None, :]
            equal = (apart >> np.uint64(64 - lead)) == 0 if lead else np.ones(apart.shape, bool)
            near = np.argwhere((np.bitwise_count(apart) <= 3) & equal)
            want = {(int(i), int(j)) for i, j in near if not same or i < j}
            assert len(got) == len(set(got)) and set(got) == want


def test_many_tasks_and_blocks(spark, monkeypatch):
    """Small limits make several tasks, and several blocks for a crowded segment."""
    monkeypatch.setattr(simhash, "TASK_ROWS", 50)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    draw = random.Random(4)
    values = {draw.getrandbits(64) for _ in range(60)}
    center = draw.getrandbits(64)
    for _ in range(90):
        value = center
        for _ in range(draw.randint(0, 4)):
            value ^= 1 << draw.randrange(64)
        values.add(value)
    values = sorted(values)
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = [(r.fp, r.root) for r in simhash.fingerprint_links(frame).collect()]
    assert components(list(signed.values()), found) == components(
        list(signed.values()), [(signed[a], signed[b]) for a, b in links]
    )


def test_nulls_repeats_and_clashing_columns(spark):
    texts = [(5, "one two three four"), (2, "ONE two  three four"), (2, "ONE two  three four"), (None, "one two three four"),
             (7, None), (8, ""), (9, " \n"), (None, "other words entirely here now")]
    rows = documents(spark, texts, ["1 AS fp", "2 AS component_id", "3 AS id"])
    found = simhash.near_duplicates(rows).collect()
    assert len(found) == 8
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [
        (0, 0), (0, 2), (2, 2), (2, 2), (5, 2), (7, 7), (8, 7), (9, 7),
    ]
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id or 0 for r in kept.where("doc_id is not null").collect()) == [2, 2, 7]
