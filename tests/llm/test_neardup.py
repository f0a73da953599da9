"""Near copies by similarity beside a version that compares the shingles of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import components, documents
from weekcast.llm import neardup, simhash


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids that stand for their component, of rows with ids that do not repeat."""
    sets = {i: plain_shingles(t) for i, t in rows}
    ids, links = sorted(sets), []
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            either = len(sets[i] | sets[j])
            if not either or both / either >= 0.8:
                links.append((i, j))
    return set(components(ids, links).values())


def edited(words, draw, times):
    words = list(words)
    for _ in range(times):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_stage_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in pipeline.simhash_stage(spark, docs, folder).collect()} == plain_kept(rows)


@pytest.mark.parametrize("block", [8192, 40])
def test_edited_copies(spark, monkeypatch, block):
    """Copies with some words changed, more than three bits away; small blocks split the segments."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    draw = random.Random(3)
    texts = []
    for _ in range(30):
        base = [f"w{draw.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), edited(base, draw, 4), edited(base, draw, 8), edited(base, draw, 40)]
    rows = list(enumerate(texts))
    wanted = plain_kept(rows)
    assert len(wanted) < 90
    assert {r.doc_id for r in neardup.keep_one(documents(spark, rows)).collect()} == wanted


def test_one_row_of_each_component(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = documents(spark, [(2, long), (2, long), (2, long + " end"), (5, long.upper()), (None, long), (None, "alone here"),
                             (None, "alone  here"), (7, None), (8, ""), (9, " \n"), (None, "")], ["1 AS key", "2 AS row", "3 AS id"])
    out = neardup.keep_one(rows)
    assert out.columns == rows.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 7]
    assert neardup.keep_one(rows.limit(0)).count() == 0


def test_forest_has_the_strongest_pairs():
    draw = np.random.default_rng(2)
    i, j = (draw.integers(0, 40, 300) for _ in range(2))
    weight = draw.integers(0, 9, 300) / 8
    at = neardup.strongest(i, j, weight, np.arange(300), 40)
    for level in np.unique(weight):
        want = components(range(40), zip(i[weight >= level].tolist(), j[weight >= level].tolist(), strict=True))
        some = at[weight[at] >= level]
        assert components(range(40), zip(i[some].tolist(), j[some].tolist(), strict=True)) == want


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("leaf", [16, 1 << 14])
def test_candidates_come_from_a_walk_of_tries_in_pairs(monkeypatch, same, leaf):
    """The same pairs as all comparisons, and a pair of nodes whose paths differ too much is not compared."""
    walked, compared, walk, blocks = [], [], neardup.trie_links, simhash._blocks

    def counted(a, b, alo, ahi, blo, bhi, budget):
        compared.append(int(((ahi - alo) * (bhi - blo)).sum()))
        return blocks(a, b, alo, ahi, blo, bhi, budget)

    monkeypatch.setattr(neardup, "trie_links", lambda *args: walked.append(args[3]) or walk(*args))
    monkeypatch.setattr(simhash, "_blocks", counted)
    monkeypatch.setattr(neardup, "LEAF", leaf)
    draw = np.random.default_rng(5)
    low = draw.integers(0, 1 << 30, 400, dtype=np.uint64)
    far = np.uint64(0x03FFFFF000000000)  # 22 bits below the five leading ones
    values = np.concatenate([low, low ^ np.uint64(0b1011), low ^ far, low[:50]])
    if same:
        values[:100] ^= np.uint64(1) << np.uint64(63)
    first = draw.random(len(values)) < 0.5
    got = [np.sort(np.stack(p), axis=0) for p in neardup._near(values, first, same, 5)]
    got = {(int(i), int(j)) for p in got for i, j in p.T}
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    near = (apart <= neardup.MAX_BITS) & (values[:, None] >> np.uint64(59) == values[None, :] >> np.uint64(59))
    near &= np.ones_like(near) if same else first[:, None] != first[None, :]
    assert got == {(int(i), int(j)) for i, j in np.argwhere(near) if i < j}
    assert walked == [neardup.MAX_BITS]
    every = len(values) ** 2 // 2 if same else int(first.sum() * (~first).sum())
    assert sum(compared) < every * 0.8


def test_a_pair_beside_the_forest_is_decided(spark, monkeypatch):
    """Two similar texts and a third that their sketches take for nearer than it is: the forest leaves out the only link."""
    words = [f"w{i}" for i in range(100)]
    near, far = [*words[:-9], *(f"x{i}" for i in range(9))], [*words[:-30], *(f"y{i}" for i in range(30))]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    assert plain_kept(rows) == {1, 3}
    monkeypatch.setattr(neardup, "fingerprint", lambda text, shingle: bytes(8))
    monkeypatch.setattr(neardup, "sketch", lambda text: bytes(
        [1] * 32 + [3 if "w99" in text else 1] * 8 + [3 if "x8" in text else 1] * 8 + [1] * 16))
    assert {r.doc_id for r in neardup.keep_one(documents(spark, rows)).collect()} == {1, 3}


@pytest.mark.parametrize("block", [8192, 40])
def test_remaining_pairs_are_all_candidates_apart(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 62, 60)
    prints = np.concatenate([base, base ^ 0b1011, base ^ (1 << 40), base[:20] ^ 0x1F])
    rows = [(i, int(p), int(i % 7 if i % 3 else 1000 + i), bytes([1 + i % 2] * 64)) for i, p in enumerate(prints)]
    units = spark.createDataFrame(rows, "key long, fp long, component long, sketch binary")
    got = [(r.a, r.b) for r in neardup.remaining_pairs(units).collect()]
    lead, want = 64 // neardup.TURNS, set()
    for i, p, c, s in rows:
        for j, q, d, r in rows[i + 1 :]:
            shared = any((p ^ q) >> (64 - lead * (t + 1)) & 31 == 0 for t in range(neardup.TURNS))
            if c != d and s == r and shared and (p ^ q).bit_count() <= neardup.MAX_BITS:
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
