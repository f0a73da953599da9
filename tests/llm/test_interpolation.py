"""Interpolated scores beside a version of dictionaries, with weights learned without bins."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from weekcast.llm import interpolation
from weekcast.llm.queries import op12_scores



def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    """Counts and weights of documents [(id, text, role)]."""

    def __init__(self, rows, order):
        self.order = order
        self.final, self.kept = self.count(rows, (0, 1)), self.count(rows, (0,))
        self.weights = []
        for k in range(order):
            by = {}
            for _, text, role in rows:
                for history, w in self.events(text):
                    if role == 1:
                        context = self.context(self.kept, history, k)
                        if context:
                            ratio = self.kept[1][k][self.gram(history, w, k)] / context / self.p(self.kept, history, w, k)
                            by.setdefault(self.bucket(context, k), []).append(ratio)
            self.weights.append({b: interpolation.maximise(np.array(r), np.ones(len(r))) for b, r in by.items()})

    def events(self, text):
        words = words_of(text)
        marks = ["<s>"] * (self.order - 1)
        return [(tuple([*marks, *words][i : i + self.order - 1]), w) for i, w in enumerate(words)]

    @staticmethod
    def gram(history, w, k):
        return (*history[len(history) - k :], w)

    def count(self, rows, roles):
        counts = [Counter() for _ in range(self.order)]
        mine = [text for _, text, role in rows if role in roles]
        for text in mine:
            for history, w in self.events(text):
                for k in range(self.order):
                    counts[k][self.gram(history, w, k)] += 1
        below = [Counter() for _ in range(self.order)]
        for k in range(self.order):
            for g, n in counts[k].items():
                below[k][g[:-1]] += n
        return len(mine), counts, below, sum(counts[0].values()), len(counts[0])

    def context(self, model, history, k):
        return model[2][k][history[len(history) - k :]]

    @staticmethod
    def bucket(context, k):
        return context.bit_length() if k else 1

    def weight(self, k, b):
        known = self.weights[k]
        if not known:
            return 0.5
        return known[max((x for x in known if x <= b), default=min(known))]

    def p(self, model, history, w, levels):
        p = 1 / (model[4] + 1)
        for k in range(levels):
            context = self.context(model, history, k)
            if context:
                weight = self.weight(k, self.bucket(context, k))
                p = weight * model[1][k][self.gram(history, w, k)] / context + (1 - weight) * p
        return p

    def score(self, text):
        _, counts, _, tokens, types = self.final
        words = words_of(text)
        base = sum(math.log10((counts[0][(w,)] + 1) / (tokens + types + 1)) for w in words)
        full = sum(math.log10(self.p(self.final, h, w, self.order)) for h, w in self.events(text))
        return len(words), sum(counts[0][(w,)] > 0 for w in words), tokens, base, full


def roles(frame):
    deleted = F.pmod(F.xxhash64("doc_id", F.lit("deleted")), F.lit(interpolation.DELETED_SHARE)) == 0
    named = frame.select("doc_id", "text", F.when(held(), 2).when(deleted, 1).otherwise(0).alias("role"))
    return [tuple(r) for r in named.collect()]


def check(frame, order):
    rows = roles(frame)
    plain = Plain(rows, order)
    found = interpolation.score_documents(frame, held(), order=order).collect()
    want = sorted(((i, text, role == 2) for i, text, role in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(want) and sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (w[0] for w in want)))
    exact = Counter()
    for i, text, is_held in want:
        n, known, tokens, base, full = plain.score(text)
        exact[i, is_held, n, known, tokens, round(base, 6)] += 1
        near = [r.score for r in got if r.doc_id == i and r.n_tokens == n and abs(r.base_score - base) < 1e-6]
        assert min(abs(x - full) for x in near) <= 0.002 * n + 1e-3 * abs(full)
    assert exact == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    return plain, rows, got


def made_up(count, seed=1):
    draw = random.Random(seed)
    follow = {w: [draw.randrange(60) for _ in range(4)] for w in range(60)}
    texts = []
    for _ in range(count):
        w, words = draw.randrange(60), []
        for _ in range(draw.randrange(60)):
            words.append(f"W{w}")
            w = draw.choice(follow[w]) if draw.random() < 0.9 else draw.randrange(70)
            follow.setdefault(w, [w])
        texts.append("\t ".join(words))
    return texts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, monkeypatch, order):
    """Small chunks and shards, so that counts really are of many."""
    monkeypatch.setattr(interpolation, "SHARD_KEYS", 300)
    rows = documents(spark, [*made_up(150), None, "", "unheard of", (None, "w1 w2"), (None, None), (5, "W3 W3"), (5, "W3 W3")],
                     ["1 AS id", "2 AS role", "3 AS chunk", "4 AS score"]).repartition(3)
    plain, given, got = check(rows, order)
    unseen = [r for r in got if r.held_out and r.n_tokens > 1]
    assert order == 1 or sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    words = [g[0] for g in plain.final[1][0]]
    for history in {h for _, text, _ in given[:20] for h, _ in plain.events(text)}:
        left = 1 - sum(plain.p(plain.final, history, w, order) for w in words)
        assert abs(left - plain.p(plain.final, history, "never", order)) < 1e-9


def test_query_on_whole_table(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    _, _, got = check(frame, 2)
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    query = op12_scores(spark, folder)
    assert query.columns == columns and query.count() == len(got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_chunks_do_not_change_scores(spark, monkeypatch):
    rows = documents(spark, [*made_up(80, 2), "w " * 5000])
    whole = {r.doc_id: r.score for r in interpolation.score_documents(rows.coalesce(1), held()).collect()}
    # Workers have their own copy of the module, so smaller chunks come from more partitions.
    parts = {r.doc_id: r.score for r in interpolation.score_documents(rows.repartition(9), held()).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-6 for i in whole)


def test_nothing_to_learn_from(spark):
    rows = documents(spark, ["a b", None])
    got = interpolation.score_documents(rows, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2
    assert interpolation.score_documents(rows.limit(0), held()).count() == 0


def test_numbers_as_bytes():
    draw = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(interpolation.unpack_sorted(interpolation.pack_sorted(keys)), keys)
        for kind in ("<u4", "<u8"):
            values = draw.integers(0, 2**31, n).astype(kind)
            assert np.array_equal(interpolation.unpack(interpolation.pack(values), kind), values)


def test_weight_is_the_likeliest():
    ratios, times = np.array([0.0, 0.5, 3.0, 20.0]), np.array([40.0, 30.0, 20.0, 10.0])
    w = interpolation.maximise(ratios, times)
    grid = np.linspace(1e-4, 1 - 1e-4, 20_001)
    gain = (np.log(grid[:, None] * ratios + 1 - grid[:, None]) * times).sum(axis=1) + 0.5 * (np.log(grid) + np.log(1 - grid))
    assert abs(w - grid[gain.argmax()]) < 1e-3
