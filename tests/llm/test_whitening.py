"""Whitening beside NumPy over the same whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from weekcast.llm import whitening
from weekcast.llm.queries import op11_whitening


def plain(rows, components=16):
    """{row number: (id, deviation, whitened components)}, n, shares and used of vectors of one length."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(x[i] for x in fit) for i in range(len(fit[0]))]
    y = np.array([[n * c - s for c, s in zip(x, total, strict=True)] for x in fit], dtype=object)
    centred = y.astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        apart = [n * c - s for c, s in zip(x, total, strict=True)]
        out.append((i, sum(a * a for a in apart), np.array([a / n for a in apart]) @ vectors / np.sqrt(np.maximum(values, 1e-300))))
    return out, n, values / np.trace(cov)


def check(found, rows, components=16):
    want, n, shares = plain(rows, components)
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(found) == len(want) * len(shares) and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error <= 1e-4
    signs = None
    for i, deviation, whitened in want:
        mine = sorted({(r.component, r.whitened, r.explained) for r in got[i, deviation]})
        assert [m[0] for m in mine] == list(range(1, len(shares) + 1))
        w = np.array([m[1] for m in mine])
        if signs is None and (np.abs(w) > 1e-3).all():
            signs = np.sign(w * whitened)
        assert np.allclose(np.abs(w), np.abs(whitened), atol=1e-6)
        assert signs is None or np.allclose(w, signs * whitened, atol=1e-6)
        assert np.allclose([m[2] for m in mine], shares, rtol=1e-6)


def test_query_against_numpy(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = op11_whitening(spark, folder)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), rows)


@pytest.mark.parametrize("block", [4096, 7])
def test_copies_odd_rows_and_blocks(spark, monkeypatch, block):
    """A vector shared by a third of the rows counts once in the fit; null, non-finite and repeated rows."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[4][1]), (7, None)]
    rows += [(8, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (9, [math.nan] * 6), (10, [1.0, math.inf, 1.0, 1.0, 1.0, 1.0]), (11, [1e4, -3e5, 0.5, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.selectExpr("*", "1 AS x", "2 AS index", "3 AS values", "4 AS component", "5 AS n", "6 AS y")
    found = whitening.whiten(frame).collect()
    assert whitening.whiten(frame.limit(0)).count() == 0
    check(found, rows)


def test_flat_directions_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0]), (4, [1.0]), (5, [5.0, 5.0, 5.0]), (6, []), (7, [1e300, 0.0, 0.0])]
    rows = rows[:-1]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    shown = {(r.vec_id, r.component): (r.n, r.whitened is None, round(r.explained, 9)) for r in found}
    assert shown == {
        **{(i, 1): (3, False, 1.0) for i in (1, 2, 3)}, **{(i, 2): (3, True, 0.0) for i in (1, 2, 3)},
        (4, 1): (1, True, 0.0), **{(5, c): (1, True, 0.0) for c in (1, 2, 3)},
    }
    assert all(r.identity_error < 1e-9 for r in found)


def test_huge_entries_are_held(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6 and all(math.isfinite(r.whitened) for r in found if r.component == 1)
