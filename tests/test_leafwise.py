"""Leaf-wise boosting beside a plain version that splits one leaf at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from weekcast.operators import leafwise, models
from weekcast.operators.leafwise import Settings


def plain_tree(x, y, score, s):
    """Leaves as row sets; the one with the best split is split next. Returns (values per row, [(feature, threshold)])."""
    g = score - y

    def best(rows):
        found = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(len(left), len(right)) < s.min_child_samples:
                    continue
                gain = sum(g[p].sum() ** 2 / (len(p) + s.reg_lambda) for p in (left, right)) - g[rows].sum() ** 2 / (len(rows) + s.reg_lambda)
                if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-12)):
                    found = (gain, f, cut, left, right)
        return found

    leaves = [(np.arange(len(y)), 0)]
    splits = []
    while len(leaves) < s.num_leaves:
        options = [(b, i) for i, (rows, depth) in enumerate(leaves)
                   if (s.max_depth is None or depth < s.max_depth) and (b := best(rows)) is not None]
        if not options:
            break
        (_, f, cut, left, right), i = max(options, key=lambda o: o[0][0])
        splits.append((f, float(cut)))
        depth = leaves.pop(i)[1] + 1
        leaves += [(left, depth), (right, depth)]
    value = np.zeros(len(y))
    for rows, _ in leaves:
        value[rows] = -s.learning_rate * g[rows].sum() / (len(rows) + s.reg_lambda)
    return value, splits


def data(spark, n=500, seed=1):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.integers(0, 12, n), draw.integers(0, 30, n), draw.integers(0, 3, n)]).astype(float)
    y = np.where(x[:, 0] > 5, x[:, 1], 20 - x[:, 2] * 3) + draw.normal(0, 1, n)
    frame = spark.createDataFrame([(*map(float, r), float(v), i) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, y double, i int")
    return frame.repartition(3), x, y


WHOLE = dict(subsample=1.0, colsample_bytree=1.0)


@pytest.mark.parametrize("settings", [
    Settings(n_estimators=3, num_leaves=8, min_child_samples=5, learning_rate=0.3, **WHOLE),
    Settings(n_estimators=2, num_leaves=20, min_child_samples=10, max_depth=3, reg_lambda=2.0, **WHOLE),
    Settings(n_estimators=10, num_leaves=2, min_child_samples=20, learning_rate=0.5, **WHOLE),
])
def test_equals_one_split_at_a_time(spark, settings):
    frame, x, y = data(spark)
    model = leafwise.fit_leafwise(frame, ["a", "b", "c"], "y", settings)
    score = np.full(len(y), y.mean())
    for tree in model.trees:
        value, splits = plain_tree(x, y, score, settings)
        score += value
        got = sorted((f, float(model.edges[f][b])) for f, b in zip(tree.feature, tree.bin) if f >= 0)
        assert got == sorted(splits)
    assert len(model.trees) == settings.n_estimators
    out = {r.i: r.prediction for r in models.predict(model, frame).collect()}
    assert np.allclose([out[i] for i in range(len(y))], score)
    assert np.allclose(model.predict(x), score)


def test_passes_follow_depth_not_splits(spark, monkeypatch):
    frame, _, _ = data(spark, 2000)
    passes = []
    plain = leafwise.histograms

    def counted(*args, **kwargs):
        passes.append(len(args[5]))
        return plain(*args, **kwargs)

    monkeypatch.setattr(leafwise, "histograms", counted)
    model = leafwise.fit_leafwise(frame, ["a", "b", "c"], "y", Settings(n_estimators=1, num_leaves=31, **WHOLE))
    assert sum(f >= 0 for f in model.trees[0].feature) == 30 and len(passes) <= 15


def test_sampling_and_pending_trees(spark, monkeypatch):
    frame, _, y = data(spark)
    settings = Settings(n_estimators=6, num_leaves=4, min_child_samples=5, subsample=0.5, colsample_bytree=0.67)
    trees = []
    for pending in (1, 8):
        monkeypatch.setattr(leafwise, "PENDING", pending)
        trees.append(leafwise.fit_leafwise(frame, ["a", "b", "c"], "y", settings).trees)
    assert [t.feature for t in trees[0]] == [t.feature for t in trees[1]] and [t.bin for t in trees[0]] == [t.bin for t in trees[1]]
    assert np.allclose(np.concatenate([t.value for t in trees[0]]), np.concatenate([t.value for t in trees[1]]))
    marks = np.arange(20_000)
    assert leafwise.sampled(marks, 1, 0.3).mean() == pytest.approx(0.3, abs=0.02)
    assert (leafwise.sampled(marks, 1, 0.5) & leafwise.sampled(marks, 2, 0.5)).mean() == pytest.approx(0.25, abs=0.02)


def test_early_stopping_keeps_the_best(spark):
    frame, _, _ = data(spark)
    noisy = frame.selectExpr("a", "b", "c", "i", "CASE WHEN i % 3 = 0 THEN y ELSE y + 30 * sin(i * 7.3) END AS y", "i % 3 = 0 AS held")
    settings = Settings(n_estimators=40, num_leaves=15, min_child_samples=2, learning_rate=0.5, early_stopping_rounds=3, **WHOLE)
    model = leafwise.fit_leafwise(noisy, ["a", "b", "c"], "y", settings, "held")
    rows = noisy.where("held").toPandas()
    errors = []
    for n in range(1, len(model.trees) + 1):
        part = leafwise.LeafwiseModel(model.features, model.edges, model.base, model.trees[:n], "p")
        errors.append(np.abs(part.predict(rows[["a", "b", "c"]].to_numpy()) - rows.y).mean())
    assert len(model.trees) < 37 and np.argmin(errors) == len(errors) - 1


def test_bins(spark):
    frame = spark.range(1000).selectExpr("cast(id % 7 as double) few", "id * 1.5 many", "IF(id < 500, NULL, id) holes", "double('NaN') odd")
    few, many, holes, odd = leafwise.bin_edges(frame, ["few", "many", "holes", "odd"], 64)
    assert few.tolist() == [0, 1, 2, 3, 4, 5] and odd.tolist() == []
    assert len(many) == 63 and np.allclose(np.diff(many), 1500 / 64, atol=4)
    assert holes[0] == 0 and len(holes) <= 63
    assert leafwise.to_bins(np.array([[0.0], [0.5], [6.0], [9.0]]), [few]).ravel().tolist() == [0, 1, 6, 6]


def test_awkward_frames(spark, tmp_path):
    frame, x, _ = data(spark, 60)
    flat = frame.selectExpr("a", "b", "1.0 AS y")
    model = leafwise.fit_leafwise(flat, ["a", "b"], "y", Settings(n_estimators=5, **WHOLE))
    assert len(model.trees) == 1 and np.allclose(model.predict(x[:, :2]), 1.0)
    empty = leafwise.fit_leafwise(flat.limit(0), ["a", "b"], "y", Settings(n_estimators=2, **WHOLE))
    assert np.allclose(empty.predict(x[:, :2]), 0.0)
    holes = frame.selectExpr("IF(i % 5 = 0, NULL, a) a", "IF(i % 7 = 0, double('NaN'), b) b", "IF(i % 11 = 0, NULL, y) y", "i")
    model = leafwise.fit_leafwise(holes, ["a", "b"], "y", Settings(n_estimators=3, num_leaves=5, min_child_samples=3))
    shown = {r.i: r.prediction for r in models.predict(model, holes).collect()}
    assert len(shown) == 60 and all(np.isfinite(v) for v in shown.values())
    models.save_model(model, str(tmp_path / "model"))
    again = models.load_model(str(tmp_path / "model"), "gbt_alt")
    assert {r.i: r.prediction for r in models.predict(again, holes).collect()} == shown
    assert [r.feature for r in models.importances(model, holes).collect()][0] in ("a", "b")
    assert sum(r.importance for r in models.importances(model, holes).collect()) == sum(model.splits())


def test_pending_trees_are_applied_to_counted_rows_only():
    """A pass that counts the smaller child sends no other row through the trees that the scores lack."""
    seen = []

    class Recorded(leafwise.Tree):
        def add_to(self, score, bins):
            seen.append(len(bins))
            super().add_to(score, bins)

    codes = np.arange(200, dtype=np.uint8).reshape(100, 2)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(np.arange(100.0)), pa.array(np.arange(100)), pa.array(np.ones(100)),
         pa.array(np.arange(100) < 5)],
        names=["bins", "y", "mark", "score", "held"],
    )
    pending, tree = Recorded(), leafwise.Tree()
    left, right = pending.split(0, 1, 99)
    pending.value[left], pending.value[right] = 0.5, -0.5
    left, _ = tree.split(0, 0, 38)
    slots = np.full(3, -1)
    slots[left] = 0
    slot, bins, gradient = leafwise._counted(batch, 2, [pending], tree, slots, 1, 1.0)
    assert seen == [15] and slot.tolist() == [0] * 15 and bins.tolist() == codes[5:20].tolist()
    assert gradient.tolist() == (1.5 - np.arange(5.0, 20.0)).tolist()


def test_passes_read_blocks_of_rows(spark, monkeypatch):
    """A pass gets whole blocks, not rows, and sends on one array per leaf and task; the blocks are let go at the end."""
    monkeypatch.setattr(leafwise, "BLOCK_ROWS", 64)
    frame, x, y = data(spark, 1000)
    names, blocks = ["a", "b", "c"], []
    plain = leafwise.histograms
    monkeypatch.setattr(leafwise, "histograms", lambda kept, *args: blocks.append(kept) or plain(kept, *args))
    model = leafwise.fit_leafwise(frame, names, "y", Settings(n_estimators=1, num_leaves=4, **WHOLE))
    kept = blocks[0]
    assert not kept.is_cached and all(b is kept for b in blocks)
    sizes = [b.num_rows for block in kept.collect() for b in leafwise._opened([block])]
    assert sum(sizes) == 1000 and max(sizes) <= 64 and len(sizes) < 64
    bins = max(len(e) + 1 for e in model.edges)
    tree = model.trees[0]
    leaves = [n for n, f in enumerate(tree.feature) if f < 0]
    found = plain(kept, 3, bins, [], tree, leaves, 0, 1.0)
    codes = model.bins(x)
    ends = tree.leaves_of(codes)
    for leaf in leaves:
        for f in range(3):
            at = codes[ends == leaf, f]
            assert found[leaf][f, :, 0].tolist() == np.bincount(at, minlength=bins).tolist()
            assert np.allclose(found[leaf][f, :, 1], np.bincount(at, (model.base - y)[ends == leaf], bins))
    some = tree.leaves_of(codes, leaves[:1])
    assert (some == np.where(ends == leaves[0], ends, -1)).all()


def test_bin_edges_are_quantiles_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(leafwise, "SUMMARY_ROWS", 1000)
    monkeypatch.setattr(leafwise, "SUMMARY_POINTS", 300)
    frame = spark.range(0, 20_000, 1, 3).selectExpr("cast(id * id as double) x", "id % 9 as few")
    many, few = leafwise.bin_edges(frame, ["x", "few"], 16)
    places = np.sqrt(many) / 20_000
    assert np.abs(places - np.arange(1, 16) / 16).max() < 0.01 and few.tolist() == list(range(8))
