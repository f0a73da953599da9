"""Boosted trees grown best leaf first, on Spark.

Features become bin numbers once; the binned table is written in blocks of rows, and these are kept in memory or on disk
for the passes (a lost executor costs a re-read). A pass sums the gradients per (leaf, feature, bin) inside the tasks and
adds these histograms up per leaf, so what reaches the driver depends on leaves, features and bins, not on rows. Of two
siblings only the one with fewer rows is counted; the other is the parent less that one.

Growing the best leaf first needs the children of a leaf before it is known whether they are split. A pass therefore
counts the children of all leaves that would be split if nothing better turned up below them, and the tree is grown
anew from what is known by then. It is the same tree as with one pass per split, in about as many passes as it is
deep. Trees that the written scores don't hold yet are applied inside the pass, and every ``PENDING`` trees the table
is written with new scores, which also cuts the lineage.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.plans.scale import materialize

PENDING = 8
# A row of the binned table is a block of rows: (bins, y, mark, score, held) as an Arrow stream of at most so many.
TABLE, BLOCK_ROWS = "block binary", 1 << 14
# Rows whose histograms are counted at once in a task.
COUNTED_ROWS = 1 << 17
# Rows summed up at once where the bins are made, and points that stand for them if they have more values than that.
SUMMARY_ROWS, SUMMARY_POINTS = 1 << 18, 1 << 12


@dataclass(frozen=True)
class Settings:
    """Fixed values by default: those of the usual leaf-wise library."""

    n_estimators: int = 100
    num_leaves: int = 31
    max_depth: int | None = None
    learning_rate: float = 0.1
    min_child_samples: int = 20
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_lambda: float = 0.0
    max_bin: int = 255
    early_stopping_rounds: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Rows with a bin up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, first, first + 1
        for part, empty in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part += [empty, empty]
        return first, first + 1

    def leaves_of(self, bins: np.ndarray, wanted: Sequence[int] | None = None) -> np.ndarray:
        """The node each row of bin numbers ends in. With ``wanted``, -1 for rows that end in no node of it."""
        node = np.full(len(bins), -1)
        some = [wanted is None] * len(self.feature)
        for n in () if wanted is None else wanted:
            some[n] = True
        for n in reversed(range(len(some))):  # children have higher numbers
            if self.feature[n] >= 0:
                some[n] = some[self.left[n]] or some[self.right[n]]
        parts = [(0, None)] if some[0] else []
        while parts:
            n, rows = parts.pop()
            if self.feature[n] < 0:
                node[slice(None) if rows is None else rows] = n
                continue
            column = bins[:, self.feature[n]]
            goes_left = (column if rows is None else column[rows]) <= self.bin[n]
            for child, here in ((self.left[n], goes_left), (self.right[n], ~goes_left)):
                if some[child]:
                    parts.append((child, np.flatnonzero(here) if rows is None else rows[here]))
        return node

    def add_to(self, score: np.ndarray, bins: np.ndarray) -> None:
        if len(score):
            score += np.array(self.value)[self.leaves_of(bins)]


class LeafwiseModel:
    """A fitted ensemble. ``transform`` and ``predict`` take raw features; missing ones count as 0."""

    def __init__(self, features: Sequence[str], edges: list[np.ndarray], base: float, trees: list[Tree], prediction: str):
        self.features, self.edges, self.base, self.trees, self.prediction = list(features), edges, base, trees, prediction

    def bins(self, matrix: np.ndarray) -> np.ndarray:
        return to_bins(np.asarray(matrix, dtype=float), self.edges)

    def predict(self, matrix: np.ndarray) -> np.ndarray:
        bins = self.bins(matrix)
        score = np.full(len(bins), self.base)
        for tree in self.trees:
            tree.add_to(score, bins)
        return score

    def transform(self, frame: DataFrame) -> DataFrame:
        from weekcast.operators.models import score_with

        return score_with(frame, self, self.features, self.prediction)

    def splits(self) -> list[int]:
        """How often each feature is split on."""
        used = np.zeros(len(self.features), np.int64)
        for tree in self.trees:
            for f in tree.feature:
                if f >= 0:
                    used[f] += 1
        return used.tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({
            "features": self.features, "edges": [e.tolist() for e in self.edges], "base": self.base,
            "trees": [asdict(t) for t in self.trees], "prediction": self.prediction,
        })
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LeafwiseModel:
        saved = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        trees, edges = [Tree(**t) for t in saved["trees"]], [np.array(e) for e in saved["edges"]]
        return cls(saved["features"], edges, saved["base"], trees, saved["prediction"])


# -- bins ------------------------------------------------------------------------------------


def to_bins(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Per column, how many edges lie below the value."""
    bins = np.zeros(matrix.shape, np.uint8)
    for j, e in enumerate(edges):
        bins[:, j] = np.searchsorted(e, matrix[:, j], side="left")
    return bins


def _summary(values: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(values, rows each stands for, whether these are all values) of a column, in order: the values if there are at most
    ``points``, else as many quantiles."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    if len(first) <= points:
        return ordered[first], np.diff(np.append(first, len(ordered))), True
    ends = np.arange(1, points + 1) * len(ordered) // points
    return ordered[ends - 1], np.diff(ends, prepend=0), False


def bin_edges(frame: DataFrame, features: Sequence[str], max_bin: int = Settings.max_bin) -> list[np.ndarray]:
    """Upper ends of all bins but the last: every value of a feature with few of them, else its quantiles.

    All rows are sorted, ``SUMMARY_ROWS`` at once, and of these ``SUMMARY_POINTS`` values each remain at most, so a quantile is
    off by at most one in ``SUMMARY_POINTS`` of the rows.
    """
    values = frame.select(*[F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    points = max(SUMMARY_POINTS, max_bin + 1)

    def summed(columns):
        for i, parts in enumerate(columns):
            at, rows, whole = _summary(np.concatenate(parts) + 0.0, points)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i)), pa.array(at), pa.array(rows), pa.array(np.full(len(at), whole))], names=["f", "x", "n", "whole"])

    def run(batches):
        columns, size = [[] for _ in features], 0
        for batch in batches:
            for i, parts in enumerate(columns):
                parts.append(batch.column(i).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= SUMMARY_ROWS:
                yield from summed(columns)
                columns, size = [[] for _ in features], 0
        if size:
            yield from summed(columns)

    def cut(key, part):
        x, n = part["x"].to_numpy(), part["n"].to_numpy()
        order = np.argsort(x, kind="stable")
        x, up_to = x[order], np.cumsum(n[order])
        every = np.unique(x)
        if len(every) <= max_bin and part["whole"].all():
            return pd.DataFrame({"f": key[0], "e": every[:-1]})
        ranks = np.ceil(np.arange(1, max_bin) / max_bin * up_to[-1])
        return pd.DataFrame({"f": key[0], "e": np.unique(x[np.searchsorted(up_to, ranks)])})

    points_of = values.mapInArrow(run, "f bigint, x double, n bigint, whole boolean")
    found: pd.DataFrame = points_of.groupBy("f").applyInPandas(cut, "f bigint, e double").toPandas()  # a bin's end each
    return [np.sort(found["e"].to_numpy(dtype=float)[found["f"].to_numpy() == i]) for i in range(len(features))]


def binned_table(
    frame: DataFrame, features: Sequence[str], target: str, edges: list[np.ndarray], held: str | None, base: float
) -> DataFrame:
    """The rows with a target in blocks, see ``TABLE``: bin numbers in bytes, and a hash that samples rows."""
    inputs = frame.where(F.col(target).isNotNull()).select(
        *[F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)],
        F.col(target).cast("double").alias("y"),
        F.xxhash64(*[F.col(f"`{f}`") for f in features], F.col(target)).alias("mark"),
        (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held"),
    )
    width = len(features)

    def binned(batch):
        matrix = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        bins = np.ascontiguousarray(to_bins(matrix, edges))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(bins), [None, pa.py_buffer(bins.tobytes())])
        return pa.RecordBatch.from_arrays(
            [packed.cast(pa.binary()), batch.column(width), batch.column(width + 1),
             pa.array(np.full(len(bins), base)), batch.column(width + 2)],
            names=["bins", "y", "mark", "score", "held"],
        )

    def row(parts):
        block = _block(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
        return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if size + part.num_rows > BLOCK_ROWS:
                    yield row(parts)
                    parts, size = [], 0
                parts.append(binned(part))
                size += part.num_rows
        if parts:
            yield row(parts)

    return materialize(inputs.mapInArrow(run, TABLE), "binned")


def _block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(blocks: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """The batches of rows in blocks, without copies."""
    for block in blocks:
        yield from pa.ipc.open_stream(block)


def _kept(table: DataFrame) -> RDD:
    return table.rdd.map(lambda row: bytes(row[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _columns(batch: pa.RecordBatch, width: int):
    """(bins, y, mark, score, held) of a batch of the table, with the scores as they were written."""
    packed = batch.column(0)
    flat = np.frombuffer(packed.buffers()[2], np.uint8)
    first = packed.offset and int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
    bins = flat[first : first + len(packed) * width].reshape(-1, width)
    y, mark, score = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    return bins, y, mark, score, batch.column(4).to_numpy(zero_copy_only=False).astype(bool)


def _rows(batch: pa.RecordBatch, width: int, pending: Sequence[Tree]):
    """The same with the trees still to be applied."""
    bins, y, mark, score, held = _columns(batch, width)
    return bins, y, mark, _applied(score, bins, pending), held


def _applied(score: np.ndarray, bins: np.ndarray, pending: Sequence[Tree]) -> np.ndarray:
    score = score.copy()
    for tree in pending:
        tree.add_to(score, bins)
    return score


def sampled(mark: np.ndarray, draw: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by a hash of the row and the tree's number."""
    if share >= 1:
        return np.ones(len(mark), bool)
    x = mark.astype(np.int64).view(np.uint64) + np.array([draw], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * (1 << 64)) if share > 0 else 0)


# -- growing a tree --------------------------------------------------------------------------


def _counted(
    batch: pa.RecordBatch, width: int, pending: Sequence[Tree], tree: Tree, slots: np.ndarray, draw: int, share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, bins, gradient) of the rows of a batch that a pass counts.

    The trees that the written scores lack are the dearest part, and most passes count few rows: they are applied to these only.
    """
    codes, y, mark, score, held = _columns(batch, width)
    drawn = np.flatnonzero(~held & sampled(mark, draw, share))
    node = tree.leaves_of(codes[drawn], np.flatnonzero(slots >= 0))
    used = drawn[node >= 0]
    codes = codes[used]
    return slots[node[node >= 0]], codes, _applied(score[used], codes, pending) - y[used]


def histograms(
    blocks: RDD, width: int, bins: int, pending: Sequence[Tree], tree: Tree, nodes: Sequence[int], draw: int, share: float
) -> dict[int, np.ndarray]:
    """Per node of ``nodes`` (leaves of ``tree``): rows and sum of gradients by feature and bin."""
    slots = np.full(len(tree.feature), -1)
    slots[list(nodes)] = np.arange(len(nodes))

    def count(part):
        totals, waiting = np.zeros((len(nodes), width, bins, 2)), []

        def add():
            slot, codes, gradient = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for f in range(width):
                at = slot * bins + codes[:, f]
                for i, weights in enumerate((None, gradient)):
                    totals[:, f, :, i] += np.bincount(at, weights, len(nodes) * bins).reshape(-1, bins)
            waiting.clear()

        for batch in _opened(part):
            waiting.append(_counted(batch, width, pending, tree, slots, draw, share))
            if sum(len(w[0]) for w in waiting) >= COUNTED_ROWS:
                add()
        if waiting:
            add()
        yield from enumerate(totals)

    summed = blocks.mapPartitions(count).reduceByKey(np.add, min(len(nodes), blocks.getNumPartitions() or 1))
    found = dict(summed.collect())  # leaves times features times bins numbers at most
    return {node: found.get(i, np.zeros((width, bins, 2))) for i, node in enumerate(nodes)}


def best_split(histogram: np.ndarray, settings: Settings, allowed: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node; of equal ones that of the first feature and bin."""
    below = np.cumsum(histogram, axis=1)
    total = below[:, -1:, :]
    n, g = below[..., 0], below[..., 1]
    rest_n, rest_g = total[..., 0] - n, total[..., 1] - g
    enough = (n >= settings.min_child_samples) & (rest_n >= settings.min_child_samples) & (n > 0) & (rest_n > 0)
    enough &= allowed[:, None]
    if not enough.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / (n + settings.reg_lambda) + rest_g**2 / (rest_n + settings.reg_lambda)
        gain -= total[..., 1] ** 2 / (total[..., 0] + settings.reg_lambda)
    gain = np.where(enough, gain, -np.inf)
    feature, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[feature, at]), int(feature), int(at)) if gain[feature, at] > 1e-12 else None


def grow(count, settings: Settings, allowed: np.ndarray) -> Tree:
    """A tree grown best leaf first. ``count(tree, nodes)`` gives the histograms of leaves of a tree.

    Nodes are known by their path of turns from the root, as a tree is grown anew when more is known.
    """
    known: dict[tuple, np.ndarray] = {(): count(Tree(), [0])[0]}
    found: dict[tuple, tuple | None] = {}
    while True:
        tree, paths, wanted = Tree(), {0: ()}, []
        heap: list[tuple] = []

        def offer(node: int, paths=paths, heap=heap) -> None:
            path = paths[node]
            if settings.max_depth is not None and len(path) >= settings.max_depth:
                return
            if path not in found:
                found[path] = best_split(known[path], settings, allowed)
            if found[path] is not None:
                heapq.heappush(heap, (-found[path][0], node))

        offer(0)
        for _ in range(settings.num_leaves - 1):
            if not heap:
                break
            _, node = heapq.heappop(heap)
            path = paths[node]
            _, feature, at = found[path]
            left, right = tree.split(node, feature, at)
            paths[left], paths[right] = (*path, 0), (*path, 1)
            if paths[left] in known:
                offer(left)
                offer(right)
            else:
                rows = np.cumsum(known[path][feature, :, 0])
                fewer = left if 2 * rows[at] <= rows[-1] else right
                wanted.append((node, fewer, left + right - fewer))
        if not wanted:
            for node, path in paths.items():
                if tree.feature[node] < 0:
                    n, g = known[path][0].sum(axis=0)
                    tree.value[node] = float(-settings.learning_rate * g / (n + settings.reg_lambda)) if n else 0.0
            return tree
        counted = count(tree, [fewer for _, fewer, _ in wanted])
        for node, fewer, other in wanted:
            known[paths[fewer]] = counted[fewer]
            known[paths[other]] = known[paths[node]] - counted[fewer]


def describe_split(frame: DataFrame, model: LeafwiseModel, target: str = "quantity") -> DataFrame:
    """(feature, threshold, share, left_rows, left_mean, right_mean) of the first split of a model, one row; ``share``
    is the part of the sum of squares around the mean that it removes. None if the model does not split."""
    tree = model.trees[0] if model.trees else Tree()
    if tree.feature[0] < 0:
        return frame.limit(0).selectExpr("'' AS feature", "0D AS threshold", "0D AS share", "0L AS left_rows", "0D AS left_mean", "0D AS right_mean")
    name = model.features[tree.feature[0]]
    threshold = float(model.edges[tree.feature[0]][tree.bin[0]])
    y, left = F.col(target).cast("double"), F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) <= threshold
    row = frame.where(y.isNotNull()).agg(
        F.count_if(left).alias("left_rows"), F.avg(F.when(left, y)).alias("left_mean"), F.avg(F.when(~left, y)).alias("right_mean"),
        F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_n"), (F.var_pop(y) * F.count(F.lit(1))).alias("_squares"),
    )
    between = F.col("left_rows") * F.pow(F.col("left_mean") - F.col("_mean"), 2)
    between += (F.col("_n") - F.col("left_rows")) * F.pow(F.col("right_mean") - F.col("_mean"), 2)
    return row.select(
        F.lit(name).alias("feature"), F.lit(threshold).alias("threshold"), F.try_divide(between, "_squares").alias("share"),
        "left_rows", "left_mean", "right_mean",
    )


# -- boosting --------------------------------------------------------------------------------


def fit_leafwise(
    frame: DataFrame, features: Sequence[str], target: str = "quantity", settings: Settings = Settings(),
    validation: str | None = None, prediction: str = "prediction",
) -> LeafwiseModel:
    """Boosting of squared errors from the mean of the target.

    With ``validation`` (a boolean column) its rows are not learned from; boosting stops when their mean absolute error
    has not fallen for ``early_stopping_rounds`` trees, and the trees up to the best one are kept.
    """
    if settings.max_bin > 256:
        raise ValueError("at most 256 bins fit into a byte")
    width = len(features)
    learn = frame.where(~F.coalesce(F.col(validation), F.lit(False))) if validation else frame
    edges = bin_edges(learn, features, settings.max_bin)
    bins = max([len(e) + 1 for e in edges], default=1)
    base = float(learn.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0)
    blocks = _kept(binned_table(frame, features, target, edges, validation, base))
    draw = np.random.default_rng(settings.seed)
    trees: list[Tree] = []
    written, best, best_error = 0, 0, np.inf
    for number in range(settings.n_estimators):
        picked = max(1, round(settings.colsample_bytree * width))
        allowed = np.zeros(width, bool)
        allowed[draw.permutation(width)[:picked]] = True
        pending = trees[written:]

        def count(tree, nodes, blocks=blocks, pending=pending, number=number):
            return histograms(blocks, width, bins, pending, tree, nodes, settings.seed + number, settings.subsample)

        tree = grow(count, settings, allowed)
        trees.append(tree)
        if len(tree.feature) == 1 and settings.subsample >= 1 and settings.colsample_bytree >= 1:
            break  # no split helps, nor will the next tree find one
        if validation:
            error = _error(blocks, width, trees[written:])
            if error < best_error:
                best, best_error = len(trees), error
            elif len(trees) - best >= settings.early_stopping_rounds:
                break
        if len(trees) - written >= PENDING:
            before, blocks, written = blocks, _rescored(frame.sparkSession, blocks, width, trees[written:]), len(trees)
            before.unpersist()
    blocks.unpersist()
    kept = trees[:best] if validation and best else trees
    return LeafwiseModel(features, edges, base, kept, prediction)


def _rescored(spark: SparkSession, blocks: RDD, width: int, pending: Sequence[Tree]) -> RDD:
    def run(part):
        for batch in _opened(part):
            yield (_block(batch.set_column(3, "score", pa.array(_rows(batch, width, pending)[3]))),)

    return _kept(materialize(spark.createDataFrame(blocks.mapPartitions(run), TABLE), "binned"))


def _error(blocks: RDD, width: int, pending: Sequence[Tree]) -> float:
    """Mean absolute error of the rows held out."""
    def run(part):
        total = np.zeros(2)
        for batch in _opened(part):
            bins, y, _, score, held = _columns(batch, width)
            total += (held.sum(), np.abs(_applied(score[held], bins[held], pending) - y[held]).sum())
        yield total

    rows, error = blocks.mapPartitions(run).fold(np.zeros(2), lambda a, b: a + b)
    return error / rows if rows else np.inf
