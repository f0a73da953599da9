"""Exact search for the largest inner products with one KD-tree per shard.

Vectors become integers, floor(scale * x). They are dealt into shards by a hash of the id; each shard's tree is
built by median splits of the widest side, with a tight bounding box at every node. A query walks a tree best
first: the bound of a box, the largest inner product that any point in it can have, orders the nodes, and the walk
ends when the best bound is below the k-th score so far. Every query first searches one shard; the k-th score found
there goes along to all other shards, where only points that reach it are returned.

Queries meet shards in blocks, so a task holds one tree and a bounded number of queries.

Scores are exact whatever the size of the components: where sums of products could pass 2^53, a tree's points are
scored in whole numbers instead of doubles, and its bounds are widened by their rounding. Components beyond 64 bits
after scaling count as the nearest number of 64 bits, and so do scores.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id. Only
vectors of equal length are compared. Of rows with one id the smallest vector counts. Ties go to smaller ids. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import materialize, ship_package

K, SCALE, EVERY = 20, 64, 20
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 4096, 128, 1024
EXACT, LONGEST = 1 << 53, (1 << 63) - 1  # whole numbers that doubles hold, and that the result holds


def scaled(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def points(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim): the integer vectors that take part, one per id."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite & (F.size(vector) > 0))
    rows = rows.select(F.col(vec_id).alias("vec_id"), scaled(vector, scale).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim"))


class KdTree:
    """Arrays of one shard: rows in leaf order, and per node its range, box and first child."""

    def __init__(self, ids, rows, start, end, child, low, high):
        self.ids, self.rows, self.start, self.end, self.child, self.low, self.high = (
            ids, rows, start, end, child, low, high
        )
        self.largest = max(abs(int(self.low[0].min())), abs(int(self.high[0].max()))) if len(ids) else 0
        self.floats = rows.astype(np.float64)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> KdTree:
        order = np.argsort(ids)
        start, end, child, low, high = [0], [len(ids)], [-1], [None], [None]
        node = 0
        while node < len(start):
            mine = order[start[node] : end[node]]
            low[node], high[node] = rows[mine].min(axis=0), rows[mine].max(axis=0)
            side = high[node] - low[node]
            axis = int(np.argmax(side))
            if len(mine) > leaf and side[axis] > 0:
                middle = len(mine) // 2
                order[start[node] : end[node]] = mine[np.argpartition(rows[mine, axis], middle)]
                child[node] = len(start)
                start += [start[node], start[node] + middle]
                end += [start[node] + middle, end[node]]
                child += [-1, -1]
                low += [None, None]
                high += [None, None]
            node += 1
        number = [np.array(x, dtype=np.int64) for x in (start, end, child)]
        return cls(ids[order], rows[order], *number, np.array(low), np.array(high))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = self.largest < 1 << 31
        np.savez(out, ids=self.ids, rows=self.rows.astype(np.int32) if small else self.rows, start=self.start, end=self.end,
                 child=self.child, low=self.low, high=self.high)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> KdTree:
        with np.load(io.BytesIO(data), allow_pickle=False) as x:
            parts = {name: x[name] for name in x.files}
        return cls(**parts)

    def is_exact(self, queries: np.ndarray) -> bool:
        """Whether doubles hold every inner product with the queries, and all sums on the way."""
        largest = max(abs(int(queries.min())), abs(int(queries.max())))
        return queries.shape[-1] * self.largest * largest < EXACT

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product possible in each box (columns) for each query (rows), or a little more."""
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        high, low = self.high.T.astype(np.float64), self.low.T.astype(np.float64)
        bound = up @ high + down @ low
        if self.is_exact(queries):
            return bound
        rounding = (up @ np.abs(high) - down @ np.abs(low)) * (4 * queries.shape[1] * np.finfo(float).eps)
        return np.maximum(bound + rounding, -float(1 << 63))

    def scores(self, inside: slice, query: np.ndarray, exact: bool):
        """Inner products of the points of a leaf, in doubles or in whole numbers of any size."""
        if exact:
            return self.floats[inside] @ query
        return np.clip(self.rows[inside].astype(object) @ query.astype(object), -LONGEST - 1, LONGEST)

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, floor: float):
        """(scores, ids) of at most ``k`` points with the largest scores of at least ``floor``."""
        best: list[tuple] = []  # heap of (score, -id): the worst of the k best on top
        exact = self.is_exact(query)
        query = query.astype(np.float64) if exact else query
        kth = floor
        nodes = [(-bound[0], 0)]
        while nodes:
            top, node = heapq.heappop(nodes)
            if -top < kth:
                break
            first = self.child[node]
            if first >= 0:
                for c in (first, first + 1):
                    if bound[c] >= kth:
                        heapq.heappush(nodes, (-bound[c], int(c)))
                continue
            inside = slice(self.start[node], self.end[node])
            scores = self.scores(inside, query, exact)
            for at in np.flatnonzero(scores >= kth):
                name = int(self.ids[inside][at])
                if name == own:
                    continue
                item = (int(scores[at]), -name)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(floor, best[0][0])
        return best


def build_trees(rows: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, tree): one tree per shard, in a table."""
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")

    def build(key, frame):
        tree = KdTree.build(frame["vec_id"].to_numpy(np.int64), np.array(frame["v"].tolist(), dtype=np.int64))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [tree.to_bytes()]})

    grouped = rows.select("dim", shard, "vec_id", "v").groupBy("dim", "shard")
    return materialize(grouped.applyInPandas(build, "dim int, shard int, tree binary"), "trees")


def search(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): in each shard that a query names, its best points from ``floor`` up.

    ``queries``: (dim, shard, part, query_id, q, floor). The tree of a shard is repeated for each part.
    """
    parts = queries.select("dim", "shard", "part").distinct().toDF("dim", "shard", "part")
    placed = trees.join(parts, ["dim", "shard"])

    def walk(key, tree_frame, frame):
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        if not len(tree_frame) or not len(frame):
            return empty
        tree = KdTree.from_bytes(tree_frame["tree"].iloc[0])
        vectors = np.array(frame["q"].tolist(), dtype=np.int64)
        bounds = tree.bounds(vectors)
        names, ids, scores = [], [], []
        for own, q, bound, floor in zip(frame["query_id"], vectors, bounds, frame["floor"], strict=True):
            low = -np.inf if np.isnan(floor) else floor if abs(floor) < EXACT else np.nextafter(floor, -np.inf)
            for score, name in tree.search(own, q, bound, k, low):
                names.append(own)
                ids.append(-name)
                scores.append(score)
        return pd.DataFrame({"query_id": names, "vec_id": ids, "score": scores}, dtype=np.int64)

    key = ["dim", "shard", "part"]
    return placed.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(
        walk, "query_id bigint, vec_id bigint, score bigint"
    )


def top_k(df: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, **columns: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest scores of every query among all other rows."""
    ship_package(df.sparkSession)
    rows = materialize(points(df, scale=scale, **columns), "points")
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    trees = build_trees(rows, shards)
    asked = rows.where(is_query).select("dim", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    home = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    spread = F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("int")
    first = asked.select("dim", home.alias("shard"), F.lit(0).alias("part"), "query_id", "q",
                         F.lit(None).cast("double").alias("floor"))
    seen = materialize(search(trees, first, k), "found")
    counted = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    floors = counted.where(F.col("n") >= k).select("query_id", F.col("least").alias("floor"))
    others = asked.join(floors, "query_id", "left").withColumn("home", home)
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    others = others.where("shard <> home").select("dim", "shard", spread.alias("part"), "query_id", "q", "floor")
    every = seen.unionByName(search(trees, others, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(embeddings: str = "embeddings") -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS e FROM {embeddings}
               WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
          FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {EVERY} = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
    """
