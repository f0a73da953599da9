"""Near-duplicate vectors by a subspace pigeonhole join, within labels.

Unit vectors with cosine c are at squared distance 2 - 2c. The vectors are turned by a fixed random rotation and
their coordinates cut into blocks: if the whole squared distance is within the budget, at least one block is within
its proportional share. For each block the vectors are range-joined: their first coordinates in the block fall
into cells as wide as the block's radius, so partners are in the same or an adjacent cell. Each vector is at home
in its cell and a visitor in half of the adjacent ones, so a pair meets once per block. Of the pairs within the
block's share, each is verified exactly in the first block that finds it, by its cosine in double precision.

Equal vectors of a label are joined once, with their number. Cells with many vectors are split into blocks of rows,
and pairs of blocks are joined. Tasks return numbers of links and a spanning forest, never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or a null
``vec_id`` link with nothing (n_links 0, their own component, kept). Only vectors of equal length are compared.
Repeated rows are vectors of their own and link with each other; ``vec_id`` names them all. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import arrow_map, materialize, ship_package
from weekcast.llm.components import Forest, connected

COSINE = 0.98
BLOCKS = 4
CELL_AXES = 2
ROTATION_SEED = 11
CELL_ROWS = 4096
SLACK = 1e-9
_A_ROWS, _PAIRS = 1024, 100_000


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def block_budgets(dim: int, cosine: float, blocks: int = BLOCKS) -> list[float]:
    """Shares of the squared distance in proportion to the widths, with a little room for rounding."""
    whole = 2.0 - 2.0 * cosine + SLACK
    return [whole * (b - a) / dim + SLACK for a, b in block_bounds(dim, blocks)]


def rotated(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return unit @ rotation(vectors.shape[1])


def cells_of(vectors: np.ndarray, cosine: float):
    """Yield (block, cells, home) per block and cell offset: ``cells`` are rows of cell numbers."""
    turned = rotated(vectors)
    dim = vectors.shape[1]
    for block, ((a, b), share) in enumerate(zip(block_bounds(dim), block_budgets(dim, cosine), strict=True)):
        axes = min(CELL_AXES, b - a)
        width = math.sqrt(share) * (1 + 1e-9)
        cells = np.floor(turned[:, a : a + axes] / width).astype(np.int64)
        nothing = (0,) * axes
        for offset in itertools.product((-1, 0, 1), repeat=axes):
            if offset >= nothing:
                yield block, cells + np.array(offset), offset == nothing


def usable(vector: str = "embedding"):
    """Whether a vector can be compared: not null, empty or zero, with finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & good & F.exists(vector, lambda x: x != 0)


def component_type(groups: DataFrame) -> str:
    """How components travel: as they are stored, so nothing is lost and nothing added."""
    return "<f4" if groups.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"


def _emit(groups: DataFrame, cosine: float, payload: bool) -> DataFrame:
    """Rows of every vector's cells; with ``payload`` also the vector as bytes."""
    kind = groups.schema["label"].dataType.simpleString()
    stored = component_type(groups)

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            frame["dim"] = [len(v) for v in frame["vector"]]
            for dim, part in frame.groupby("dim"):
                vectors = np.array(part["vector"].tolist(), dtype=np.float64)
                raw = [v.tobytes() for v in vectors.astype(stored)] if payload else None
                labels = pa.array(part["label"].to_numpy(), batch.schema.field("label").type)
                for block, cells, home in cells_of(vectors, cosine):
                    n = len(part)
                    columns = [
                        labels, pa.array([dim] * n, pa.int32()), pa.array([block] * n, pa.int32()),
                        pa.array([",".join(map(str, c)) for c in cells.tolist()], pa.string()),
                    ]
                    if payload:
                        columns += [
                            pa.array([home] * n), pa.array(part["rep"].to_numpy(), pa.int64()),
                            pa.array(part["copies"].to_numpy(), pa.int64()), pa.array(raw, pa.binary()),
                        ]
                    yield columns

    schema = f"label {kind}, dim int, block int, cell string"
    more = ", home boolean, rep bigint, copies bigint, vector binary"
    return arrow_map(groups.select("label", "vector", "rep", "copies"), run, schema + more * payload)


def _compare(
    a: int, b: int, same: bool, frame: pd.DataFrame, block: int, cosine: float, stored: str
) -> pd.DataFrame:
    """Links between the rows of blocks ``a`` and ``b`` of a cell: (rep, root, links) of each linked row."""
    vectors = np.frombuffer(b"".join(frame["vector"]), stored).astype(np.float64).reshape(len(frame), -1)
    dim = vectors.shape[1]
    bounds, shares = block_bounds(dim), block_budgets(dim, cosine)
    turned, norms = rotated(vectors), np.sqrt((vectors * vectors).sum(axis=1))
    home, part = frame["home"].to_numpy(), frame["part"].to_numpy()
    copies = frame["copies"].to_numpy()
    left = np.flatnonzero(part == a)
    right = left if same else np.flatnonzero(part == b)
    low, high = bounds[block]
    inside = turned[:, low:high]
    squares = (inside * inside).sum(axis=1)
    links, forest = np.zeros(len(frame), np.int64), Forest(len(frame))
    for at in range(0, len(left), _A_ROWS):
        some = left[at : at + _A_ROWS]
        distance = squares[some][:, None] + squares[right][None, :] - 2 * (inside[some] @ inside[right].T)
        near = distance <= shares[block] + SLACK
        near &= home[some][:, None] | home[right][None, :]
        i, j = np.nonzero(near)
        i, j = some[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), _PAIRS):
            x, y = i[k : k + _PAIRS], j[k : k + _PAIRS]
            gaps = (turned[x] - turned[y]) ** 2
            found = np.stack([gaps[:, s:e].sum(axis=1) for s, e in bounds[: block + 1]], axis=1) <= shares[: block + 1]
            first = found[:, block] & ~found[:, :block].any(axis=1)
            x, y = x[first], y[first]
            close = (vectors[x] * vectors[y]).sum(axis=1) / (norms[x] * norms[y]) >= cosine
            x, y = x[close], y[close]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            forest.add(x, y)
    linked = np.flatnonzero(links)
    rep = frame["rep"].to_numpy()
    return pd.DataFrame({"rep": rep[linked], "root": rep[forest.root[linked]], "links": links[linked]})


def vector_links(groups: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep, root, links): links of distinct vectors (label, vector, rep, copies), in parts to be summed."""
    ship_package(groups.sparkSession)
    place = ["label", "dim", "block", "cell"]
    crowded = _emit(groups, cosine, payload=False).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    crowded = crowded.where(F.col("n") > CELL_ROWS)
    crowded = materialize(crowded.select(*place, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")), "cells")
    rows = _emit(groups, cosine, payload=True).join(crowded, place, "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    stored = component_type(groups)

    def compare(key, frame):
        block, i, j = key[2], key[4], key[5]
        return _compare(i, j, i == j, frame, block, cosine, stored)

    kept = rows.select(*place, "i", "j", "home", "rep", "copies", "vector", "part")
    return kept.groupBy(*place, "i", "j").applyInPandas(compare, "rep bigint, root bigint, links bigint")


def near_duplicate_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    groups = materialize(
        rows.where(takes_part).groupBy("label", "vector")
        .agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    found = materialize(vector_links(groups, cosine), "links")
    stars = connected(found, "rep", "root").withColumnRenamed("id", "rep")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        groups.join(sums, "rep", "left").join(stars, "rep", "left")
        .select(
            "label", "vector", F.lit(True).alias("linked"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    known = materialize(known, "vectors")
    marked = rows.withColumn("label", F.when(takes_part, F.col("label")))
    out = marked.join(known, ["label", "vector"], "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def sql(embeddings: str = "embeddings") -> str:
    """The same in SQL, comparing all pairs of a label."""
    return f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {embeddings}
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e)
           / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}),
    reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
    c AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
           vec_id = coalesce(component_id, vec_id) AS kept
    FROM {embeddings} AS e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """
