"""Near-duplicates by SimHash, linked through a self-join of binary tries.

A fingerprint bit is the majority over the hashes of a text's word shingles. Fingerprints link if they differ in
at most ``max_bits`` bits. The distinct fingerprints form a binary trie by their bits; pairs of its nodes are
walked together, the bits in which their paths differ add up, and a pair is dropped as soon as the sum exceeds the
budget.

There is one trie for each of ``max_bits + 1`` rotations of the bits. Fingerprints within the budget agree in the
leading segment of at least one rotation, so each walk starts from the nodes below equal leading segments, and these
nodes are what is dealt to tasks: a fingerprint goes to one task per rotation, however many there are. Segments with
many fingerprints are split into blocks of rows, and pairs of blocks are walked. A task walks level by level in
arrays and returns a spanning forest of its links.

Exact copies are one fingerprint and never meet as pairs. Null and empty texts have fingerprint zero and link
like any other; a null ``doc_id`` gets the component of its fingerprint but never names one (null if no other
row does); repeated rows are one text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import arrow_map, materialize, ship_package, text_blocks, text_or_empty
from weekcast.llm.components import Forest, connected

SHINGLE, SEED, BITS, MAX_BITS = 3, 42, 64, 3
# Fingerprints that a task is dealt, and number in one segment beyond which it is split into blocks.
TASK_ROWS, BLOCK_ROWS = 8192, 8192
# Sizes inside a task: pairs of nodes walked at once, and the product of node sizes that is compared directly.
FRONTIER, LEAF = 1_000_000, 8
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, most significant bit first. Only A-Z are lower-cased; words end at ASCII white space."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return bytes(BITS // 8)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    hashes = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), _CHUNK):
        ones += np.unpackbits(rows[at : at + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, texts in text_blocks(batches, "text"):
            prints = np.frombuffer(b"".join(map(fingerprint, texts)), ">i8").astype(np.int64)
            yield [batch.column(0), pa.array(prints, pa.int64())]

    rows = df.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    return arrow_map(rows, run, f"id {kind}, fp bigint").withColumnRenamed("id", doc_id)


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# -- the walk inside a task ------------------------------------------------------------------


def _expand(alo, ahi, blo, bhi):
    """All (i, j) of pairs of ranges, in arrays."""
    wide = bhi - blo
    counts = (ahi - alo) * wide
    which = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return alo[which] + nth // wide[which], blo[which] + nth % wide[which], which


def runs_of(sorted_values: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs with equal ``lead`` leading bits."""
    heads = sorted_values >> np.uint64(BITS - lead)
    cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(heads)]])


def _blocks(a, b, alo, ahi, blo, bhi, budget):
    """Yield (i, j, which) of pairs of ranges, one after the other; of equal values there may be many, so in steps."""
    for n, (lo, hi, lo2, hi2) in enumerate(zip(*(x.tolist() for x in (alo, ahi, blo, bhi)), strict=True)):
        step = max(1, FRONTIER // (hi2 - lo2))
        for at in range(lo, hi, step):
            i, j = np.nonzero(np.bitwise_count(a[at : min(at + step, hi), None] ^ b[None, lo2:hi2]) <= budget)
            if len(i):
                yield i + at, j + lo2, n


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, budget: int, lead: int = 0, leaf: int = LEAF):
    """Yield (i, j) arrays of positions with equal ``lead`` leading bits and at most ``budget`` differing ones,
    walking the tries of the sorted arrays together. ``same``: a is b, and a pair is found once.

    If a is not b, all values must have the same leading bits. Pairs of nodes whose sizes multiply to ``leaf`` or less
    are compared directly: all such pairs in one array, or with a wider ``leaf`` than usual one pair of nodes after the other.
    """
    if not len(a) or not len(b):
        return
    if same:
        low, high = runs_of(a, lead) if lead else (np.array([0]), np.array([len(a)]))
        start = [low, high, low, high, np.zeros(len(low), np.int64)]
    else:
        start = [np.array([x]) for x in (0, len(a), 0, len(b), 0)]
    first_bit = BITS - 1 - lead
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(bit):
        if bit not in ones:
            ones[bit] = tuple(
                np.concatenate([[0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]) for x in (a, b)
            )
        return ones[bit]

    stack = [(first_bit, start)]
    while stack:
        bit, nodes = stack.pop()
        alo, ahi, blo, bhi, diff = nodes
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (bit < 0)
        if leaf > LEAF:
            for i, j, n in _blocks(a, b, *(x[small] for x in (alo, ahi, blo, bhi)), budget):
                if same and alo[small][n] == blo[small][n]:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
            alo, ahi, blo, bhi, diff = (x[~small] for x in nodes)
        elif small.any():
            i, j, which = _expand(alo[small], ahi[small], blo[small], bhi[small])
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                twin = (alo[small] == blo[small])[which]
                near &= ~twin | (i < j)
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, diff = (x[~small] for x in nodes)
        if not len(alo):
            continue
        in_a, in_b = counts(bit)
        amid, bmid = ahi - (in_a[ahi] - in_a[alo]), bhi - (in_b[bhi] - in_b[blo])
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        sides = (
            (alo, amid, blo, bmid, diff, True),
            (amid, ahi, bmid, bhi, diff, True),
            (alo, amid, bmid, bhi, diff + 1, True),
            (amid, ahi, blo, bmid, diff + 1, ~twin),  # of a node with itself, the mirror of the case before
        )
        found = []
        for lo, hi, lo2, hi2, d, wanted in sides:
            keep = (hi > lo) & (hi2 > lo2) & (d <= budget) & wanted
            found.append([x[keep] for x in (lo, hi, lo2, hi2, d)])
        below = [np.concatenate(parts) for parts in zip(*found, strict=True)]
        for at in range(0, len(below[0]), FRONTIER):
            stack.append((bit - 1, [x[at : at + FRONTIER] for x in below]))


# -- links over all fingerprints -------------------------------------------------------------


def rotate(values: np.ndarray, by: int) -> np.ndarray:
    """Bits moved up by ``by`` places, the highest ones to the bottom."""
    by %= BITS
    return values << np.uint64(by) | values >> np.uint64(BITS - by) if by else values


def deal(prints: DataFrame, max_bits: int, split: str = "fp") -> DataFrame:
    """(turn, place, i, j, own) beside the columns of ``prints``: what is within ``max_bits`` meets in some group of
    turn, place, i and j. Crowded segments are split into blocks by the column ``split``."""
    ship_package(prints.sparkSession)
    lead = BITS // (max_bits + 1)
    tasks = max(1, math.ceil(prints.count() * (max_bits + 1) / TASK_ROWS))

    def segment(turn: int):
        return F.shiftrightunsigned("fp", BITS - lead * (turn + 1)).bitwiseAND(F.lit((1 << lead) - 1).cast("long"))

    turns = [F.struct(F.lit(t).alias("turn"), segment(t).alias("segment")) for t in range(max_bits + 1)]
    dealt = prints.select(*prints.columns, F.inline(F.array(*turns)))
    # At most (max_bits + 1) * 2 ** lead rows, of which only crowded segments stay.
    crowded = dealt.groupBy("turn", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
    crowded = materialize(
        crowded.select("turn", "segment", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "segments"
    )
    placed = dealt.join(crowded, ["turn", "segment"], "left")
    shared = F.pmod(F.xxhash64("segment"), F.lit(tasks))
    placed = placed.select(
        *prints.columns, "turn", "blocks",
        F.when(F.col("blocks").isNull(), shared).otherwise(F.col("segment") + tasks).alias("place"),
        F.coalesce(F.pmod(F.xxhash64(split), F.col("blocks")), F.lit(0)).cast("int").alias("own"),
    )
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    pairs = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return pairs.select("turn", "place", "i", "j", "own", *prints.columns)


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): links among distinct fingerprints (column ``fp``) that connect what is within ``max_bits``."""
    lead = BITS // (max_bits + 1)

    def walk(key, frame):
        turn, _, i, j = key
        values = rotate(frame["fp"].to_numpy().view(np.uint64), lead * turn)
        first = frame["own"].to_numpy() == i
        a = np.sort(values[first])
        b = a if i == j else np.sort(values[~first])
        points = a if i == j else np.concatenate([a, b])
        forest, shift = Forest(len(points)), 0 if i == j else len(a)
        for x, y in trie_links(a, b, i == j, max_bits, lead):
            forest.add(x, y + shift)
        linked = np.flatnonzero(forest.root != np.arange(len(points)))
        signed = rotate(points, BITS - lead * turn).view(np.int64)
        return pd.DataFrame({"fp": signed[linked], "root": signed[forest.root[linked]]})

    pairs = deal(prints.select("fp"), max_bits)
    return pairs.groupBy("turn", "place", "i", "j").applyInPandas(walk, "fp bigint, root bigint")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id reachable over links of fingerprints."""
    rows = materialize(fingerprints(df, doc_id, text), "prints")
    groups = materialize(rows.groupBy("fp").agg(F.min(doc_id).alias("least")), "prints")
    roots = connected(fingerprint_links(groups.select("fp"), max_bits), "fp", "root")
    rooted = groups.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    rooted = materialize(rooted, "roots")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    names = materialize(rooted.join(named, "root").select("fp", "component_id"), "roots")
    return rows.join(names, "fp").select(doc_id, "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stand for their component: those with its smallest id. Rows without an id stay
    where no row with an id shares their component."""
    found = near_duplicates(df, doc_id, text, max_bits)
    kept = found.where(F.col("component_id").isNull() | (F.col(doc_id) == F.col("component_id")))
    kept = kept.select(F.col(doc_id).alias("_kept")).distinct()
    return df.join(kept, df[doc_id].eqNullSafe(kept["_kept"]), "left_semi")
