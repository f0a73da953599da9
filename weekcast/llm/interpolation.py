"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of n-grams of words, from the longest down to single words and at last a
constant for what was never seen: p_k = w * count / count of the context + (1 - w) * p_(k-1), with one weight w per
order and bucket of context frequencies (powers of two). The weights are learned by expectation-maximisation on counts
of deleted documents, a tenth of the training documents, against counts of the others; the final counts are of all
training documents. A document is scored from a start mark on, so that its first word has a context, to its end, which
is a token.

How it runs: tasks turn texts into chunks of some million tokens, words numbered by their frequency in the chunk, and
write them out. The distinct n-grams of a chunk (64-bit hashes, sorted and coded by differences) go once to the shard
of their leading bits, where the counts of all chunks are added up, and their totals go back to the chunk in the same
order. So a task sees one chunk or one shard, a frequent word pair is one entry per chunk wherever it occurs, and no
token is a row. A chunk meets a shard in one block; beyond some thousand chunks the blocks become short, and at worst
an entry costs what a row of its own would. The driver sees a few sums and, per order and bucket, a histogram of the
ratio of an estimate to the next lower one, in ``BINS`` bins per factor of two: all that the weight's likelihood
depends on.

Null and empty texts consist of their end alone; very long texts are chunks of their own; documents with a null id are
training documents; repeated rows count and are scored as often as they occur; without training documents every
token is unseen and has probability 1; an empty table gives an empty result; other columns are ignored, whatever their
names. Words are told apart by 64 bits of hash.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from weekcast.llm.common import arrow_map, materialize, ship_package, text_blocks, text_or_empty

ORDER = 2
DELETED_SHARE = 10
CHUNK_BYTES, DOC_BYTES = 8 << 20, 64
SHARD_KEYS = 1 << 20
BINS, ROUNDS = 64, 500
KEPT, DELETED, HELD_OUT = 0, 1, 2
# Stands for no word: words hold no white space.
END = b"\n"


# -- numbers as bytes ------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, len(planes) // np.dtype(kind).itemsize).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


# -- chunks ----------------------------------------------------------------------------------


class _Chunk:
    """Documents of one role, as they come."""

    def __init__(self):
        self.ids, self.sizes, self.codes, self.bytes = [], array("I"), array("I"), 0
        self.numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)

    def add(self, name, text: bytes) -> None:
        words = text.lower().split()  # of bytes: A-Z, and exactly the ASCII white space
        self.codes.extend(map(self.numbers.__getitem__, words))
        self.codes.append(self.numbers[END])
        self.sizes.append(len(words) + 1)
        self.ids.append(name)
        self.bytes += len(text) + DOC_BYTES

    def columns(self, id_type: pa.DataType, number: int, role: int):
        codes = np.frombuffer(self.codes, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(self.numbers)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        words = list(self.numbers)
        vocabulary = np.array([xxhash.xxh64_intdigest(words[i]) for i in order], dtype="<u8")
        return [
            pa.array([number], pa.int64()), pa.array([role], pa.int32()),
            pa.array([len(self.ids)], pa.int64()), pa.array([len(codes)], pa.int64()),
            pa.array([self.ids], pa.list_(id_type)),
            *(pa.array([x], pa.binary()) for x in (pack(np.frombuffer(self.sizes, np.uint32)), pack(vocabulary), pack(place[codes]))),
        ]


def chunked(df: DataFrame, role: Column, doc_id: str, text: str) -> DataFrame:
    """(chunk, role, docs, tokens, ids, sizes, words, codes): the documents of tasks by role, in blocks."""
    kind = df.schema[doc_id].dataType
    rows = df.select(
        F.col(f"`{doc_id}`").alias("id"), role.cast("int").alias("role"), text_or_empty(f"`{text}`").cast("binary").alias("text")
    )
    schema = StructType.fromDDL("chunk bigint, role int, docs bigint, tokens bigint")
    schema = schema.add("ids", ArrayType(kind)).add("sizes", "binary").add("words", "binary").add("codes", "binary")

    def run(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        opened: dict[int, _Chunk] = defaultdict(_Chunk)
        id_type = pa.int64()
        for batch, texts in text_blocks(batches, "text"):
            id_type = batch.schema.field(0).type
            for name, part, each in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                chunk = opened[part]
                chunk.add(name, each)
                if chunk.bytes >= CHUNK_BYTES:
                    yield opened.pop(part).columns(id_type, next(numbers), part)
        for part, chunk in opened.items():
            yield chunk.columns(id_type, next(numbers), part)

    return materialize(arrow_map(rows, run, schema), "chunks")


# -- n-grams ---------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order, the key of the n-gram that ends at each token; before a document stands its start mark."""
    keys = [words]
    for k in range(1, order):
        before = np.empty_like(words)
        before[1:] = keys[-1][:-1]
        before[starts] = xxhash.xxh64_intdigest(b"\n%d" % k)
        keys.append(_mixed(before * np.uint64(0x9E3779B97F4A7C15) + words))
    return keys


@dataclass
class _Tokens:
    """A chunk read back: distinct keys per order, and which of them each token has."""

    starts: np.ndarray
    sizes: np.ndarray
    keys: list[np.ndarray]
    place: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, row: dict, order: int) -> _Tokens:
        sizes = unpack(row["sizes"], "<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        words = unpack(row["words"], "<u8")[unpack(row["codes"], "<u4")]
        found = [np.unique(k, return_inverse=True, return_counts=True) for k in grams(words, starts, order)]
        return cls(starts, sizes, *(list(x) for x in zip(*found, strict=True)))

    def spread(self, totals: list[np.ndarray], docs: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per order (count, count of the context) of every token; none for single words."""
        each, out = [t[p].astype(np.float64) for t, p in zip(totals, self.place, strict=True)], []
        for k, count in enumerate(each):
            context = None
            if k:
                context = np.empty_like(count)
                context[1:] = each[k - 1][:-1]
                context[self.starts] = docs
            out.append((count, context))
        return out


def _shard_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard of sorted keys begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64((64 - bits) % 64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def counted(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(chunk, role, gram, shard, kept, trained, kept_types, types): totals of a chunk's keys of a shard, in their order.

    Rows without a chunk have the number of distinct keys with counts instead.
    """
    rows = chunks.select("chunk", "role", "sizes", "words", "codes")

    def list_keys(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = _Tokens.of(row, order)
                for k in range(order):
                    cuts = _shard_cuts(found.keys[k], bits)
                    used = np.flatnonzero(np.diff(cuts))
                    parts = [slice(cuts[s], cuts[s + 1]) for s in used]
                    yield [
                        pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()),
                        pa.array(np.full(len(used), row["chunk"]), pa.int64()), pa.array(np.full(len(used), row["role"]), pa.int32()),
                        pa.array([pack_sorted(found.keys[k][p]) for p in parts], pa.binary()),
                        pa.array([pack(found.counts[k][p].astype("<u4")) for p in parts], pa.binary()),
                    ]

    listed = arrow_map(rows, list_keys, "gram int, shard int, chunk bigint, role int, keys binary, counts binary")
    schema = StructType.fromDDL(
        "chunk bigint, role int, gram int, shard int, kept binary, trained binary, kept_types bigint, types bigint"
    )
    arrow_schema = to_arrow_schema(schema)

    def add_up(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        keys = [unpack_sorted(p["keys"]) for p in parts]
        counts = [unpack(p["counts"], "<u4") for p in parts]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        totals = np.zeros((2, len(distinct)), np.int64)
        for p, at, n in zip(parts, places, counts, strict=True):
            if p["role"] != HELD_OUT:
                totals[p["role"], at] += n  # a chunk lists a key once
        kept, trained = totals[KEPT], totals.sum(axis=0)
        first = parts[0]
        out = [{"gram": first["gram"], "shard": first["shard"], "kept_types": int((kept > 0).sum()), "types": int((trained > 0).sum())}]
        for p, at in zip(parts, places, strict=True):
            out.append({
                "chunk": p["chunk"], "role": p["role"], "gram": p["gram"], "shard": p["shard"],
                "trained": pack(trained[at].astype("<u8")), "kept": pack(kept[at].astype("<u8")) if p["role"] == DELETED else None,
            })
        return pa.Table.from_pylist(out, schema=arrow_schema)

    ship_package(chunks.sparkSession)
    return materialize(listed.groupBy("gram", "shard").applyInArrow(add_up, schema), "counts")


def with_totals(chunks: DataFrame, counts: DataFrame, order: int, column: str, function, schema: StructType) -> DataFrame:
    """``function(row, tokens, totals)`` for every chunk, with the totals of its keys per order."""
    arrow_schema = to_arrow_schema(schema)
    totals = counts.where(F.col("chunk").isNotNull()).select("chunk", "gram", "shard", F.col(column).alias("totals"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow_schema.empty_table()
        row = left.to_pylist()[0]
        parts = sorted(right.to_pylist(), key=lambda p: (p["gram"], p["shard"]))
        found = [np.concatenate([unpack(p["totals"], "<u8") for p in parts if p["gram"] == k]) for k in range(order)]
        return function(row, _Tokens.of(row, order), found)

    ship_package(chunks.sparkSession)
    return chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(meet, schema)


# -- the model -------------------------------------------------------------------------------


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one for each power of two."""
    return np.frexp(context)[1].astype(np.int64)


@dataclass
class Model:
    """Weights per order and bucket, and the sums that estimates refer to."""

    tokens: int
    types: int
    docs: int
    weights: list[dict[int, float]] = field(default_factory=list)

    def estimate(self, count: np.ndarray, context: np.ndarray | None) -> np.ndarray:
        """Maximum likelihood; 0 where the context was never seen."""
        below = np.full_like(count, self.tokens) if context is None else context
        return np.divide(count, below, out=np.zeros_like(count), where=below > 0)

    def probability(self, levels: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
        """Interpolated through as many orders as there are weights."""
        p = np.full(len(levels[0][0]), 1.0 / (self.types + 1))
        for (count, context), weights in zip(levels, self.weights, strict=False):
            at = np.ones(len(count), np.int64) if context is None else bucket(context)
            table = np.zeros(int(at.max(initial=0)) + 1)
            for b, w in weights.items():
                if b < len(table):
                    table[b] = w
            w = np.where(at > 0, table[at], 0.0) if self.tokens else 0.0
            p = w * self.estimate(count, context) + (1 - w) * p
        return p


def maximise(ratios: np.ndarray, times: np.ndarray) -> float:
    """The weight of an estimate that is ``ratios`` times the lower one, by expectation-maximisation. One even event
    is added, so that the weight stays between 0 and 1."""
    w, total = 0.5, times.sum() + 1.0
    for _ in range(ROUNDS):
        share = w * ratios / (w * ratios + 1 - w)
        new = float((times @ share + 0.5) / total)
        if abs(new - w) < 1e-9:
            return new
        w = new
    return w


def fit(chunks: DataFrame, counts: DataFrame, order: int) -> tuple[Model, Model]:
    """(model of all training documents, model of those kept from the deleted ones), with the same weights."""
    sums = {r["role"]: (r["docs"], r["tokens"]) for r in chunks.groupBy("role").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    docs, tokens = ([sums.get(role, (0, 0))[i] for role in (KEPT, DELETED)] for i in (0, 1))
    types = counts.where(F.col("chunk").isNull() & (F.col("gram") == 0)).agg(F.sum("types"), F.sum("kept_types")).first()
    final = Model(sum(tokens), types[0] or 0, sum(docs))
    kept = Model(tokens[KEPT], types[1] or 0, docs[KEPT])
    kept_docs = kept.docs

    schema = StructType.fromDDL("sizes binary, counts array<binary>")
    arrow_schema = to_arrow_schema(schema)

    def event(row, found, totals):
        counts = [pack(t[p].astype("<u8")) for t, p in zip(totals, found.place, strict=True)]
        return pa.Table.from_pylist([{"sizes": row["sizes"], "counts": counts}], schema=arrow_schema)

    deleted = chunks.where(F.col("role") == DELETED)
    mine = counts.where(F.col("role") == DELETED)
    events = materialize(with_totals(deleted, mine, order, "kept", event, schema), "events")
    for k in range(order):
        def ratios(batches, k=k, model=kept):
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = unpack(row["sizes"], "<u4").astype(np.int64)
                    each = [unpack(c, "<u8") for c in row["counts"]]
                    place = [np.arange(len(each[0]))] * order
                    levels = _Tokens(np.cumsum(sizes) - sizes, sizes, [], place, []).spread(each, kept_docs)
                    count, context = levels[k]
                    at = np.ones(len(count), np.int64) if context is None else bucket(context)
                    r = model.estimate(count, context) / model.probability(levels)
                    bins = np.where(r > 0, np.rint(np.log2(np.where(r > 0, r, 1.0)) * BINS), np.iinfo(np.int32).min)
                    pairs, times = np.unique(np.column_stack([at, bins.astype(np.int64)])[at > 0], axis=0, return_counts=True)
                    yield [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(times, pa.int64())]

        histogram = arrow_map(events, ratios, "bucket bigint, bin bigint, n bigint")
        histogram = histogram.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect()  # buckets times bins at most
        by_bucket = defaultdict(list)
        for b, at, n in histogram:
            by_bucket[b].append((0.0 if at == np.iinfo(np.int32).min else 2.0 ** (at / BINS), n))
        weights = {b: maximise(*np.array(rows, dtype=float).T) for b, rows in by_bucket.items()}
        # A frequency that deleted documents never met takes the weight of the next lower one, or else of the next.
        full = {}
        for b in range(1, 64):
            near = [x for x in weights if x <= b] or [x for x in weights]
            full[b] = weights[max(near) if min(near) <= b else min(near)] if near else 0.5
        for model in (final, kept):
            model.weights.append(full)
    return final, kept


def score_documents(
    df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    Documents where ``held_out`` is true teach nothing; where it is null they are training documents. ``score`` is the
    model's log10 probability of the text, ``base_score`` that of single words with one added to every count.
    """
    name = F.col(f"`{doc_id}`")
    deleted = F.pmod(F.xxhash64(name, F.lit("deleted")), F.lit(DELETED_SHARE)) == 0
    role = F.when(held_out, HELD_OUT).when(deleted, DELETED).otherwise(KEPT)
    chunks = chunked(df, role, doc_id, text)
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total) / SHARD_KEYS)))
    counts = counted(chunks, order, bits)
    model, _ = fit(chunks, counts, order)

    schema = StructType().add("id", df.schema[doc_id].dataType)
    schema = schema.add("role", "integer").add("n_tokens", "long").add("n_known", "long").add("base", "double").add("score", "double")
    arrow_schema = to_arrow_schema(schema)

    def score(row, found, totals):
        levels = found.spread(totals, model.docs)
        count = levels[0][0]
        base = np.log10((count + 1) / (model.tokens + model.types + 1))
        p = np.log10(model.probability(levels))
        n = len(found.sizes)
        parts = [np.add.reduceat(x, found.starts) for x in ((count > 0).astype(np.int64), base, p)]
        columns = [pa.array(row["ids"], arrow_schema.field(0).type), pa.array(np.full(n, row["role"]), pa.int32()),
                   pa.array(found.sizes), *map(pa.array, parts)]
        return pa.Table.from_arrays(columns, schema=arrow_schema)

    scored = with_totals(chunks, counts, order, "trained", score, schema)
    return scored.select(
        F.col("id").alias(doc_id), (F.col("role") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
