"""Periodic runs of words: seeds from repeated k-grams, extended along diagonals.

A run is a stretch of words with smallest period q, at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods long,
that no neighbouring word extends. Along the diagonal of lag q such a run matches itself over
max(LEAST_WORDS, LEAST_PERIODS * q) - q words at least, so every lag of an octave [2^t, 2^(t+1)) is found from
k-grams of that least overlap for 2^t. As k exceeds the lag, two occurrences of a k-gram inside a run are next to each
other exactly when they are one smallest period apart: only neighbouring occurrences in the same document are paired,
at most one pair per word and octave, and never all pairs. A pair is a seed on its diagonal; it is extended in both
directions unless the table of the furthest position covered per lag says that it lies on a diagonal already walked.

K-grams are named exactly, by ranks of pairs of shorter ones (no hashes), and only places whose shorter k-grams
repeat in their document are looked at again. Everything of a document happens where its text is: no shuffle.

Null texts have no words, as have empty ones; a null id is kept, and without an id no tail is repeated; repeated rows
are rows of their own; texts of any length are taken whole; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weekcast.llm.common import arrow_map, text_blocks, text_or_empty

LEAST_WORDS, LEAST_PERIODS = 6, 4
# First step of an extension, doubled as long as words agree.
STRIDE = 64


def least_overlap(period: int) -> int:
    """Words that a run of this period has in common with itself, moved by one period."""
    return max(LEAST_WORDS, LEAST_PERIODS * period) - period


def _repeated(names: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For places ``at`` with these names: the rank of the name where it occurs again, -1 elsewhere."""
    ranks = np.full(size, -1, dtype=np.int64)
    if len(at):
        _, rank, times = np.unique(names, return_inverse=True, return_counts=True)
        again = times[rank] > 1
        ranks[at[again]] = rank[again]
    return ranks


def _joined(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the grams made of the one at a place and the one ``step`` places later."""
    at = np.flatnonzero(left[: len(left) - step] >= 0)
    at = at[right[at + step] >= 0]
    return _repeated(left[at] * (right.max(initial=0) + 1) + right[at + step], at, len(left))


def _agree(words: np.ndarray, left: int, right: int, way: int) -> int:
    """How many words agree from two places on, forwards (1) or backwards (-1)."""
    total, stride = 0, STRIDE
    while True:
        room = len(words) - max(left, right) if way > 0 else min(left, right) + 1
        n = min(stride, room)
        if n <= 0:
            return total
        if way > 0:
            differ = np.flatnonzero(words[left : left + n] != words[right : right + n])
        else:
            differ = np.flatnonzero(words[left - n + 1 : left + 1] != words[right - n + 1 : right + 1])[::-1]
            differ = n - 1 - differ
        if len(differ):
            return total + int(differ[0])
        total, left, right, stride = total + n, left + way * n, right + way * n, stride * 2


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word numbers.

    Documents may be laid one after the other if they share no number and a number of its own stands between them.
    """
    size = len(words)
    everywhere = np.arange(size)
    single = _repeated(words, everywhere, size)
    double = _joined(single, single, 1) if size > 1 else single
    # ranks[s] are those of grams of 2^s words.
    ranks = [single, double]
    found, covered, octave = [], {}, 0
    while True:
        low = 1 << octave
        k = least_overlap(low)
        if k > size:
            return found
        whole = k.bit_length() - 1
        while len(ranks) <= whole:
            ranks.append(_joined(ranks[-1], ranks[-1], 1 << (len(ranks) - 1)))
        rest = k - (1 << whole)
        grams = ranks[whole]
        if rest:  # a sum of two powers, or any k through overlapping powers
            part = rest.bit_length() - 1
            step = k - (1 << part) if rest == 1 << part else k - (1 << whole)
            grams = _joined(grams, ranks[part] if rest == 1 << part else ranks[whole], step)
        at = np.flatnonzero(grams >= 0)
        if not len(at):
            return found
        at = at[np.argsort(grams[at], kind="stable")]
        lag = np.diff(at)
        seeds = (np.diff(grams[at]) == 0) & (lag >= low) & (lag < 2 * low)
        first, lag = at[:-1][seeds], lag[seeds]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        cuts = np.flatnonzero(np.diff(lag)) + 1
        for seeds_of_lag in np.split(np.arange(len(lag)), cuts) if len(lag) else []:
            period, starts = int(lag[seeds_of_lag[0]]), first[seeds_of_lag]
            n = 0
            while n < len(starts):
                seed = int(starts[n])
                start = seed - _agree(words, seed - 1, seed - 1 + period, -1)
                end = seed + period + _agree(words, seed, seed + period, 1)
                covered[period] = end - period  # no seed before this place is on another diagonal of the lag
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    found.append((start, end - start, period))
                n = int(np.searchsorted(starts, covered[period]))
        octave += 1


def _tail(n: int, salt: int | None) -> np.ndarray | None:
    """Word numbers of a text of n words whose tail is replaced by repetitions, for one salt in ten."""
    if salt is None or salt % 10 or not n:
        return None
    g = salt // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    at = np.arange(n)
    at[start:] = start + (at[start:] - start) % period
    return at


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _block(texts: list[bytes], salts: list[int | None]):
    """Per text: its words as they count, and its runs."""
    texts = [text.split() for text in texts]  # of bytes: exactly the ASCII white space
    for i, (words, salt) in enumerate(zip(texts, salts, strict=True)):
        at = _tail(len(words), salt)
        if at is not None:
            texts[i] = [words[j] for j in at]
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) + 1 for words in texts])
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    codes = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for words in texts for w in (*words, b" ")), np.int64, total
    )
    # A number of its own for every word of every document; blanks between documents fall under that as well.
    find = find_runs(codes + np.repeat(np.arange(len(texts)), sizes) * len(numbers))
    starts = ends - sizes
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in sorted((s, n, q) for s, n, q in find):
        doc = int(np.searchsorted(ends, start, side="right"))
        runs[doc].append((start - int(starts[doc]), length, period))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return texts, runs


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salt: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``df``.

    ``runs`` is an array of (start, length, period) by start and period, in words from 0. ``collapsed`` is the text
    without the words that a run repeats, joined by single spaces. ``salt``, for tests with runs that are known:
    where it is a multiple of ten, the text's tail is first replaced by repetitions of some of its words.
    """
    id_type = df.schema[doc_id].dataType
    rows = df.select(
        F.col(f"`{doc_id}`").alias("id"),
        (F.lit(None) if salt is None else salt).cast("long").alias("salt"),
        text_or_empty(f"`{text}`").cast("binary").alias("text"),
    )
    schema = (
        StructType().add("id", id_type)
        .add("n_words", "long")
        .add("runs", StructType.fromDDL("r array<struct<start:bigint,length:bigint,period:bigint>>")["r"].dataType)
        .add("collapsed", "binary")
    )

    def run(batches):
        for batch, texts in text_blocks(batches, "text"):
            words, runs = _block(texts, batch.column(1).to_pylist())
            flat = np.array([r for found in runs for r in found], dtype=np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(found) for found in runs])])
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            yield [
                batch.column(0),
                pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
                pa.array([_collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()),
            ]

    found = arrow_map(rows, run, schema)
    return found.select(F.col("id").alias(doc_id), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def run_digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The longest run and digests of all runs and of the collapsed text, per row of ``periodic_runs``."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    shown = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    best = found.withColumn("_best", F.array_max(order))
    length, start, period = (F.col(f"_best.{x}") for x in "nsq")
    return best.select(
        doc_id,
        F.size("runs").cast("long").alias("n_runs"),
        (-start).alias("start"),
        length.alias("length"),
        (-period).alias("period"),
        F.floor(length * 1000 / -period).cast("long").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
