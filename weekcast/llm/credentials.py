"""Secret scan with linking of multipart credentials.

Base findings are matches of fixed patterns. Beside them there are weak candidates, which alone mean little: names
of accounts, long tokens, and endpoints. An interval join within a scope (a distance in one document) finds the
weak candidates near which a complementary part occurs, and only these are reported: an account or an endpoint
needs a secret, a long token needs an identifier. Base findings are parts as well (``access`` an identifier,
``assign`` and ``hex`` secrets).

The join goes by blocks of the scope's width: every part is summed up per block by its first start and last end,
and a candidate meets the blocks that its widened interval touches. In a block at an end of the interval those two
numbers tell exactly whether a part reaches into it, so no pairs of spans are formed and crowded documents cost no
more than their spans.

Positions are code points, ends exclusive. Null and empty texts have no spans. Rows with equal id and text share
their findings; a null id is an id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import materialize, text_or_empty


def either_case(words: str) -> str:
    """A pattern that takes ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if "a" <= c <= "z" else c for c in words)


@dataclass(frozen=True)
class Kind:
    """A pattern of spans. ``part`` is what a span contributes to a credential, ``wants`` what a weak candidate
    needs nearby. A match counts if its group ``value`` has at least ``least`` characters."""

    name: str
    pattern: str
    part: str
    wants: str | None = None
    value: int = 0
    least: int = 0


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
# Runs are written with their least length where that can't change which runs match.
KINDS = (
    Kind("assign", f"({either_case('password|passwd|secret|token|api_?key')}){_VALUE}([A-Za-z0-9+/_.=-]+)",
         "secret", value=2, least=6),
    Kind("access", "AKIA[A-Z0-9]{16,}", "identifier"),
    Kind("hex", "[0-9a-f]{24,}", "secret"),
    Kind("weak_id", f"({either_case('access_?key|key_?id|client_?id|user_?name|user|login|account')}){_VALUE}"
         "([A-Za-z0-9_.@-]+)", "identifier", "secret", value=2, least=3),
    Kind("weak_secret", "[A-Za-z0-9+/]{40,}", "secret", "identifier"),
    Kind("endpoint", "https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", "endpoint", "secret"),
)
BASE = tuple(k for k in KINDS if k.wants is None)
WEAK = tuple(k for k in KINDS if k.wants is not None)
SCOPE = 200
# Matches of a text that are placed together; a text of n matches takes n times this many steps, and (n / this)^2.
RUN_MATCHES = 128
SPAN = "struct<start:int,rank:int,end:int>"


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of the spans of a kind, in order: lengths of the pieces between matches give the positions."""
    pattern = F.lit(kind.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.value)) if kind.value else hits
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))),
        values,
        lambda s, v: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), (F.length(v) >= kind.least).alias("ok")),
    )
    rank = KINDS.index(kind)
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state, s):
        start = state["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + s["hit"]).alias("end"))
        found = F.when(s["ok"], F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct((start + s["hit"]).alias("at"), found.alias("found"))

    def place(state, run):
        placed = F.struct(state["at"].alias("before"), run["found"].alias("found"))
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["runs"], F.array(placed)).alias("runs"))

    def moved(run):
        return F.transform(run["found"], lambda s: F.struct(
            (s["start"] + run["before"]).alias("start"), s["rank"].alias("rank"), (s["end"] + run["before"]).alias("end")
        ))

    # An array that grows is copied at every step, so positions are counted from the start of runs of matches, and the
    # runs are moved to their places afterwards.
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def run(every, i):
        return F.aggregate(F.slice(every, i * RUN_MATCHES + 1, F.lit(RUN_MATCHES)), start, step)

    def in_runs(every):
        last = F.ceil(F.size(every) / F.lit(RUN_MATCHES)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: run(every, i))

    # As the argument of a function, the array of matches is computed once, not for every run.
    runs = F.get(F.transform(F.array(steps), in_runs), F.lit(0))
    nothing = F.array().cast(f"array<struct<before:int,found:array<{SPAN}>>>")
    placed = F.aggregate(runs, F.struct(F.lit(0).alias("at"), nothing.alias("runs")), place, lambda s: s["runs"])
    return (
        F.when(~text.rlike(kind.pattern), empty)
        .when(F.size(hits) <= RUN_MATCHES, F.aggregate(steps, start, step, lambda s: s["found"]))
        .otherwise(F.flatten(F.transform(placed, moved)))
    )


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, base, weak): spans of every row of ``df``. The key is the id and a hash of the text."""
    rows = df.select(F.col(doc_id).alias("_doc"), text_or_empty(text).alias("_text"))
    return rows.select(
        F.struct("_doc", F.xxhash64("_text").alias("hash")).alias("_key"),
        F.array_sort(F.concat(*[spans_of(F.col("_text"), k) for k in BASE])).alias("base"),
        F.concat(*[spans_of(F.col("_text"), k) for k in WEAK]).alias("weak"),
    )


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_key, found): weak candidates with a complementary part at most ``scope`` characters away."""
    def by_rank(values):
        pairs = [x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(values(k)))]
        return F.create_map(*pairs)

    some = scanned.where(F.size("weak") > 0)
    parts = some.select("_key", F.explode(F.concat("base", "weak")).alias("s")).select(
        "_key",
        by_rank(lambda k: k.part)[F.col("s.rank")].alias("part"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
    )

    def blocks(low, high):
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("block")

    summed = (
        parts.select("*", blocks(F.col("start"), F.col("end")))
        .groupBy("_key", "part", "block")
        .agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    weak = some.select("_key", F.explode("weak").alias("s")).distinct()
    low, high = F.col("s.start") - scope, F.col("s.end") + scope
    wanted = weak.select(
        "_key", "s", by_rank(lambda k: k.wants or "")[F.col("s.rank")].alias("part"),
        low.alias("low"), high.alias("high"), blocks(low, high),
    )
    near = wanted.join(summed, ["_key", "part", "block"]).where(
        (F.col("last") >= F.col("low")) & (F.col("first") <= F.col("high"))
    )
    return near.select("_key", "s").distinct().groupBy("_key").agg(F.collect_list("s").alias("found"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by the order of the kinds."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (start, rank of the kind, end), ordered."""
    scanned = materialize(scan(df, doc_id, text), "spans")
    joined = scanned.join(linked(scanned, scope), "_key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(f"array<{SPAN}>"))))
    return joined.select(F.col("_key._doc").alias(doc_id), "base", every.alias("spans"))


def span_digests(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts, digest and text of the spans of ``scan_secrets``."""
    def count(kind):
        rank = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind.name}")

    return scanned.select(
        doc_id,
        *[count(k) for k in BASE],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def sql(documents: str = "documents") -> str:
    """The same in SQL for unique ids, with a plain join of intervals."""
    def quoted(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k.name}' AS kind, '{k.part}' AS part, '{k.wants or ''}' AS wants, {k.least} AS least, "
        f"unnest(regexp_extract_all(x, {quoted(k.pattern)}, 0)) AS hit, "
        f"unnest(regexp_extract_all(x, {quoted(k.pattern)}, {k.value})) AS val, "
        f"unnest(regexp_split_to_array(x, {quoted(k.pattern)})) AS gap, "
        f"generate_subscripts(regexp_split_to_array(x, {quoted(k.pattern)}), 1) AS i FROM t"
        for i, k in enumerate(KINDS)
    )
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM {documents}), m AS ({each}),
    p AS (SELECT *, CAST(sum(length(gap)) OVER (PARTITION BY doc_id, rank ORDER BY i)
                    + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM m),
    s AS (SELECT doc_id, rank, kind, part, wants, start, start + length(hit) AS stop FROM p
          WHERE hit IS NOT NULL AND length(val) >= least),
    r AS (SELECT * FROM s WHERE wants = '' OR EXISTS (SELECT 1 FROM s AS o WHERE o.doc_id = s.doc_id
            AND o.part = s.wants AND o.start <= s.stop + {SCOPE} AND o.stop >= s.start - {SCOPE})),
    a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (wants = '') AS base,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
          FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN a USING (doc_id)
    """
