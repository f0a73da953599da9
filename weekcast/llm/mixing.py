"""Mixing of sources, languages and topics to target weights.

Tokens are counted per cell (source, language, topic). Iterative proportional fitting rakes the cell weights to
the target share of each dimension in turn. The raked weight over the count is a cell's factor; documents are
sampled with probability min(1, c * factor), where c is calibrated so that the expected tokens are the budget. The
raked weights meet the targets; the sample meets them only as far as no cell is kept whole. ``expected_shares`` gives
what it achieves beside each target, and the most that the budget allows.

Only the table of cells, one row per combination that occurs, takes part in the fitting. A draw is a hash of the
id and a seed, so it is the same in every run and on every retry.

Nulls in a dimension are a value of their own (an empty name). Null and empty texts count one token. A null id
draws like an empty one; repeated rows are kept or dropped together. Columns of the input pass through unchanged.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.llm.common import materialize
from weekcast.plans.scale import attach

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = 0.7
ROUNDS = 8
BUDGET = 0.8
SEED = "mix-1"
HASH_DIGITS = 13
LONG_TEXT, SHORT_TEXT = 4000, 400


def content_topic(text: Column) -> Column:
    """Coarse kind of a text, for corpora that have no topic column."""
    plain = F.coalesce(text, F.lit(""))
    return (
        F.when(F.instr(F.lower(plain), "license") > 0, "license")
        .when(F.instr(plain, "@") > 0, "contact")
        .when(F.instr(plain, "|") > 0, "table")
        .when(F.length(plain) >= LONG_TEXT, "long")
        .when(F.length(plain) < SHORT_TEXT, "short")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Tokens of a text, by its spaces."""
    plain = F.coalesce(text, F.lit(""))
    return (F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def target_shares(cells: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """(dimension, target): token shares flattened by a temperature, where no targets are given."""
    sums = cells.groupBy(dimension).agg(F.sum("n").cast("double").alias("n"))
    flat = F.pow("n", F.lit(temperature))
    return sums.select(dimension, (flat / F.sum(flat).over(Window.partitionBy())).alias("target"))


def rake(
    cells: DataFrame, dimensions: Sequence[str], targets: Mapping[str, DataFrame], rounds: int = ROUNDS
) -> DataFrame:
    """Cells with ``weight``: ``n`` fitted to the target shares of every dimension, in turn."""
    for d in dimensions:
        cells = cells.join(targets[d].withColumnRenamed("target", f"_to_{d}"), d)
    whole = F.sum(F.col("n").cast("double")).over(Window.partitionBy())
    cells = cells.select("*", whole.alias("_all"), F.col("n").cast("double").alias("weight"))
    for _ in range(rounds):
        for d in dimensions:
            now = F.sum("weight").over(Window.partitionBy(d))
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"_to_{d}") * F.col("_all") / now)
    return cells.drop("_all", *[f"_to_{d}" for d in dimensions])


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with ``factor`` and ``probability``; expected tokens are ``budget`` of all tokens.

    Cells are taken by falling factor: while c * factor exceeds one for the next cell, it is kept whole and c is
    set from the others. The running sums go over the table of cells.
    """
    cells = cells.withColumn("factor", F.col("weight") / F.col("n"))
    order = Window.orderBy(F.desc("factor")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    n, w = F.col("n").cast("double"), F.col("weight")
    left_n = F.lit(float(budget)) * F.sum(n).over(everything) - F.coalesce(F.sum(n).over(order), F.lit(0.0))
    left_w = F.sum(w).over(everything) - F.coalesce(F.sum(w).over(order), F.lit(0.0))
    ranked = cells.withColumn("_c", left_n / left_w)
    fits = F.col("_c") * F.col("factor") <= 1
    scale = F.max_by("_c", F.when(fits, F.col("factor"))).over(everything)
    chosen = ranked.withColumn("_c", scale)
    p = F.when(F.col("_c").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("_c") * F.col("factor")))
    return chosen.withColumn("probability", p).drop("_c")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") / float(16**HASH_DIGITS)


def mixture(
    df: DataFrame, dimensions: Sequence[str], tokens: str, targets: Mapping[str, DataFrame] | None = None,
    budget: float = BUDGET, rounds: int = ROUNDS,
) -> DataFrame:
    """(dimensions..., n, weight, factor, probability): one row per cell."""
    cells = materialize(df.groupBy(*dimensions).agg(F.sum(tokens).alias("n")), "cells")
    targets = {d: (targets or {}).get(d, None) or target_shares(cells, d) for d in dimensions}
    raked = materialize(rake(cells, dimensions, targets, rounds), "cells")
    return calibrate(raked, budget)


def _described(df: DataFrame, topic: Column | None, seed: str) -> tuple[DataFrame, dict[str, str]]:
    names = {d: f"_{d}" for d in DIMENSIONS}
    values = {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "topic": topic if topic is not None else content_topic(F.col("text")),
    }
    rows = df.select(
        F.struct("*").alias("_row"),
        *[values[d].alias(n) for d, n in names.items()],
        token_count(F.col("text")).alias("_tokens"),
        uniform(F.col("doc_id"), seed).alias("_u"),
    )
    return rows, names


def expected_shares(
    df: DataFrame, topic: Column | None = None, targets: Mapping[str, DataFrame] | None = None,
    budget: float = BUDGET, rounds: int = ROUNDS,
) -> DataFrame:
    """(dimension, value, target, achieved, reachable): shares of the expected tokens of the sample that
    ``mix_documents`` draws, beside their targets. ``reachable`` is the largest share that any sample of this budget
    can have, with all of the value's tokens kept; a target above it is infeasible, and meeting all targets takes
    a budget of at most the smallest reachable * budget / target."""
    rows, names = _described(df, topic, SEED)
    inner = {names[d]: t.withColumnRenamed(d, names[d]) for d, t in (targets or {}).items()}
    cells = materialize(mixture(rows.drop("_row", "_u"), list(names.values()), "_tokens", inner, budget, rounds), "cells")
    everything, parts = Window.partitionBy(), []
    for d, name in names.items():
        to = inner[name] if name in inner else target_shares(cells, name)
        sums = cells.groupBy(name).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("probability")).alias("kept"))
        sums = sums.select(
            name, (F.col("kept") / F.sum("kept").over(everything)).alias("achieved"),
            F.least(F.lit(1.0), F.col("n") / (F.lit(float(budget)) * F.sum("n").over(everything))).alias("reachable"),
        )
        found = sums.join(to, name)
        parts.append(found.select(F.lit(d).alias("dimension"), F.col(name).alias("value"), "target", "achieved", "reachable"))
    return reduce(DataFrame.unionByName, parts)


def mix_documents(
    df: DataFrame, topic: Column | None = None, targets: Mapping[str, DataFrame] | None = None,
    budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED, keep_figures: bool = True,
) -> DataFrame:
    """The sampled rows of ``df``; with ``keep_figures`` also topic, tokens, factor and probability, in place of
    input columns of these names. Targets that the budget does not allow are missed: see ``expected_shares``."""
    rows, names = _described(df, topic, seed)
    inner = {names[d]: t.withColumnRenamed(d, names[d]) for d, t in (targets or {}).items()}
    cells = mixture(rows.drop("_row", "_u"), list(names.values()), "_tokens", inner, budget, rounds)
    cells = materialize(cells.select(*names.values(), "factor", "probability"), "cells")
    sampled = attach(rows, cells, list(names.values()), "inner").where(F.col("_u") < F.col("probability"))
    figures = {"topic": "_topic", "tokens": "_tokens", "factor": "factor", "probability": "probability"}
    figures = figures if keep_figures else {}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in figures]
    return sampled.select(*kept, *[F.col(c).alias(n) for n, c in figures.items()])


def sql(documents: str = "documents") -> str:
    """The same in SQL for the defaults: (doc_id, topic, tokens, factor, probability)."""
    steps, last = [], "c0"
    for r in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"r{r}_{d}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT * REPLACE (weight * to_{d} * everything / "
                f"sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})"
            )
            last = name
    shares = ", ".join(
        f"t_{d} AS (SELECT {d}, pow(sum(n), {TEMPERATURE}) / sum(pow(sum(n), {TEMPERATURE})) OVER () AS to_{d} "
        f"FROM cells GROUP BY {d})"
        for d in DIMENSIONS
    )
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN instr(lower(x), 'license') > 0 THEN 'license' WHEN instr(x, '@') > 0 THEN 'contact'
             WHEN instr(x, '|') > 0 THEN 'table' WHEN length(x) >= {LONG_TEXT} THEN 'long'
             WHEN length(x) < {SHORT_TEXT} THEN 'short' ELSE 'prose' END AS topic,
        length(x) - length(replace(x, ' ', '')) + 1 AS tokens,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, {HASH_DIGITS}) AS BIGINT)
          / {float(16**HASH_DIGITS)!r} AS u
      FROM (SELECT *, coalesce(text, '') AS x FROM {documents})),
    cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL),
    {shares},
    c0 AS (SELECT *, n AS weight, sum(n) OVER () AS everything
           FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
    {", ".join(steps)},
    f AS (SELECT *, weight / n AS factor FROM {last}),
    o AS (SELECT *, ({BUDGET} * sum(n) OVER () - coalesce(sum(n) OVER q, 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0)) AS c
          FROM f WINDOW q AS (ORDER BY factor DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT arg_max(c, factor) AS c FROM o WHERE c * factor <= 1)
    SELECT doc_id, d.topic, tokens, round(factor, 9) AS factor,
           round(least(1.0, (SELECT c FROM s) * factor), 9) AS probability
    FROM d JOIN f USING (source, lang, topic) WHERE u < least(1.0, (SELECT c FROM s) * factor)
    """
