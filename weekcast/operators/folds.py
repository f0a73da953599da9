"""Time-ordered splits. Every split is decided on distinct weeks, a table bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import week_start
from weekcast.plans.scale import CALENDAR_ROWS, attach, with_scalars
from weekcast.spec import DEFAULT, SeriesSpec

# Folds, test weeks per fold and gap of the time-ordered validation.
N_SPLITS = 5
TEST_WEEKS = 4
GAP = 0


def temporal_split(
    df: DataFrame, spec: SeriesSpec = DEFAULT, test_weeks: int = 2, validation_weeks: int = 2
) -> DataFrame:
    """Labels rows test (last weeks), validation (the weeks before) or train, by date."""
    last = df.agg(F.max(spec.week_date).alias("_last"))
    test = F.date_sub("_last", 7 * test_weeks)
    validation = F.date_sub("_last", 7 * (test_weeks + validation_weeks))
    label = (
        F.when(F.col(spec.week_date) > test, "test")
        .when(F.col(spec.week_date) > validation, "validation")
        .otherwise("train")
    )
    return with_scalars(df, last).withColumn("split", label).drop("_last")


def newest_weeks_start(df: DataFrame, weeks: int = TEST_WEEKS, spec: SeriesSpec = DEFAULT) -> Column:
    """First day of the newest ``weeks`` calendar weeks of ``df``, as a scalar subquery."""
    newest = F.date_trunc("week", F.max(spec.week_date)).cast("date")
    return df.agg(F.date_sub(newest, 7 * (weeks - 1)).alias("start")).scalar()


def week_ranks(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """(week_start, week_rank, n_weeks) of the distinct weeks, newest = 1."""
    weeks = df.select(week_start(F.col(spec.week_date)).alias("week_start")).distinct()
    everything = Window.partitionBy(F.lit(0))
    return weeks.select(
        "week_start",
        F.row_number().over(everything.orderBy(F.desc("week_start"))).alias("week_rank"),
        F.count(F.lit(1)).over(everything).alias("n_weeks"),
    )


def temporal_folds(
    df: DataFrame, spec: SeriesSpec = DEFAULT, n_splits: int = N_SPLITS, test_weeks: int = TEST_WEEKS
) -> DataFrame:
    """Adds ``fold``: 0 for weeks before every test block, else the number (1 = oldest) of the test
    block the row's week belongs to. Fold k trains on rows with ``fold < k`` (see ``fold_train``).

    The ids are the only record of the folds: what trains or tests later reads them and takes no counts."""
    block = F.ceil(F.col("week_rank") / test_weeks).cast("int")
    fold = F.when(block <= n_splits, n_splits + 1 - block).otherwise(0)
    table = week_ranks(df, spec).select(
        "week_start", fold.alias("fold"), F.col("week_rank").cast("int").alias("week_rank")
    )
    out = attach(df.withColumn("week_start", week_start(F.col(spec.week_date))), table, ["week_start"], rows=CALENDAR_ROWS)
    return out.drop("week_start")


def fold_ids(df: DataFrame) -> list[int]:
    """The folds present in a frame from ``temporal_folds``, oldest first."""
    return list(range(1, int(df.agg(F.max("fold")).first()[0] or 0) + 1))


def fold_train(df: DataFrame, fold: int, gap: int = GAP) -> DataFrame:
    """Rows strictly before the test block of ``fold``, less the ``gap`` weeks right before it."""
    before = df.where(F.col("fold") < fold)
    if gap <= 0:
        return before
    newest = before.agg(F.min("week_rank").alias("_newest"))
    return with_scalars(before, newest).where(F.col("week_rank") >= F.col("_newest") + gap).drop("_newest")


def fold_test(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def chronological_holdout(df: DataFrame, spec: SeriesSpec = DEFAULT, train_share: float = 0.8) -> DataFrame:
    """Oldest share of the weeks for training, the rest for validation, split on whole weeks."""
    table = week_ranks(df, spec).select(
        "week_start",
        F.when(F.col("n_weeks") - F.col("week_rank") < F.floor(F.col("n_weeks") * train_share), "train")
        .otherwise("validation")
        .alias("split"),
    )
    out = attach(df.withColumn("week_start", week_start(F.col(spec.week_date))), table, ["week_start"], rows=CALENDAR_ROWS)
    return out.drop("week_start")
