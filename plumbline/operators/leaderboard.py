"""Scoring runs, choosing the best one and reporting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.diagnose import TRUSTED
from plumbline.operators.profile import q

MAX_ROUNDS = 3
REPORT_METRICS = ("accuracy", "f1", "rmse", "mae", "r2", "n_train", "n_test")


def run_score(runs: DataFrame, task: str = "task", score: str = "score") -> DataFrame:
    """Higher is better: F1, else accuracy, for classification; R² otherwise."""
    chosen = F.when(q(task) == "classification", F.coalesce("f1", "accuracy")).otherwise(
        F.col("r2")
    )
    return runs.withColumn(score, chosen)


def _rounds(runs: DataFrame, session: list[str], max_rounds: int | None) -> DataFrame:
    """One row per session: its runs as an array of structs and the round it ends with.

    A session is a handful of rounds, so they fit into one row.
    """
    counted = runs.filter(F.col("round") >= 1)
    if max_rounds is not None:
        counted = counted.filter(F.col("round") <= max_rounds)
    rest = [q(c) for c in runs.columns if c not in session]
    per = counted.groupBy(*session).agg(F.collect_list(F.struct(*rest)).alias("__runs"))

    def first(wanted) -> Column:
        return F.array_min(F.transform(F.filter("__runs", wanted), lambda r: r["round"]))

    succeeded = first(lambda r: r["ok"])
    trusted = first(lambda r: r["ok"] & (r["verdict"] == TRUSTED))
    broke = first(lambda r: ~r["ok"] & (r["round"] > F.col("__succeeded")))
    last = F.array_max(F.transform("__runs", lambda r: r["round"]))
    return per.withColumn("__succeeded", succeeded).withColumn(
        "stop_round", F.least(trusted, broke, last).cast("int")
    )


def stop_round(runs: DataFrame, session: list[str], max_rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """The round each session ends with.

    That is its first trusted round, its first failed round after a success, or its
    last. Rounds beyond `max_rounds` do not count; None sets no limit. Runs need
    `round`, `ok` and `verdict`.
    """
    return _rounds(runs, session, max_rounds).select(*session, "stop_round")


def best_run(runs: DataFrame, session: list[str], max_rounds: int | None = MAX_ROUNDS) -> DataFrame:
    """The best successful run of each session up to its stop round.

    The highest score wins and the earliest of equal scores; a session without any
    score keeps its latest run. Rounds beyond `max_rounds` do not count; None sets no
    limit. Runs need `round`, `ok`, `verdict` and `score`.
    """

    def rank(r: Column) -> Column:
        tie = F.when(r["score"].isNull(), r["round"]).otherwise(-r["round"])
        return F.struct(r["score"].isNotNull(), r["score"], tie)

    usable = F.filter("__runs", lambda r: r["ok"] & (r["round"] <= F.col("stop_round")))
    better = F.reduce("__usable", F.get("__usable", F.lit(0)), lambda a, b: F.when(rank(b) > rank(a), b).otherwise(a))
    rest = [c for c in runs.columns if c not in session]
    return (
        _rounds(runs, session, max_rounds)
        .withColumn("__usable", usable)
        .filter(F.size("__usable") > 0)
        .withColumn("__best", better)
        .select(*session, *[F.col("__best")[c].alias(c) for c in rest], "stop_round")
    )


def top_features(
    importance: DataFrame,
    k: int = 15,
    name: str = "feature",
    value: str = "importance",
    by: list[str] | None = None,
) -> DataFrame:
    """The `k` most important features (15 for display, 10 for a summary)."""
    order = [q(value).desc(), q(name)]
    if not by:
        return importance.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*[q(c) for c in by]).orderBy(*order))
    return importance.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def report(runs: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Rounded metrics of each run as rows (keys, metric, value)."""
    present = [c for c in REPORT_METRICS if c in runs.columns]
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"), F.round(q(c).cast("double"), digits).alias("value")
            )
            for c in present
        ]
    )
    return runs.select(*keys, F.inline(entries)).filter(F.col("value").isNotNull())
