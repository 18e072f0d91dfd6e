"""Usage logs: cost, totals, deltas and reuse of repeated requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.operators.profile import q
from plumbline.operators.series import with_history

PER_TOKENS = 1_000_000


def usage_cost(
    usage: DataFrame, prices: dict[str, tuple[float, float]], model: str = "model"
) -> DataFrame:
    """Add `cost_usd` from a price list {model: (input, output) per million tokens}.

    Models without a price cost nothing.
    """
    listed = usage.sparkSession.createDataFrame(
        [(m, float(i), float(o)) for m, (i, o) in prices.items()],
        "__model string, __in double, __out double",
    )
    priced = usage.join(F.broadcast(listed), q(model) == F.col("__model"), "left")

    def part(tokens: str, price: str) -> Column:
        return F.coalesce(tokens, F.lit(0)) / PER_TOKENS * F.coalesce(price, F.lit(0.0))

    cost = part("input_tokens", "__in") + part("output_tokens", "__out")
    return priced.withColumn("cost_usd", cost).drop("__model", "__in", "__out")


def usage_rollup(usage: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and, when present, cost per group."""
    sums = [c for c in ("input_tokens", "output_tokens", "cost_usd") if c in usage.columns]
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in sums]
    )


def usage_delta(
    snapshots: DataFrame, session: list[str], step: str, cols: list[str] | None = None, **options
) -> DataFrame:
    """Use per step from running totals: each total minus the one before it."""
    cols = cols or ["input_tokens", "output_tokens", "calls"]

    def build(window, same):
        earlier = {c: F.when(same(1), F.lag(q(c), 1).over(window)) for c in cols}
        return {f"{c}_delta": q(c) - F.coalesce(earlier[c], F.lit(0)) for c in cols}

    return with_history(snapshots, [step], session, 1, build, **options)


def request_key(*parts: str | Column) -> Column:
    """SHA-256 over everything that makes two requests equal, parts in order.

    Each part goes in with its length in front, a missing one as N, so no two different
    requests are written alike.
    """
    cols = [(q(p) if isinstance(p, str) else p).cast("string") for p in parts]
    sized = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in cols]
    return F.sha2(F.concat(*[F.coalesce(c, F.lit("N")) for c in sized]), 256)


def dedupe_requests(
    requests: DataFrame, key: str, order: str, answer: str | None = None
) -> DataFrame:
    """One row per distinct request: its first call, all calls, and reused ones."""
    first = [F.min(q(order)).alias("first_call")]
    if answer:
        first.append(F.min_by(q(answer), q(order)).alias("answer"))
    n = F.count(F.lit(1))
    return requests.groupBy(q(key)).agg(*first, n.alias("calls"), (n - 1).alias("hits"))


def reuse_answers(
    requests: DataFrame, key: str, order: str, answer: str, hot_rows: int | None = None
) -> DataFrame:
    """Give every request the answer of its first equal call; `reused` marks repeats."""
    firsts = dedupe_requests(requests, key, order, answer).select(
        q(key), "first_call", F.col("answer").alias("__answer")
    )
    hot = skew.hot_keys(requests, [key], hot_rows)
    joined = skew.lookup_join(requests, firsts, [key], "left", hot)
    return joined.withColumns(
        {answer: F.col("__answer"), "reused": q(order) > F.col("first_call")}
    ).drop("__answer", "first_call")
