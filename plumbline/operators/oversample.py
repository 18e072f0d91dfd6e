"""Balancing classes with synthetic rows between a minority row and a near neighbour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import unit_hash
from plumbline.operators import skew
from plumbline.operators.neighbors import nearest
from plumbline.operators.order import nth_value
from plumbline.operators.profile import q

NEIGHBORS = 5
BLOCK = 1000
MAX_CLASSES = 1000


def smote(
    train: DataFrame,
    features: list[str],
    target: str,
    key: str,
    k: int = NEIGHBORS,
    seed: int = 42,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Raise every class to the size of the largest one.

    Adds `synthetic` and `origin`, the key of the row a synthetic row was made from;
    synthetic rows have no key. All choices are hashes of key and seed. More than
    `max_classes` classes are refused.
    """
    sizes = train.groupBy(q(target)).count().limit(max_classes + 1).collect()
    if len(sizes) > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} classes")
    counts = {r[0]: r[1] for r in sizes}
    most = max(counts.values())
    real = train.withColumns(
        {
            "synthetic": F.lit(False),
            "origin": F.lit(None).cast("bigint"),
            **{c: q(c).cast("double") for c in features},
        }
    )
    made = [
        _synthesize(train.filter(q(target).eqNullSafe(F.lit(label))), features, key, most - n, n, k, seed)
        .withColumn(target, F.lit(label).cast(train.schema[target].dataType))
        for label, n in counts.items()
        if n < most
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [real, *made])


def _synthesize(
    minority: DataFrame, features: list[str], key: str, wanted: int, n: int, k: int, seed: int
) -> DataFrame:
    rows = minority.select(
        q(key).cast("bigint").alias("origin"),
        F.array(*[q(c).cast("double") for c in features]).alias("v"),
        F.xxhash64(q(key).cast("string"), F.lit(seed)).alias("h"),
    )
    every, rest = divmod(wanted, n)
    cut = nth_value(rows, "h", rest - 1) if rest else None
    extra = F.lit(0) if cut is None else (F.col("h") <= cut).cast("int")
    rows = rows.withColumn("copies", F.lit(every) + extra).filter("copies > 0")
    near = nearest(minority, minority, features, k, key, key, same_row=True)
    options = near.groupBy("query").agg(  # at most k entries
        F.array_sort(F.collect_list(F.struct("rank", "point"))).alias("near")
    )
    options = options.withColumnRenamed("query", "origin")
    rows = skew.join_on(rows, options, ["origin"], "left")
    blocks = rows.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BLOCK)))
    )
    if every >= BLOCK:  # few rows make many copies: spread them before multiplying
        blocks = blocks.repartition("origin", "block")
    first = F.col("block") * BLOCK
    last = F.least(first + BLOCK, F.col("copies").cast("bigint")) - 1
    each = blocks.withColumn("copy", F.explode(F.sequence(first, last)))
    pick = F.floor(unit_hash("origin", "copy", seed=f"pick{seed}") * F.size("near")).cast("int")
    other = F.coalesce(F.get(F.col("near"), pick)["point"], F.col("v"))
    placed = each.withColumns(
        {"other": other, "step": unit_hash("origin", "copy", seed=f"step{seed}")}
    )
    new = {
        c: F.col("v")[i] + F.col("step") * (F.col("other")[i] - F.col("v")[i])
        for i, c in enumerate(features)
    }
    return placed.select(
        "origin", F.lit(True).alias("synthetic"), *[x.alias(c) for c, x in new.items()]
    )
