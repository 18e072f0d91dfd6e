"""Operator 13: the prefix trie of conversations, by ROLLUP over columns of turns.

A turn is known by 128 bits of the SHA-256 of its role and text, so texts stay where they are. Each
conversation becomes rows of `WIDTH` turn columns, one row per block of its turns, and one ROLLUP over
these columns, grouped by the block and by the node that the blocks before it end in, aggregates all
prefixes of all blocks together; grouping_id tells how long a prefix is. A node's key is the XOR of two
hashes of each turn with its position, so the key that a block begins with is a prefix sum over the
blocks before it, taken in two steps (within runs of blocks, and over the runs): no loop over the
depth, and no conversation is walked by one task.

Sums over a subtree need no walk either. A node is named by its smallest member, so the nodes that a
conversation names are the last ones of its path. With B(c) the code points before the first of them, a
node at depth d with n members, whose first d - 1 turns have P code points, saves in its subtree the sum
of B(c) over its members but the one that names it, less (n - 1) * P; and its leaves are the members
that name a leaf. Both are plain sums in a second ROLLUP.

Rows of one turn are ordered by that digest; null turns come first; null role or text is empty; rows
without conv_id belong to no conversation and take no part; repeated rows are turns of their own; an
empty table gives no rows, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, text_of
from plumbline.operators.order import global_index
from plumbline.operators.skew import hot_keys, lookup_join

WIDTH = 8
RUN = 1024  # blocks whose prefix sums are taken together
IDS = 1 << 16  # conversation ids written into one piece of text
KEY, PARENT = ["depth", "x0", "x1"], ["depth", "y0", "y1"]


def identified(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (of role and text) and length (code points of the text)."""
    role, text = text_of("role"), text_of("text")
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(F.encode(framed, "UTF-8"), 256), 1, 32))
    known = conversations.filter("conv_id IS NOT NULL")
    return known.select(F.col("conv_id").cast("bigint"), "turn", digest.alias("id"), F.length(text).cast("bigint").alias("length"))


def with_heads(conversations: DataFrame, every: int = 100, longest: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others, as (turns, conversations) for `trie`.

    The first h turns of conversation c are those of c - c % every, if it has them, instead of its own
    first h; h is crc32(c) % longest.
    """
    ordered = stored(global_index(identified(conversations), ["conv_id", "turn", "id"], "at"))
    own = ordered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % longest).cast("int")
    convs = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor"))
    hot = hot_keys(ordered, ["conv_id"])
    placed = lookup_join(ordered, own.select("conv_id", "first"), ["conv_id"], "inner", hot)
    placed = placed.select("conv_id", (F.col("at") - F.col("first") + 1).alias("position"), "id", "length")
    one = F.struct("position", "id", "length")
    heads = (
        placed.filter((F.col("conv_id") % every == 0) & (F.col("position") < longest))
        .groupBy(F.col("conv_id").alias("donor")).agg(F.sort_array(F.collect_list(one)).alias("head"))  # longest - 1 turns
    )
    m = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)))
    n_turns = F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = convs.join(heads, "donor", "left").withColumn("m", F.when(F.col("head").isNull(), 0).otherwise(m))
    convs = stored(convs.select("conv_id", "h", "m", n_turns.alias("n_turns"), "head"))
    rest = lookup_join(placed, convs.select("conv_id", "h", "m"), ["conv_id"], "inner", hot).filter("position > h")
    moved = rest.select("conv_id", (F.col("position") - F.col("h") + F.col("m")).alias("position"), "id", "length")
    taken = convs.filter("m > 0").select("conv_id", F.inline(F.slice("head", 1, F.col("m"))))
    return moved.unionByName(taken), convs.select("conv_id", "n_turns")


def _mix(lane: int, position: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(lane), position.cast("bigint"), turn)


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block of `WIDTH` turns; one without turns has an empty first block.

    t0, t1, … are the turns' ids; c0, c1, … the code points before each of them and at the end; k0, k1
    the key of the node before the block and e0, e1 that of the last one in it.
    """
    block, place = F.expr(f"(position - 1) DIV {WIDTH}"), F.expr(f"(position - 1) % {WIDTH}")
    lanes = [_mix(i, F.col("position"), F.col("id")).alias(f"h{i}") for i in (0, 1)]
    rows = turns.select("conv_id", block.alias("block"), place.alias("place"), "id", "length", *lanes)
    none = convs.filter("n_turns = 0").select("conv_id", F.lit(0).cast("bigint").alias("block"))
    at = [F.when(F.col("place") == j, F.col("id")) for j in range(WIDTH)]
    sizes = [F.when(F.col("place") == j, F.col("length")) for j in range(WIDTH)]
    whole = rows.unionByName(none, allowMissingColumns=True).groupBy("conv_id", "block").agg(
        *[F.max(t).alias(f"t{j}") for j, t in enumerate(at)], *[F.coalesce(F.max(s), F.lit(0)).alias(f"s{j}") for j, s in enumerate(sizes)],
        F.coalesce(F.sum("length"), F.lit(0)).alias("s"), *[F.coalesce(F.bit_xor(f"h{i}"), F.lit(0)).alias(f"g{i}") for i in (0, 1)],
    )
    whole = stored(whole.withColumn("run", F.expr(f"block DIV {RUN}")))

    def before(order: str, *keys: str) -> dict[str, Column]:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        sums = {"b0": F.bit_xor("g0"), "b1": F.bit_xor("g1"), "bs": F.sum("s")}
        return {name: F.coalesce(f.over(w), F.lit(0)) for name, f in sums.items()}

    runs = whole.groupBy("conv_id", "run").agg(*[F.bit_xor(c).alias(c) for c in ("g0", "g1")], F.sum("s").alias("s"))
    runs = runs.select("conv_id", "run", *[c.alias(f"r{name}") for name, c in before("run", "conv_id").items()])
    summed = whole.withColumns(before("block", "conv_id", "run")).join(runs, ["conv_id", "run"])
    start = [(F.col(f"b{i}").bitwiseXOR(F.col(f"rb{i}"))) for i in (0, 1)]
    points = [F.col("bs") + F.col("rbs")]
    for j in range(WIDTH):
        points.append(points[-1] + F.col(f"s{j}"))
    return summed.select(
        "conv_id", "block", *[f"t{j}" for j in range(WIDTH)], *[p.alias(f"c{j}") for j, p in enumerate(points)],
        *[s.alias(f"k{i}") for i, s in enumerate(start)], *[s.bitwiseXOR(F.col(f"g{i}")).alias(f"e{i}") for i, s in enumerate(start)],
    )


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks: the node's key and its parent's, and the measures over its members."""
    turns = ", ".join(f"t{j}" for j in range(WIDTH))
    rolled = blocks.sparkSession.sql(
        f"SELECT block, k0, k1, {turns}, {WIDTH} - bit_count(grouping_id()) AS n, {measures} "
        f"FROM {{blocks}} GROUP BY block, k0, k1, ROLLUP({turns})",
        blocks=blocks,
    )
    last = F.element_at(F.array(*[f"t{j}" for j in range(WIDTH)]), F.greatest(F.col("n"), F.lit(1)))
    real = F.when(F.col("n") == 0, F.col("block") == 0).otherwise(last.isNotNull())  # else none of the members is that long
    rolled = rolled.filter(real)

    def key(lane: int, shorter: int) -> Column:
        out = F.col(f"k{lane}")
        for j in range(WIDTH):
            mixed = _mix(lane, F.col("block") * WIDTH + j + 1, F.col(f"t{j}"))
            out = out.bitwiseXOR(F.when(F.col("n") - shorter > j, mixed).otherwise(F.lit(0)))
        return out

    keys = {f"{name}{lane}": key(lane, shorter) for name, shorter in (("x", 0), ("y", 1)) for lane in (0, 1)}
    return rolled.withColumns({"depth": F.col("block") * WIDTH + F.col("n")} | keys)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined conversation ids of each run of rows of one node, cut after `IDS` of them."""
    names = [*KEY, "conv_id"]
    for batch in batches:
        columns = [batch[c].to_numpy() for c in names]
        if not len(columns[0]):
            continue
        new = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
        cuts = sorted({x for a, b in zip(cuts, cuts[1:]) for x in range(a, b, IDS)} | {cuts[-1]})
        texts = batch["conv_id"].cast(pa.string()).to_pylist()
        starts = cuts[:-1]
        joined = pa.array([",".join(texts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.string())
        yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in columns], joined], names=[*names, "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, in order, with commas between."""
    current, state = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*(batch[c].to_pylist() for c in [*KEY, "ids"])):
            if node == current:
                state.update(b"," + ids.encode())
                continue
            if current is not None:
                done.append((*current, state.hexdigest()))
            current, state = node, hashlib.sha256(ids.encode())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
    if current is not None:
        yield pa.record_batch([pa.array([v]) for v in (*current, state.hexdigest())], names=[*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """Digest of the ascending conv_ids of each node in `ends` (its key and conv_id, a row per conversation).

    A node where very many conversations end is sorted and written as text by many tasks; only the
    digest itself, a chain, takes these texts one after another, a piece at a time in memory.
    """
    pieces = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    ordered = ends.select(*order).repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    texts = ordered.mapInArrow(_pieces, "depth bigint, x0 bigint, x1 bigint, conv_id bigint, ids string")
    chained = texts.repartition(*KEY).sortWithinPartitions(*order).select(*KEY, "ids")
    return chained.mapInArrow(_digests, "depth bigint, x0 bigint, x1 bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of `turns` (conv_id, position from 1, id, length).

    `convs` holds every conversation once with its number of turns, also those without any. Besides the
    counts a node has the id of its last turn (null at the root) and that turn's length.
    """
    blocks = stored(_blocks(turns, convs))
    points = ", ".join(f"min(c{j}) AS c{j}" for j in range(WIDTH + 1))
    rolled = _rollup(blocks, f"min(conv_id) AS conv_id, count(*) AS n_convs, {points}")
    at = F.array(*[f"c{j}" for j in range(WIDTH + 1)])
    before = F.when(F.col("n") == 0, 0).otherwise(F.element_at(at, F.greatest(F.col("n"), F.lit(1))))
    length = F.when(F.col("n") == 0, 0).otherwise(F.element_at(at, F.col("n") + 1)) - before
    last = F.when(F.col("n") > 0, F.element_at(F.array(*[f"t{j}" for j in range(WIDTH)]), F.greatest(F.col("n"), F.lit(1))))
    plain = ["conv_id", "n_convs", *KEY, "y0", "y1"]
    nodes = stored(rolled.select(*plain, last.alias("turn_id"), length.alias("length"), before.alias("before")))

    up = (F.col("depth") - 1).alias("depth")
    children = nodes.filter("depth > 0").groupBy(up, F.col("y0").alias("x0"), F.col("y1").alias("x1")).agg(F.count(F.lit(1)).alias("n_children"))
    with_children = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(with_children)

    named = nodes.groupBy("conv_id").agg(F.sum("length").alias("own"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaf"))
    totals = blocks.groupBy("conv_id").agg(F.max(f"c{WIDTH}").alias("total"))
    b_of = F.col("total") - F.coalesce("own", F.lit(0))
    per_conv = totals.join(named, "conv_id", "left").select("conv_id", b_of.alias("b"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    measured = lookup_join(blocks, stored(per_conv), ["conv_id"], "inner", hot_keys(blocks, ["conv_id"]))
    sums = _rollup(measured, "sum(b) - min_by(b, conv_id) AS b, sum(leaf) AS n_leaves").select(*KEY, "b", "n_leaves")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("conv_id").alias("parent_conv_id"))
    below = lookup_join(nodes, parents, PARENT, "left", hot_keys(nodes, PARENT))
    n_turns = F.greatest(F.col("n_turns"), F.lit(1))
    ending = blocks.join(convs, "conv_id").filter(F.col("block") == F.floor((n_turns - 1) / WIDTH))
    ends = ending.select(F.col("n_turns").cast("bigint").alias("depth"), F.col("e0").alias("x0"), F.col("e1").alias("x1"), "conv_id")
    joined = below.join(sums, KEY).join(end_digests(ends), KEY, "left")
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("n_leaves").cast("bigint"), (F.col("b") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "turn_id", "length",
    )
