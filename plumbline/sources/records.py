"""Records that span lines, put together in parallel.

Files are read as pieces (lines, or what stands between two closing braces), each with its file, the
start of its block and its place there. Whether a piece begins inside quotes depends on all pieces before
it, but only through one bit: so each block is first summed up as what it does to that bit, the sums of
a file's blocks are taken one after another, and then every block knows its state at the start. A task
never sees more than one block in order, and only the pieces of one record are brought together.

Lines are neither stored nor shuffled on the way: one job reads the files for the sums, a second one
reads them again, cut alike, and writes records. Only the parts of records that reach beyond a block
or a batch of lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.durable import materialize, stage_path

# A line whose fields are all closed: quoted as a whole, or not beginning with a quote.
CLOSED = r'^(?:(?:"(?:[^"]++|"")*+"[^SEP]*+|[^"SEP][^SEP]*+|)(?:SEP|$))*+$'
BLOCK = ["path", "block"]
COPIED = "named-"  # in front of copies of files that Spark would take for hidden ones
MOST_BLOCKS = 100_000  # whose states are broadcast
SUMS = """path string, __source string, block bigint, length bigint, utf8 boolean, header binary, header_line bigint,
    end0 int, end1 int, opener0 bigint, opener1 bigint"""
PARTS = """path string, __source string, kind int, block bigint, at bigint, whole boolean, record_block bigint,
    record_at bigint, raw binary"""


def closing(line: Column, sep: str) -> dict[str, Column]:
    """Whether no quote is open after a line that begins outside quotes, and after one that begins inside."""
    closed = CLOSED.replace("SEP", sep)
    quoted = F.contains(line, F.lit('"'))
    return {"closed": ~quoted | line.rlike(closed), "closes": quoted & F.concat(F.lit('"'), line).rlike(closed)}


def _place() -> Column:
    return F.struct("block", "at")


def _file_order() -> Window:
    return Window.partitionBy("path").orderBy("block")


def _block_order() -> Window:
    return Window.partitionBy(*BLOCK).orderBy("at")


def _relative(fixed: Column, value: Column, swaps: str, window: Window) -> dict[str, Column]:
    """The state after each row: `e` itself if a row before fixes it, else what it adds to the one at the start."""
    last = F.last(F.when(fixed, F.struct(value.alias("v"), F.col(swaps).alias("s"))), True).over(window)
    known = last.isNotNull()
    return {"known": known, "e": F.when(known, last["v"] + F.col(swaps) - last["s"]).otherwise(F.col(swaps)) % 2}


def _with_start(blocks: DataFrame) -> DataFrame:
    """Blocks with `start`, the state before each; `e` becomes the state behind it."""
    there = _file_order().rowsBetween(Window.unboundedPreceding, 0)  # a row per block
    summed = blocks.withColumn("s", F.sum(F.when(F.col("known"), 0).otherwise(F.col("e"))).over(there))
    ends = summed.withColumns(_relative(F.col("known"), F.col("e"), "s", there))
    return ends.withColumn("start", F.coalesce(F.lag("e").over(_file_order()), F.lit(0))).drop("s", "known")


def _with_state(pieces: DataFrame) -> DataFrame:
    """Adds `before` and `after`, 1 where a quote is open; pieces have `closed` and `closes`.

    A piece keeps the state, turns it round, or fixes it whatever it was.
    """
    whole = (Window.unboundedPreceding, 0)
    turns, fixes = ~F.col("closed") & F.col("closes"), F.col("closed") == F.col("closes")
    here = _block_order().rowsBetween(*whole)
    counted = pieces.withColumn("s", F.sum(turns.cast("int")).over(here))
    known = counted.withColumns(_relative(fixes, (~F.col("closed")).cast("int"), "s", here)).drop("s")
    lagged = {f"p_{c}": F.lag(c).over(_block_order()) for c in ("known", "e")}
    stored = materialize(known.withColumns(lagged))

    blocks = stored.groupBy(*BLOCK).agg(F.max_by(F.struct("known", "e"), "at").alias("l")).select(*BLOCK, "l.*")
    starts = _with_start(blocks).select(*BLOCK, "start")

    def absolute(known: str, e: str) -> Column:
        return F.when(F.col(known), F.col(e)).otherwise((F.col(e) + F.col("start")) % 2)

    before = F.when(F.col("p_known").isNull(), F.col("start")).otherwise(absolute("p_known", "p_e"))
    joined = stored.join(starts, BLOCK).withColumns({"before": before, "after": absolute("known", "e")})
    return joined.drop("known", "e", "p_known", "p_e", "start")


def _gathered(pieces: DataFrame, join: str) -> DataFrame:
    """Pieces put together from each one that `begins` a record to the next such one of its file."""
    upto = _block_order().rowsBetween(Window.unboundedPreceding, 0)
    own = F.max(F.when(F.col("begins"), F.col("at"))).over(upto)
    last = pieces.groupBy(*BLOCK).agg(F.max(F.when(F.col("begins"), F.col("at"))).alias("at"))
    earlier = F.last(F.when(F.col("at").isNotNull(), _place()), True).over(_file_order().rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*BLOCK, earlier.alias("carried"))
    numbered = pieces.withColumn("own", own).join(carried, BLOCK)
    record = F.when(F.col("own").isNotNull(), F.struct("block", F.col("own").alias("at"))).otherwise(F.col("carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), join)
    grouped = numbered.withColumn("record", record).groupBy("path", "__source", "record").agg(joined.alias("text"))
    return grouped.select("path", "__source", "record.*", "text")


@contextmanager
def cut_alike(spark: SparkSession):
    """Jobs inside cut files into the same blocks, however many executors come or go."""
    conf = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(conf, None)
    tasks = before or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    spark.conf.set(conf, str(tasks))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)


def text_lines(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Lines as they stand in files, with the block that holds them and what they do to open quotes."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("_metadata.file_name", f"^{COPIED}", "").alias("__source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("value").cast("binary").alias("raw"),
        *[c.alias(name) for name, c in closing(F.col("value"), sep).items()],
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Lines of one block each, in order, with the number of the first one in its block."""
    here, line = None, 0
    for batch in batches:
        path, block = batch["path"], batch["block"]
        moved = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1
        for low, high in pairwise([0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []):
            there = (path[low].as_py(), block[low].as_py())
            line = line if there == here else 0
            yield batch.slice(low, high - low), line
            here, line = there, line + high - low


def _open_quotes(lines: pa.RecordBatch, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Before and after each line, 1 where a quote is open; `start` is the state before the first."""
    closed, closes = (lines[c].to_numpy(zero_copy_only=False) for c in ("closed", "closes"))
    last = np.maximum.accumulate(np.where(closed == closes, np.arange(len(closed)), -1))  # the line that fixes the state
    turns = np.cumsum(~closed & closes)
    after = np.where(last < 0, start + turns, ~closed[last] + turns - turns[last]) % 2
    return np.concatenate([[start], after[:-1]]), after


def _sums(batches: Iterator[pa.RecordBatch], header_lines: int) -> Iterator[pa.RecordBatch]:
    """One row per block: its header if it begins a file, and the states and last openers for both states before it."""
    rows: list[dict] = []
    for lines, first in _by_block(batches):
        if first == 0:
            names = ("path", "__source", "block", "length")
            rows.append({n: lines[n][0].as_py() for n in names} | {"utf8": True, "header_line": -1, "end0": 0, "end1": 1})
        row = rows[-1]
        row["utf8"] &= pc.all(lines["utf8"]).as_py()
        if row["block"] == 0 and first < header_lines and "comma" not in row:
            near = np.flatnonzero(lines["comma"].to_numpy(zero_copy_only=False)[: header_lines - first])
            if len(near) or first == 0:
                found = int(near[0]) if len(near) else 0
                row |= {"header": lines["head"][found].as_py(), "header_line": first + found, "end0": 0, "end1": 1, "opener0": None, "opener1": None}
                row |= {"comma": True} if len(near) else {}
        skipped = max(0, row["header_line"] + 1 - first)
        body = lines.slice(skipped)
        for start in (0, 1) if body.num_rows else ():
            before, after = _open_quotes(body, row[f"end{start}"])
            openers = np.flatnonzero(before < after)
            row |= {f"end{start}": int(after[-1])} | ({f"opener{start}": first + skipped + int(openers[-1])} if len(openers) else {})
    kinds = {
        "path": pa.string(), "__source": pa.string(), "block": pa.int64(), "length": pa.int64(), "utf8": pa.bool_(), "header": pa.binary(),
        "header_line": pa.int64(), "end0": pa.int32(), "end1": pa.int32(), "opener0": pa.int64(), "opener1": pa.int64(),
    }
    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in kinds} for r in rows], pa.schema(list(kinds.items())))


def block_states(lines: DataFrame, header_lines: int = 0) -> DataFrame:
    """Blocks of the files of `lines` with what it takes to put their records together.

    `utf8` and `header` are those of the file. The header is the first line with a comma among the first
    `header_lines`, else the first line; with 0 there is none. Quotes count behind it. `start` is the state
    before the block, `tail` its first line from where each line is a record, `carried_block` and
    `carried_at` the place of the record that reaches into it.
    """
    text, begins = F.col("raw").cast("string"), F.col("block") == 0
    seen = lines.select(
        "path", "__source", "block", "length", F.is_valid_utf8(text).alias("utf8"), "closed", "closes",
        (begins & (F.instr(text, ",") > 0)).alias("comma"), F.when(begins, F.col("raw")).alias("head"),
    )
    sums = materialize(seen.mapInArrow(lambda batches: _sums(batches, header_lines), SUMS))
    blocks = _with_start(sums.withColumns({"known": F.col("end0") == F.col("end1"), "e": F.col("end0")}))
    opener = F.when(F.col("start") == 1, F.col("opener1")).otherwise(F.col("opener0"))
    blocks = blocks.withColumn("opener", F.when(opener.isNotNull(), F.struct("block", opener.alias("at"))))
    every = _file_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = _file_order().rowsBetween(Window.unboundedPreceding, -1)
    last, unclosed = F.last("opener", True).over(every), F.last("e").over(every) == 1
    tail = F.when(F.col("block") > last["block"], 0).when(F.col("block") == last["block"], last["at"])
    carried = F.last("opener", True).over(earlier)
    return materialize(
        blocks.select(
            *BLOCK, "__source", "length", "header_line", "start", F.min("utf8").over(every).alias("utf8"), F.first("header").over(every).alias("header"),
            F.when(unclosed, tail).alias("tail"), carried["block"].alias("carried_block"), carried["at"].alias("carried_at"),
        )
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and parts of those that begin or end outside the block or batch."""
    for lines, first in _by_block(batches):
        of = {n: lines[n][0].as_py() for n in lines.schema.names if n not in ("raw", "closed", "closes")}
        if of["start"] is None:
            raise RuntimeError(f"{of['path']} is cut into other blocks than before")
        if first == 0:
            state, record = of["start"], (of["carried_block"], of["carried_at"])
        skipped = max(0, of["header_line"] + 1 - first)
        body, first = lines.slice(skipped), first + skipped
        if not body.num_rows:
            continue
        before, after = _open_quotes(body, state)
        numbers = np.arange(first, first + body.num_rows)
        alone = numbers >= (first + body.num_rows if of["tail"] is None else of["tail"])
        begins = (before == 0) | alone
        heads = np.union1d([0], np.flatnonzero(begins))
        whole, at = begins[heads], numbers[heads]
        whole[-1] &= after[-1] == 0 or alone[-1]
        in_block, in_line = np.where(begins[heads], of["block"], record[0] or 0), np.where(begins[heads], at, record[1] or 0)
        state, record = int(after[-1]), (int(in_block[-1]), int(in_line[-1]))
        runs = pa.ListArray.from_arrays(pa.array([*heads.tolist(), body.num_rows], pa.int32()), body["raw"])
        n = len(heads)
        yield pa.record_batch({
            "path": pa.repeat(of["path"], n), "__source": pa.repeat(of["__source"], n), "kind": pa.repeat(pa.scalar(of["kind"], pa.int32()), n),
            "block": pa.repeat(pa.scalar(of["block"], pa.int64()), n), "at": pa.array(at, pa.int64()), "whole": pa.array(whole),
            "record_block": pa.array(in_block, pa.int64()), "record_at": pa.array(in_line, pa.int64()), "raw": pc.binary_join(runs, b"\n"),
        })


def quoted_records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines put together to records of delimited text, with the `kind` of their file; `blocks` are from `block_states`.

    A record (path, __source, kind, block, at, raw) has the place of its first line. A quote that is never
    closed ends with its line, and the lines after it are records each, so no record is the rest of a file.
    """
    states = blocks.select(*BLOCK, "length", "kind", "header_line", "start", "tail", "carried_block", "carried_at")
    keys = [*BLOCK, "length"]
    if states.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS:
        stated = lines.join(F.broadcast(states), keys, "left")
    else:  # the lines of a block come together again, in their order
        numbered = lines.withColumn("line", F.monotonically_increasing_id()).join(states, keys, "left")
        stated = numbered.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "line").drop("line")
    folder = stage_path(lines.sparkSession)
    parts = materialize(stated.drop("length").mapInArrow(_parts, PARTS), folder)
    piece = F.struct("block", "at", F.col("raw").cast("string").alias("text"))
    pieces = F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"])
    place = ["record_block", "record_at"]
    joined = parts.filter("NOT whole").groupBy("path", "__source", "kind", *place).agg(F.array_join(pieces, "\n").cast("binary").alias("raw"))
    found = joined.withColumns({"block": F.col("record_block"), "at": F.col("record_at"), "whole": F.lit(True)})
    return materialize(found.select(parts.columns), folder).filter("whole").drop("whole", *place)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects in JSON files that hold one list of objects each, a line of `text` each.

    The files are cut behind closing braces. Quotes tell which braces and brackets count, sums of these
    give the depth, and an object ends where the depth is one again. What is no such list is an error.
    """
    read = spark.read.option("lineSep", "}").text(path)
    plain = F.regexp_replace("value", r"\\.", "")  # without escaped characters, which are in strings only
    odd = F.length(F.regexp_replace(plain, '[^"]', "")) % 2 == 1
    pieces = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("__source"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"), plain.alias("plain"), (~odd).alias("closed"), odd.alias("closes"),
    )
    stated = _with_state(materialize(pieces))
    inside = F.concat(F.when(F.col("before") == 1, '"').otherwise(""), F.col("plain"))
    outside = F.regexp_replace(inside, r'"[^"]*+(?:"|\z)', "")

    def count(brackets: str) -> Column:
        return F.length(F.regexp_replace(outside, f"[^{brackets}]", ""))

    brace = F.when(F.col("after") == 0, 1).otherwise(0)  # the one behind the piece
    steps = stated.select(*BLOCK, "__source", "at", "text", "before", (count(r"{\[") - count(r"}\]") - brace).alias("step"))
    sums = F.sum("step").over(_block_order().rowsBetween(Window.unboundedPreceding, 0))
    deep = materialize(steps.withColumn("depth", sums))
    blocks = deep.groupBy(*BLOCK).agg(F.sum("step").alias("total"), F.min("at").alias("at"), F.max("at").alias("last"))
    every = Window.partitionBy("path")
    starts = blocks.select(
        *BLOCK, F.coalesce(F.sum("total").over(_file_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.min(_place()).over(every).alias("first"), F.max(F.struct("block", F.col("last").alias("at"))).over(every).alias("last"),
    )
    at_depth = F.col("start") + F.col("depth") - F.col("step")
    begins = (F.col("before") == 0) & (at_depth <= 1)
    placed = deep.join(starts, BLOCK).withColumns({"begins": begins, "is_first": _place() == F.col("first"), "is_last": _place() == F.col("last")})
    # the first and the last piece of each file tell whether its text is a list
    ends = placed.filter("is_first OR is_last").select("path", "block", "at", "is_first", "is_last")
    whole = _gathered(placed.select(*BLOCK, "__source", "at", "text", "begins"), "}").join(ends, ["path", "block", "at"], "left")
    text = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"[\r\n]", " ")
    lead = F.when(F.col("is_first"), r"^\s*\[\s*(?=\{)").otherwise(r"^\s*,\s*(?=\{)")
    closing_text = F.when(F.col("is_first"), r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")
    found = whole.select(text.alias("text"), lead.alias("lead"), closing_text.alias("closing"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    wrong = F.raise_error(F.concat(F.lit("malformed list of JSON objects near: "), F.substring("text", 1, 200)))
    good = F.when(F.col("is_last"), F.expr("text RLIKE closing")).otherwise(F.expr("text RLIKE lead"))
    body = F.concat(F.expr("regexp_replace(text, lead, '')"), F.lit("}"))
    checked = found.select(F.when(~good, wrong).otherwise(F.when(~F.col("is_last"), body)).alias("text"))
    return checked.filter("text IS NOT NULL")
