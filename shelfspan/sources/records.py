"""Records of CSV files whose quoted cells may hold line breaks, found by all tasks at once.

Where a file split begins, nobody knows whether it is inside a quoted cell. So each line is read for both cases: a
line maps the state before it (outside, inside) to the state after it, tasks chain these maps along their splits, and chaining the
splits' maps, one row for each split, tells how each split begins. Only the lines of records of several lines are shuffled, by record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.sources.shared import stored

#: States within a line: outside at the start of a cell, outside within a cell, inside quotes, after a quote that ends the cell or is the first of two.
START, WITHIN, INSIDE, QUOTE = 0, 1, 2, 3
#: A record's id is its file's place times this, plus the split's first byte, plus the line's place in the split: a line has a byte at least, so ids ascend and don't meet.
FILE = 1 << 46
ID = "file * {FILE} + block + at".format(FILE=FILE)


def _after(segment: Column) -> Column:
    """The state after text outside quotes that isn't empty."""
    return F.when(segment.endswith(","), F.lit(START)).otherwise(F.lit(WITHIN))


def scan(line: Column, inside: bool) -> Column:
    """struct(state, commas): the state after a line that begins inside or outside quotes, and commas outside quotes.

    A quote opens a cell only at its start, and two quotes within a quoted cell are one. Text after the closing quote belongs to the cell.
    """
    commas = lambda x: (F.char_length(x) - F.char_length(F.replace(x, F.lit(","), F.lit("")))).cast("int")
    state = lambda s, n: F.struct(s.cast("int").alias("state"), n.cast("int").alias("commas"))
    parts = F.split(line, '"', -1)
    first = F.get(parts, 0)
    begin = state(F.lit(INSIDE), F.lit(0)) if inside else state(F.when(first == "", F.lit(START)).otherwise(_after(first)), commas(first))

    def quote_then(was: Column, x: Column) -> Column:
        s = was["state"]
        outside = s.isin(WITHIN, INSIDE)  # a quote within an open cell, or a closing one
        then = F.when(s.isin(START, QUOTE), F.lit(INSIDE)).when(x == "", F.when(s == INSIDE, F.lit(QUOTE)).otherwise(F.lit(WITHIN))).otherwise(_after(x))
        return state(then, was["commas"] + F.when(outside, commas(x)).otherwise(F.lit(0)))

    whole = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), begin, quote_then)
    return F.when(F.contains(line, F.lit('"')), whole).otherwise(begin)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, for a split that begins outside (0) or inside (1): s, whether the line begins inside, and r, the place of the line that began its record, -1 if that is before the split."""
    split, lines, state, record = None, 0, [False, True], [-1, -1]
    for b in batches:
        of = list(zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True))
        ends = [k for k in range(1, len(of)) if of[k] != of[k - 1]] + [len(of)] if of else []
        begin = 0
        for end in ends:
            if of[begin] != split:
                split, lines, state, record = of[begin], 0, [False, True], [-1, -1]
            part = b.slice(begin, end - begin)
            begin, n = end, part.num_rows
            after = [part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("e0", "e1")]
            fixed, turns = after[0] == after[1], after[0] & ~after[1]
            k = np.arange(n)
            last = np.maximum.accumulate(np.where(fixed, k, -1))  # the last line after which the state is known whatever it was
            turned = np.cumsum(turns)
            added = {"at": k + lines}
            for case in (0, 1):
                base = np.where(last >= 0, after[0][last], state[case])
                out = base ^ (((turned - np.where(last >= 0, turned[last], 0)) % 2) == 1)
                s = np.concatenate([[state[case]], out[:-1]])
                r = np.maximum.accumulate(np.where(~s, k + lines, record[case]))
                added |= {f"s{case}": s, f"r{case}": r, f"t{case}": out}
                state[case], record[case] = bool(out[-1]), int(r[-1])
            lines += n
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("path", "block", "value", "commas")), *(pa.array(added[c]) for c in ADDED)], names=["path", "block", "value", "commas", *ADDED]
            )


ADDED = ("at", "s0", "s1", "r0", "r1", "t0", "t1")


@dataclass
class Records:
    """rows: (id, value) of each record, ids ascending in file order; width: the most cells of a record."""

    rows: DataFrame
    width: int


def read_records(spark: SparkSession, path: str) -> Records:
    """Records of a CSV file, or of a folder's files in order of their names, blank ones too.

    Line breaks within cells become `\\n`. A file that ends inside quotes is an error, as its last record has no end. Lines are
    written once to the shared folder, so that all later steps see the same splits whatever the number of executors is then.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    inside = lambda s: s["state"] == INSIDE
    read = text.select("path", "block", "value", scan(F.col("value"), False).alias("a"), scan(F.col("value"), True).alias("b")).select("path", "block", "value", F.col("a.commas").alias("commas"), inside(F.col("a")).alias("e0"), inside(F.col("b")).alias("e1"))
    lines = stored(read.mapInArrow(_chain, "path string, block long, value string, commas int, at long, s0 boolean, s1 boolean, r0 long, r1 long, t0 boolean, t1 boolean"))
    # One row for each split, which the driver has had in its plan too.
    last = lambda c: F.max_by(c, "at").alias(c)
    splits = sorted(lines.groupBy("path", "block").agg(*map(last, ("t0", "t1", "r0", "r1"))).collect(), key=lambda r: (r.path, r.block))
    starts, files, file, open_, record = [], 0, None, False, None
    for r in splits:
        if r.path != file:
            if open_:
                break
            file, files, record = r.path, files + 1, None
        starts.append((r.path, r.block, files - 1, open_, record if open_ else None))
        began = r.r1 if open_ else r.r0
        record = (files - 1) * FILE + r.block + began if began >= 0 else record
        open_ = r.t1 if open_ else r.t0
    if open_:
        raise ValueError(f"{file} ends inside a quoted cell")
    known = spark.createDataFrame(starts, "path string, block long, file int, open boolean, record long")
    placed = lines.join(F.broadcast(known), ["path", "block"]).withColumns({"id": F.expr(ID), "s": F.when(F.col("open"), F.col("s1")).otherwise(F.col("s0")), "t": F.when(F.col("open"), F.col("t1")).otherwise(F.col("t0")), "r": F.when(F.col("open"), F.col("r1")).otherwise(F.col("r0"))})
    single = placed.where("not s and not t")
    pieces = placed.where("s or t").withColumn("of", F.when(F.col("r") >= 0, F.col("file") * F.lit(FILE) + F.col("block") + F.col("r")).otherwise(F.col("record")))
    whole = pieces.groupBy(F.col("of").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("p")).select("id", F.array_join(F.transform("p", lambda p: p["value"]), "\n").alias("value"))
    long = stored(whole)
    width = [r[0] for r in (single.agg(F.max("commas")).first(), long.agg(F.max(scan(F.col("value"), False)["commas"])).first())]
    rows = single.select("id", "value").unionByName(long)
    rows = rows.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    return Records(rows, 1 + max((w for w in width if w is not None), default=-1))
