"""Folds over a key's ordered rows that no task sees whole: speculative segments, joined where they meet.

Rows are cut into segments by ranges of (key, time, id), so a busy key is many segments. First every segment is folded as
if nothing came before it. Then a segment whose predecessor ends, for the same key, in another state than the one it was
begun with is folded anew from that state, until no segment is. States that do not depend on what was long ago (windows
that have passed, a breaker closed by a success) meet within a segment, and two rounds do; in the worst case a round
settles one more segment of a key. The rows are those of one fold from the start.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.storage import written

#: Rows of a segment, about.
SEGMENT = 50_000


@dataclass(frozen=True)
class Fold:
    """begin(state, us): a step over rows of `using`, that begins at a row of this time from a state (null: nothing before) and whose
    state() says, in JSON's types, where it stands. outs: its results' names, SQL types and Arrow types."""

    using: list[str]
    begin: Callable[[list | None, int | None], Callable]
    outs: list[tuple[str, str, pa.DataType]]


def folded(df: DataFrame, fold: Fold, by: str, id: str) -> DataFrame:
    """by, id and the fold's results of rows in order of _us and id (nulls last) of each key."""
    kinds = dict(df.dtypes)
    order = [F.col(by), F.col("_us").asc_nulls_last(), F.col(id).asc_nulls_last()]
    rows = df.select(*dict.fromkeys([by, id, "_us", *fold.using]))
    segments = max(1, -(-rows.count() // SEGMENT))
    placed = written(rows.repartitionByRange(segments, *order).withColumn("segment", F.spark_partition_id()), "fold-rows")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (by, id)] + [f"{n} {kind}" for n, kind, _ in fold.outs] + [f"segment int, first_key {kinds[by]}, begun string, ended string"])
    alone = placed.groupBy("segment").applyInArrow(lambda rows: _run(fold, by, id, rows, None), schema)
    done, tables = None, []
    while True:
        made = written(alone, "fold")
        tables.append(made)
        ends = made.filter("ended IS NOT NULL").select("segment", "first_key", F.col(by).alias("last_key"), "begun", "ended", F.lit(len(tables) - 1).alias("round"))
        done = written(ends if done is None else done.join(ends.select("segment"), "segment", "left_anti").unionByName(ends), "fold-ends")
        before = done.select((F.col("segment") + 1).alias("segment"), F.col("last_key").alias("first_key"), F.col("ended").alias("state"))
        met = done.alias("d").join(before.alias("b"), (F.col("d.segment") == F.col("b.segment")) & F.col("d.first_key").eqNullSafe(F.col("b.first_key")))
        again = written(met.filter(~F.col("d.begun").eqNullSafe(F.col("b.state"))).select("d.segment", "b.state"), "fold-again")
        if not again.head(1):
            break
        parts = placed.join(again.select("segment"), "segment", "left_semi").groupBy("segment")
        alone = parts.cogroup(again.groupBy("segment")).applyInArrow(lambda rows, state: _run(fold, by, id, rows, state["state"][0].as_py()), schema)
    columns = [by, id, *[n for n, _, _ in fold.outs]]
    out = None
    for i, made in enumerate(tables):
        part = made.select("segment", *columns) if len(tables) == 1 else made.select("segment", *columns).join(done.filter(F.col("round") == i).select("segment"), "segment", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out.drop("segment")


def _run(fold: Fold, by: str, id: str, rows: pa.Table, state: str | None) -> pa.Table:
    """A segment's rows; the last one also says how the segment began and ended."""
    rows = rows.append_column("_known", pc.is_valid(rows[by]))  # a null key stands first, as ranges have it
    rows = rows.take(pc.sort_indices(rows, [("_known", "ascending"), (by, "ascending"), ("_us", "ascending"), (id, "ascending")], null_placement="at_end"))
    keys, times = rows[by].to_pylist(), rows["_us"].to_pylist()
    values = zip(*[[float("nan") if x is None else x for x in rows[c].to_pylist()] for c in fold.using], strict=True)
    step, made = None, []
    for i, value in enumerate(values):
        if step is None or keys[i] != keys[i - 1]:
            step = fold.begin(json.loads(state) if state and not i else None, times[i])
        made.append(step(*value))
    last = len(keys) - 1
    only = lambda value: [value if i == last else None for i in range(last + 1)]
    columns = [rows[by], rows[id], *[pa.array([m[i] for m in made], t) for i, (_, _, t) in enumerate(fold.outs)], rows["segment"]]
    columns += [rows[by].take(pa.array([0 if i == last else None for i in range(last + 1)], pa.int64())), pa.array(only(state), pa.string()), pa.array(only(json.dumps(step.state())), pa.string())]
    return pa.table(columns, names=[by, id, *[n for n, _, _ in fold.outs], "segment", "first_key", "begun", "ended"])
