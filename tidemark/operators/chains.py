"""Greedy choices in order, as scans of sorted partitions with a small carried state.

Whether a row is kept depends on which rows were kept before it, which no window or join expresses. Rows are therefore sorted by
group and order, and each task walks them in Arrow batches with numpy: nothing is gathered in a list per group.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERA_DAYS = 8192  # a group of any length is cut here, and so never in one task; one (group, era) has at most so many days
FOREVER = 1 << 40


def _breaks(batch, names: Sequence[str]):
    """True for each row but the first where a key differs from the row before; nulls equal nulls."""
    import numpy as np
    import pyarrow.compute as pc

    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, max(batch.num_rows - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def _whole(batches, names: Sequence[str]) -> Iterator:
    """Batches that end where a group ends, each with the number of every row's group in it."""
    import numpy as np
    import pyarrow as pa

    kept = []

    def close():
        batch = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        return batch, np.concatenate([[0], np.cumsum(_breaks(batch, names))])

    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in kept[-1:]), batch.slice(0)]).combine_chunks().to_batches()[0]
        ends = np.flatnonzero(_breaks(both, names)) + (0 if kept else 1)  # rows of this batch before the last group begins
        if len(ends):
            kept.append(batch.slice(0, int(ends[-1])))
            kept = [b for b in kept if b.num_rows]
            if kept:
                yield close()
            kept = []
            batch = batch.slice(int(ends[-1]))
        kept.append(batch)
    if kept:
        yield close()


def _successors(group, d, x, inclusive: bool):
    """Per row the first later row of its group whose day is free again, or -1."""
    import numpy as np

    place = group * FOREVER + d
    after = np.searchsorted(place, group * FOREVER + np.minimum(x, FOREVER // 2) + (1 if inclusive else 0))
    after = np.maximum(after, np.arange(len(d)) + 1)
    inside = after < len(d)
    inside[inside] = group[after[inside]] == group[inside]
    return np.where(inside, after, -1), place


def _equal(names: Sequence[str], prefix: str):
    """Null-safe equality of each column and its prefixed twin."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names])


def free_chain(rows: DataFrame, group: Sequence[str], inclusive: bool) -> DataFrame:
    """Rows (group, d, exit_d, ...), one per group and day, that a walk in the order of ``d`` takes when it skips all rows up to the
    exit of the one it took last (on that day too, unless ``inclusive`` is false). A row without exit blocks all later ones.

    Groups are cut into eras. Every era first tells for which carried exits it would leave with which exit; these few steps are
    combined in the order of the eras, and a second scan starts each era with the exit that reaches it.
    """
    import numpy as np
    import pyarrow as pa

    group, columns = list(group), rows.columns
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    rows = rows.withColumns({"_era": F.floor(day(F.col("d")) / ERA_DAYS), "_d": day(F.col("d")), "_x": F.coalesce(day(F.col("exit_d")), F.lit(FOREVER // 2))})
    cut = [*group, "_era"]
    keys = ", ".join(f"`{c}` {t}" for c, t in rows.select(*cut).dtypes)

    def steps(batches):
        for batch, no in _whole(batches, cut):
            d, x = (batch.column(c).to_numpy() for c in ("_d", "_x"))
            after, _ = _successors(no, d, x, inclusive)
            last = np.where(after >= 0, after, np.arange(len(d)))
            while True:  # pointers jump to the pointers of their pointers until all are at the end of their chain
                jumped = last[last]
                if (jumped == last).all():
                    break
                last = jumped
            leave = x[last]
            run_end = np.append((no[1:] != no[:-1]) | (leave[1:] != leave[:-1]), True)
            first = np.flatnonzero(np.append(True, no[1:] != no[:-1]))
            at = np.flatnonzero(run_end)
            offsets = pa.array(np.append(np.searchsorted(at, first), len(at)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[at])) for v in (d, leave)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in cut), *lists], [*cut, "_upto", "_leave"])

    # Most groups lie within one era and need no steps.
    long = rows.groupBy(*group).agg(F.min("_era").alias("_first"), F.max("_era").alias("_last")).where(F.col("_first") < F.col("_last"))
    long = long.select(*[F.col(c).alias(f"_l_{c}") for c in group])
    some = rows.join(long, _equal(group, "_l_"), "left_semi").repartition(*cut)
    told = some.sortWithinPartitions(*cut, "_d").select(*cut, "_d", "_x").mapInArrow(steps, f"{keys}, _upto array<long>, _leave array<long>")
    eras = told.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_era", "_upto", "_leave"))).alias("_eras")).where(F.size("_eras") > 1)

    def carry(state, era):
        free = F.transform(F.arrays_zip(era["_upto"], era["_leave"]), lambda s: s)
        hit = F.filter(free, lambda s: s["_upto"] > state["x"] if inclusive else s["_upto"] >= state["x"])
        out = F.concat(state["out"], F.array(F.struct(era["_era"].alias("_era"), state["x"].alias("_in"))))
        return F.struct(F.coalesce(F.try_element_at(hit, F.lit(1))["_leave"], state["x"]).alias("x"), out.alias("out"))

    start = F.struct(F.lit(-FOREVER).alias("x"), F.array().cast("array<struct<_era:bigint,_in:bigint>>").alias("out"))
    carried = eras.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.explode(F.aggregate("_eras", start, carry)["out"]).alias("_c")).select(
        *[f"_g_{c}" for c in group], F.col("_c._era").alias("_g__era"), F.col("_c._in").alias("_in"))
    entered = rows.join(carried, _equal(cut, "_g_"), "left").select(*rows.columns, F.coalesce("_in", F.lit(-FOREVER)).alias("_in"))

    def walk(batches):
        for batch, no in _whole(batches, cut):
            d, x, given = (batch.column(c).to_numpy() for c in ("_d", "_x", "_in"))
            after, place = _successors(no, d, x, inclusive)
            first = np.flatnonzero(np.append(True, no[1:] != no[:-1]))
            at = np.searchsorted(place, no[first] * FOREVER + np.maximum(given[first] + (1 if inclusive else 0), d[first]))
            at = at[(at < len(d)) & (no[np.minimum(at, len(d) - 1)] == no[first])]
            taken = np.zeros(len(d), bool)
            while len(at):  # one step of all groups at once
                taken[at] = True
                at = after[at]
                at = at[at >= 0]
            yield batch.filter(pa.array(taken)).select(columns)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes)
    return entered.repartition(*cut).sortWithinPartitions(*cut, "_d").mapInArrow(walk, schema)


def free_windows(spans: DataFrame, group: Sequence[str], id_col: str) -> DataFrame:
    """Ids of the rows (group, start_d, end_d, order columns ``ts`` and id) kept by taking windows newest first and skipping those that
    overlap a kept one.

    Only windows that hang together by overlaps can shut each other out: such components are found by a running
    maximum and dealt apart. The walk holds the kept windows of a component, which are disjoint, and looks up the neighbour of each new one.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    line = Window.partitionBy(*group).orderBy("start_d", "end_d")
    reach = F.max("end_d").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start_d") > reach).cast("long"), F.lit(1))
    parts = spans.withColumn("_opens", opens).withColumn("_part", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    cut = [*group, "_part"]
    rows = parts.select(*cut, "ts", F.col(id_col).alias("_id"), F.unix_date("start_d").alias("_a"), F.unix_date("end_d").alias("_b"))
    ordered = rows.repartition(*cut).sortWithinPartitions(*cut, F.col("ts").desc(), F.col("_id").desc()).drop("ts")

    def walk(batches):
        last, starts, ends = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, keys = batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), [batch.column(c).slice(0, 1)[0].as_py() for c in cut]
            new = [keys != last, *_breaks(batch, cut).tolist()]
            taken = []
            for fresh, lo, hi in zip(new, a, b):
                if fresh:
                    starts, ends = [], []
                at = bisect_right(starts, hi)
                free = at == 0 or ends[at - 1] < lo
                if free:
                    starts.insert(at, lo)
                    ends.insert(at, hi)
                taken.append(free)
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in cut]
            yield pa.RecordBatch.from_arrays([batch.column("_id").filter(pa.array(taken))], ["_id"])

    return ordered.mapInArrow(walk, f"_id {dict(rows.dtypes)['_id']}").withColumnRenamed("_id", id_col)
