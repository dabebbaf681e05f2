"""Particles whose state lives in a stream: each row of the stream is a particle's next position, and what is known of the particle (element, phase, last
crossing) is carried over micro-batches in keyed state, one row a pid, by buckets of pids.

A row's element is found first, by one left join with the mesh for each grid level that the mesh has (operators/grid.py), so the mesh may be
of any size and is never part of the state. The way from the particle's last position to the new one enters the new element through the side that it meets
last; this needs only the new element's corners, which come with the row. tracked() is the same as a batch, with windows in place of state.

Rows: pid, step, the coordinates, turn. Results, a row for each: pid, step, elem_id, phase, moves, side, cx, cy[, cz], late.
* elem_id: the least element that contains the position; -1 outside the mesh or where a coordinate is null or NaN. Who was outside once has left and stays at -1.
* phase: the sum of turn so far (null counts 0), modulo period.  moves: how often the element has changed.
* side, cx, cy[, cz]: the side that was crossed last on the way into an element, and where; null before the first.
* late: the step is null or not after the particle's last one in an earlier micro-batch; such a row changes nothing and has the state's values. Within a
  micro-batch rows are taken by (step, coordinates, turn, nulls first), so repeated rows count each. Rows with a null pid are one particle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType

from tesselark.functions.geometry import barycentric_numerators_2d, barycentric_numerators_3d, tet_volume6, triangle_area2
from tesselark.operators.grid import _levels, filed_elements
from tesselark.operators.mesh import AXES, Mesh, elem_side
from tesselark.operators.part_walk import _numerators
from tesselark.operators.walk import REMOVED
from tesselark.storage import cut, small

#: Particles are dealt into so many groups by a hash of pid; as many rows of a group's state go to the store at once.
BUCKETS, STATE_ROWS = 1024, 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _corner_names(dim: int) -> list[str]:
    return [f"{a}{i}" for i in range(dim + 1) for a in AXES[:dim]]


def _numerators_of(x, p: list[Column], dim: int) -> tuple[list[Column], Column]:
    """The coordinates of p in the element x (a struct or a function of names), and their sum."""
    v = [[x[f"{a}{i}"] for a in AXES[:dim]] for i in range(dim + 1)]
    return (barycentric_numerators_2d(v, p), triangle_area2(*v)) if dim == 2 else (barycentric_numerators_3d(v, p), tet_volume6(v))


def located(rows: DataFrame, mesh: Mesh, tol: float = 1e-10) -> DataFrame:
    """rows, each once, with found: eid, corners and side ids of the least element that contains it, or null. rows may be a stream. A cell lists the
    elements of its own size that touch it; they are few unless the mesh has very flat elements."""
    dim, axes = mesh.dim, mesh.axes
    sides = elem_side(mesh).groupBy("eid").agg(*(F.max(F.when(F.col("li") == i, F.col("sid"))).alias(f"s{i}") for i in range(dim + 1)))
    filed = cut(filed_elements(mesh).join(sides, "eid"))
    entry = F.struct("eid", *(F.col(c).cast("double").alias(c) for c in _corner_names(dim)), *(f"s{i}" for i in range(dim + 1)))
    point, lists = [F.col(a).cast("double") for a in axes], []

    def within(x: Column) -> Column:
        b, whole = _numerators_of(x, point, dim)
        return F.least(*b) >= -tol * whole

    width = rows.columns
    for k, level in enumerate(_levels(filed)):
        keys = [f"_c{a}" for a in axes]
        cells = filed.where(F.col("level") == level).groupBy(*(F.col(f"c_{a}").alias(f"_c{a}") for a in axes)).agg(F.collect_list(entry).alias(f"_l{k}"))
        at = rows.withColumns({c: F.floor(p / F.pow(F.lit(2.0), F.lit(level))) for c, p in zip(keys, point, strict=True)})
        rows = at.join(small(cut(cells)), keys, "left").drop(*keys)
        lists.append(F.coalesce(F.filter(f"_l{k}", within), F.array().cast(cells.schema[f"_l{k}"].dataType)))
    if not lists:
        nothing = "struct<eid:long," + ",".join([f"{c}:double" for c in _corner_names(dim)] + [f"s{i}:long" for i in range(dim + 1)]) + ">"
        return rows.withColumn("found", F.lit(None).cast(nothing))
    known = reduce(lambda a, b: a & b, (p.isNotNull() & ~F.isnan(p) for p in point))
    return rows.withColumn("found", F.when(known, F.array_min(F.concat(*lists)))).select(*width, "found")


def _flat(rows: DataFrame, mesh: Mesh) -> DataFrame:
    """Located rows with the columns that the state reads."""
    names = ["eid", *_corner_names(mesh.dim), *(f"s{i}" for i in range(mesh.dim + 1))]
    point = [F.col(a).cast("double").alias(a) for a in mesh.axes]
    return located(rows.select("pid", F.col("step").cast("long").alias("step"), *point, F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn")), mesh).select("pid", "step", *mesh.axes, "turn", *(F.col(f"found.{n}").alias(n) for n in names))


def _key_of(pid: Column, kind: DataType) -> tuple[Column, str]:
    """A pid as a value that is never null and keeps every digit in pandas, and its type: whole numbers as long, else the text that a cast turns back."""
    key, default = ("long", 0) if isinstance(kind, IntegralType) else ("string", "")
    return F.coalesce(pid.cast(key), F.lit(default)), key


class Tracker(StatefulProcessor):
    """The state of a bucket of particles, a row each: step, position, element, phase, moves, last crossing. All rows of a bucket in a micro-batch, and its state, are
    held at once and worked on as arrays, so a call costs a bucket and not a particle; a trigger's maxFilesPerTrigger or maxBytesPerTrigger bounds the rows."""

    def __init__(self, dim: int, period: int, key_type: str):
        self.dim, self.period, self.key_type = dim, period, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        axes = AXES[: self.dim]
        fields = [f"key {self.key_type}", "none boolean", "step long", *(f"{a} double" for a in axes), "elem long", "phase long", "moves long", "side long", *(f"c{a} double" for a in axes)]
        self.state = handle.getListState("particles", ", ".join(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        dim, axes = self.dim, list(AXES[: self.dim])
        new, old = pd.concat(list(rows), ignore_index=True), list(self.state.get())
        known = list(zip(*old, strict=True)) or [()] * (2 * dim + 7)
        keys = np.concatenate([np.array(known[0], dtype=np.int64 if self.key_type == "long" else object), new["key"].to_numpy()])
        none = np.concatenate([np.array(known[1], dtype=bool), new["none"].to_numpy(dtype=bool)])
        # particles of the bucket by number, and what is known of each; a side of -1 is none
        _, where, number = np.unique(2 * pd.factorize(keys)[0] + none, return_index=True, return_inverse=True)
        mine, of = number[: len(old)], number[len(old) :]
        has, last_step, elem, phase, moves, side = (np.full(len(where), v) for v in (False, 0, REMOVED, 0, 0, -1))
        at, crossing = np.full((len(where), dim), np.nan), np.full((len(where), dim), np.nan)
        if old:
            has[mine], last_step[mine], side[mine] = True, known[2], [-1 if x is None else x for x in known[dim + 6]]
            at[mine], crossing[mine] = np.array(known[3 : dim + 3], dtype=np.float64).T, np.array(known[dim + 7 :], dtype=np.float64).T
            elem[mine], phase[mine], moves[mine] = known[dim + 3 : dim + 6]
        step, untimed = new["step"].to_numpy(), new["untimed"].to_numpy(dtype=bool)
        late = untimed | (has[of] & (step <= last_step[of]))
        told = lambda r: {"key": new["key"].to_numpy()[r], "none": new["none"].to_numpy(dtype=bool)[r], "step": pd.arrays.IntegerArray(step[r], untimed[r])}
        r = np.flatnonzero(late)
        if len(r):
            k = of[r]
            yield self._frame(told(r), elem[k], ~has[k], phase[k], moves[k], side[k], crossing[k], True)
        r = np.flatnonzero(~late)
        if not len(r):
            return
        turn = new["turn"].to_numpy(dtype=np.int64)
        r = r[np.lexsort([x[r] for x in (turn, *(new[a].to_numpy() for a in reversed(axes)), step, of)])]
        k, each = of[r], np.arange(len(r))
        first = np.concatenate([[True], k[1:] != k[:-1]])
        start, opens = np.maximum.accumulate(np.where(first, each, 0)), k[first]
        # who was outside once stays outside
        here = new["eid"].to_numpy(dtype=np.int64)[r]
        gone = np.maximum.accumulate(np.where((here == REMOVED) | (first & has[k] & (elem[k] == REMOVED)), each, -1)) >= start
        here[gone] = REMOVED
        before = np.concatenate([[REMOVED], here[:-1]])
        before[first] = elem[opens]
        changed = (here != before) & ~gone
        changed[first] &= has[opens]
        p = new[axes].to_numpy(dtype=np.float64)[r]
        origin = np.concatenate([np.full((1, dim), np.nan), p[:-1]])
        origin[first] = at[opens]
        through, met = np.full(len(r), -1, np.int64), np.full((len(r), dim), np.nan)
        if changed.any():
            corners = new[_corner_names(dim)].to_numpy(dtype=np.float64)[r[changed]].reshape(-1, dim + 1, dim)
            o, t = origin[changed], p[changed]
            b0, b1 = _numerators(corners, o, dim), _numerators(corners, t, dim)
            enters = b0 < 0
            share = np.where(enters, b0 / np.where(enters, b0 - b1, 1.0), -1.0)
            li, some, row = np.argmax(share, axis=1), enters.any(axis=1), np.arange(len(o))
            through[changed] = np.where(some, new[[f"s{i}" for i in range(dim + 1)]].to_numpy(dtype=np.int64)[r[changed]][row, li], -1)
            met[changed] = np.where(some[:, None], o + (t - o) * share[row, li][:, None], np.nan)
        # the last crossing up to each row, if the particle has one here, else the state's
        place = np.maximum.accumulate(np.where(through >= 0, each, -1))
        own = place >= start
        side_of, crossing_of = np.where(own, through[place], side[k]), np.where(own[:, None], met[place], crossing[k])
        so_far = lambda x: np.cumsum(x) - (np.cumsum(x) - x)[start]
        turns, count = (phase[k] + so_far(turn[r])) % self.period, moves[k] + so_far(changed.astype(np.int64))
        ends = np.concatenate([first[1:], [True]])
        has[opens], last_step[opens], at[opens], elem[opens], phase[opens] = True, step[r][ends], p[ends], here[ends], turns[ends]
        moves[opens], side[opens], crossing[opens] = count[ends], side_of[ends], crossing_of[ends]
        kept = [x[has] for x in (keys[where], none[where], last_step, *at.T, elem, phase, moves)]
        rows = list(zip(*(x.tolist() for x in kept), (None if x < 0 else x for x in side[has].tolist()), *(x.tolist() for x in crossing[has].T), strict=True))
        self.state.put(rows[:STATE_ROWS])
        for i in range(STATE_ROWS, len(rows), STATE_ROWS):
            self.state.appendList(rows[i : i + STATE_ROWS])
        yield self._frame(told(r), here, np.zeros(len(r), bool), turns, count, side_of, crossing_of, False)

    def _frame(self, told: dict, elem, unknown, phase, moves, side, crossing, late: bool) -> pd.DataFrame:
        whole = lambda v, gaps: pd.arrays.IntegerArray(v.astype(np.int64), gaps)
        out = told | {"elem_id": whole(elem, unknown), "phase": phase, "moves": moves, "side": whole(side, side < 0)}
        out |= {f"c{a}": pd.arrays.FloatingArray(c.copy(), np.isnan(c)) for a, c in zip(AXES, crossing.T, strict=False)}
        return pd.DataFrame(out | {"late": np.full(len(elem), late)})

    def close(self) -> None:
        pass


def track(stream: DataFrame, mesh: Mesh, period: int = 360, buckets: int = BUCKETS) -> DataFrame:
    """The stream's rows with their particles' state, for writeStream in append mode. The state store must be RocksDB (see ROCKS,
    spark.sql.streaming.stateStore.providerClass); its changes lie with the query's checkpoint, so a restarted query goes on where it stopped. buckets
    must stay the same as long as a checkpoint is used; a task holds one bucket's rows and particles at a time."""
    kind, rows = stream.schema["pid"].dataType, _flat(stream, mesh)
    key, key_type = _key_of(F.col("pid"), kind)
    # nothing that pandas would turn into doubles is null; a null coordinate comes before every number, as in tracked()
    filled = {"eid": REMOVED, "step": 0} | {a: float("-inf") for a in mesh.axes} | {f"s{i}": -1 for i in range(mesh.dim + 1)}
    rows = rows.select(
        F.pmod(F.xxhash64("pid"), F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), F.col("pid").isNull().alias("none"), F.col("step").isNull().alias("untimed"),
        *(F.coalesce(F.col(c), F.lit(filled[c])).alias(c) if c in filled else F.col(c) for c in rows.columns[1:]),
    )
    crossing = [f"c{a}" for a in mesh.axes]
    schema = f"key {key_type}, none boolean, step long, elem_id long, phase long, moves long, side long, {', '.join(f'{c} double' for c in crossing)}, late boolean"
    out = rows.groupBy("bucket").transformWithStateInPandas(Tracker(mesh.dim, period, key_type), outputStructType=schema, outputMode="append", timeMode="none")
    return out.select(F.when(~F.col("none"), F.col("key")).cast(kind).alias("pid"), "step", "elem_id", "phase", "moves", "side", *crossing, "late")


def tracked(rows: DataFrame, mesh: Mesh, period: int = 360) -> DataFrame:
    """The same of a table that is all there: windows by pid in the order of the steps. A row with a null step is late and changes nothing."""
    dim, axes = mesh.dim, mesh.axes
    flat = _flat(rows, mesh)
    order = [F.col(c).asc_nulls_first() for c in ("step", *axes, "turn")]
    by = Window.partitionBy("pid").orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = flat.where("step is not null").withColumn("_gone", F.max(F.col("eid").isNull()).over(so_far))
    timed = timed.withColumn("elem_id", F.when(F.col("_gone"), F.lit(REMOVED)).otherwise(F.col("eid")).cast("long"))
    timed = timed.withColumns({"_before": F.lag("elem_id").over(by)} | {f"_o{a}": F.lag(a).over(by) for a in axes})
    timed = timed.withColumn("_moved", F.coalesce((F.col("elem_id") != F.col("_before")) & ~F.col("_gone"), F.lit(False)))
    corner, sides = {c: F.col(c) for c in _corner_names(dim)}, range(dim + 1)
    for p in ("_o", ""):
        timed = timed.withColumns({f"_b{p}{li}": b for li, b in enumerate(_numerators_of(corner, [F.col(f"{p}{a}") for a in axes], dim)[0])})
    b0, b1 = ([F.col(f"_b{p}{li}") for li in sides] for p in ("_o", ""))
    share = [F.when(F.col("_moved") & (b0[li] < 0), b0[li] / (b0[li] - b1[li])) for li in sides]
    # greatest and array_max skip nulls: the sides that the way does not come in by
    met = [F.when(x.isNotNull(), F.struct(x.alias("share"), F.lit(-li).alias("li"), F.col(f"s{li}").alias("side"))) for li, x in enumerate(share)]
    timed = timed.withColumn("_met", F.greatest(*met))
    place = [(F.col(f"_o{a}") + (F.col(a) - F.col(f"_o{a}")) * F.col("_met.share")).alias(f"c{a}") for a in axes]
    timed = timed.withColumn("_at", F.when(F.col("_met").isNotNull(), F.struct(F.col("_met.side").alias("side"), *place)))
    timed = timed.withColumn("_at", F.last("_at", ignorenulls=True).over(so_far))
    out = timed.select("pid", "step", "elem_id", F.pmod(F.sum("turn").over(so_far), F.lit(period)).cast("long").alias("phase"), F.sum(F.col("_moved").cast("long")).over(so_far).alias("moves"), "_at.side", *(f"_at.c{a}" for a in axes), F.lit(False).alias("late"))
    nothing = {"elem_id": "long", "phase": "long", "moves": "long", "side": "long"} | {f"c{a}": "double" for a in axes}
    zero = {"phase", "moves"}
    untimed = flat.where("step is null").select("pid", "step", *(F.lit(0 if c in zero else None).cast(t).alias(c) for c, t in nothing.items()), F.lit(True).alias("late"))
    return out.unionByName(untimed)


def track_files(parts: list[DataFrame], mesh: Mesh, path: str, checkpoint: str, source: str, period: int = 360, buckets: int = BUCKETS) -> DataFrame:
    """Feeds tables one after the other through a stream that is started anew for each and goes on from its checkpoint; returns the stored rows. The
    state store's provider is set for these streams and set back."""
    spark = mesh.elem.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        rows = None
        for part in parts:
            part.write.mode("append").parquet(source)
            if rows is None:
                rows = track(spark.readStream.schema(part.schema).parquet(source), mesh, period, buckets)
            rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
    return spark.read.parquet(path)
