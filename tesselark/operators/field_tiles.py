"""Fields on large grids as tables of tiles.

A field too large for one array column is stored as tiles of ``tile`` cells a side, which overlap by one node, so that every cell's corners lie in one
tile. A point joins the tile of its cell once and is interpolated within it, by the same sum as interp.n_linear. A crowded tile is a long key of an
equi-join, which adaptive execution splits. Nothing is broadcast by this code or comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselark.functions.interp import Axis
from tesselark.storage import cut

#: Cells along a tile's side by the number of axes: a tile holds a few thousand values.
CELLS = {1: 4096, 2: 64, 3: 16}


@dataclass(frozen=True)
class TiledField:
    """tiles: t0, t1, .., values ((tile + 1) ^ axes of them, the first axis fastest; null where the grid has no node)."""

    tiles: DataFrame
    axes: tuple[Axis, ...]
    tile: int

    @property
    def keys(self) -> list[str]:
        return [f"t{k}" for k in range(len(self.axes))]


def tiled(nodes: DataFrame, axes: Sequence[Axis], value: str = "f", tile: int | None = None) -> TiledField:
    """nodes: i0, i1, .. (place along each axis, unique together) and the value; nodes that are not there have no value."""
    size = tile or CELLS[len(axes)]
    rows = nodes.select(*(F.col(f"i{k}").cast("long").alias(f"i{k}") for k in range(len(axes))), F.col(value).cast("double").alias("_f"))
    for k in range(len(axes)):
        own = F.expr(f"i{k} div {size}")
        # a node on a border is also the last one of the tile before
        rows = rows.withColumn(f"t{k}", F.explode(F.when((F.col(f"i{k}") % size == 0) & (F.col(f"i{k}") > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    place, stride = F.lit(0).cast("long"), 1
    for k in range(len(axes)):
        place, stride = place + (F.col(f"i{k}") - F.col(f"t{k}") * size) * stride, stride * (size + 1)
    keys = [f"t{k}" for k in range(len(axes))]
    entry = F.struct(place.cast("int").alias("k"), F.col("_f").alias("v"))
    grouped = cut(rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e")))  # bounded by the tile's size
    whole = grouped.where(F.size("e") == stride).select(*keys, F.transform("e", lambda x: x["v"]).alias("values"))
    # tiles at the grid's end, and others with nodes that are not there, get a null for each
    part = grouped.where(F.size("e") != stride)
    every = part.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("k")).join(part.select(*keys, F.inline("e")), [*keys, "k"], "left")
    filled = every.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("values"))
    return TiledField(cut(whole.unionByName(filled)), tuple(axes), size)


def interpolated(points: DataFrame, field: TiledField, pos: Sequence[Column], name: str = "value") -> DataFrame:
    """points with the field at pos; null where the field has no tile, a corner no value, or a position is null."""
    cells = [axis.cell(v.cast("double")) for axis, v in zip(field.axes, pos, strict=True)]
    rows = points
    for k, (low, share) in enumerate(cells):
        rows = rows.withColumns({f"_low{k}": low.cast("long"), f"_share{k}": share}).withColumn(f"_t{k}", F.expr(f"_low{k} div {field.tile}"))
    tiles = field.tiles.select(*(F.col(t).alias(f"_{t}") for t in field.keys), F.col("values").alias("_values"))
    rows = rows.join(tiles, [f"_{t}" for t in field.keys], "left")
    total = None
    for corner in product(*((0, 1) if axis.n > 1 else (0,) for axis in field.axes)):
        at, weight, stride = F.lit(0).cast("long"), F.lit(1.0), 1
        for k, (upper, axis) in enumerate(zip(corner, field.axes, strict=True)):
            at = at + (F.col(f"_low{k}") - F.col(f"_t{k}") * field.tile + upper) * stride
            weight = weight * ((F.col(f"_share{k}") if upper else 1 - F.col(f"_share{k}")) if axis.n > 1 else 1)
            stride *= field.tile + 1
        term = F.get("_values", at.cast("int")) * weight
        total = term if total is None else total + term
    return rows.select(*(F.col(c) for c in points.columns), total.alias(name))
