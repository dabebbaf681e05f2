"""Interpolation on structured grids and within elements as Column expressions.

Grid data is one array column (a literal, a broadcast row or a column of the row itself): data[(i + j nx + k nx ny) n_comp + comp].
At the high edge the value of the last node is carried on (the stated intent of the clamp) and low positions use cell 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselark.functions.scalar import dot


@dataclass(frozen=True)
class Axis:
    """Evenly spaced nodes of a grid along one axis. held: beyond the last node its value stays; else the last cell's line goes on."""

    start: float
    step: float
    n: int
    held: bool = False

    @classmethod
    def of(cls, nodes: Sequence[float], held: bool = False) -> Axis:
        return cls(float(nodes[0]), float(nodes[1] - nodes[0]) if len(nodes) > 1 else 1.0, len(nodes), held)

    def cell(self, v: Column) -> tuple[Column, Column]:
        """Lower node of v's cell (0 below the grid, the last cell above it), and how far v is through it."""
        if self.n <= 1:
            return F.lit(0), F.lit(0.0)
        way = (v - self.start) / self.step
        low = F.greatest(F.lit(0), F.least(F.floor(way), F.lit(self.n - 2))).cast("int")
        share = way - low
        return low, F.least(share, F.lit(1.0)) if self.held else share


def n_linear(data: Column, axes: Sequence[Axis], pos: Sequence[Column], n_comp: int = 1, comp: int = 0) -> Column:
    """The field at pos on a grid of any number of axes, the first running fastest: the sum over the cell's corners of their
    values, each weighted by its share along every axis. An axis of one node does not count."""
    cells = [axis.cell(v) for axis, v in zip(axes, pos, strict=True)]
    total = None
    for corner in product(*((0, 1) if axis.n > 1 else (0,) for axis in axes)):
        at, weight, stride = F.lit(comp), F.lit(1.0), n_comp
        for upper, axis, (low, share) in zip(corner, axes, cells, strict=True):
            at, weight, stride = at + (low + upper) * stride, weight * ((share if upper else 1 - share) if axis.n > 1 else 1), stride * axis.n
        term = F.get(data, at.cast("int")) * weight
        total = term if total is None else total + term
    return total


def lerp(d1: Column, d2: Column, grid1: Column, grid2: Column, v: Column, dv: Column) -> Column:
    """The value at v on the line through (grid1, d1) and (grid2, d2), dv apart."""
    share = (v - grid1) / dv
    return d1 + (d2 - d1) * share


def lerp_grid(data: Column, di: Column, grid: Column, gi: Column, v: Column, dv: Column) -> Column:
    """lerp between neighbours di and di + 1 of data, whose nodes are gi and gi + 1 of grid."""
    pair = [[F.get(x, i + k) for k in (0, 1)] for x, i in ((data, di), (grid, gi))]
    return lerp(*pair[0], *pair[1], v, dv)


def radius(x: Column, y: Column, cylindrical: bool) -> Column:
    return F.sqrt(x * x + y * y) if cylindrical else x


def bilinear(data: Column, x0: float, z0: float, dx: float, dz: float, nx: int, nz: int, pos: Sequence[Column], cylindrical: bool = True, n_comp: int = 1, comp: int = 0) -> Column:
    """Field at (r or x, z) on a uniform grid."""
    return n_linear(data, [Axis(x0, dx, nx, True), Axis(z0, dz, nz, True)], [radius(pos[0], pos[1], cylindrical), pos[2]], n_comp, comp)


def bilinear_on_grid(data: Column, grid_x: Sequence[float], grid_z: Sequence[float], pos: Sequence[Column], cylindrical: bool = True, n_comp: int = 1, comp: int = 0) -> Column:
    """As bilinear, on node arrays of even spacing. With one node along an axis the field is its first value everywhere."""
    if len(grid_x) <= 1 or len(grid_z) <= 1:
        return F.get(data, F.lit(comp))
    return n_linear(data, [Axis.of(grid_x, True), Axis.of(grid_z, True)], [radius(pos[0], pos[1], cylindrical), pos[2]], n_comp, comp)


def trilinear(data: Column, grid_x: Sequence[float], grid_y: Sequence[float], grid_z: Sequence[float], pos: Sequence[Column]) -> Column:
    """Scalar field in space; a position outside uses the nearest cell; an axis of one node does not count."""
    return n_linear(data, [Axis.of(g) for g in (grid_x, grid_y, grid_z)], pos)


def rotated(field: Sequence[Column], pos: Sequence[Column]) -> list[Column]:
    """A field in cylindrical components (r, phi, z) turned into x, y, z at pos."""
    theta = F.atan2(pos[1], pos[0])
    return [F.cos(theta) * field[0] - F.sin(theta) * field[1], F.sin(theta) * field[0] + F.cos(theta) * field[1], field[2]]


def vector_2d(data: Column, x0: float, z0: float, dx: float, dz: float, nx: int, nz: int, pos: Sequence[Column], cylindrical: bool = False) -> list[Column]:
    field = [bilinear(data, x0, z0, dx, dz, nx, nz, pos, cylindrical, 3, i) for i in range(3)]
    return rotated(field, pos) if cylindrical else field


def vector_on_grid(data: Column, grid_x: Sequence[float], grid_z: Sequence[float], pos: Sequence[Column], cylindrical: bool = False) -> list[Column]:
    field = [bilinear_on_grid(data, grid_x, grid_z, pos, cylindrical, 3, i) for i in range(3)]
    return rotated(field, pos) if cylindrical and len(grid_x) > 1 and len(grid_z) > 1 else field


def in_element(values: Sequence[Column], coordinates: Sequence[Column]) -> Column:
    """A vertex field at a point with the given coordinates by vertex."""
    return dot(list(coordinates), list(values))


def vector_in_element(values: Sequence[Column], coordinates: Sequence[Column], width: int = 3) -> list[Column]:
    """Each component of array-valued vertex fields."""
    return [in_element([F.get(v, k) for v in values], coordinates) for k in range(width)]
