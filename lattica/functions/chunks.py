"""Chunks: cells of a regular 3-D grid, named by one packed number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinates are 16-bit: x in bits 0-15, y in 16-31, z in 32-47, each as two's complement.
BITS = 16


def chunk_id(cx: Column, cy: Column, cz: Column) -> Column:
    """The packed number of integer chunk coordinates in [-32768, 32767]; raises beyond that range."""
    low = (1 << BITS) - 1
    fits = [F.abs(c.cast("long") * 2 + 1) <= low for c in (cx, cy, cz)]
    packed = sum((F.shiftleft(c.cast("long").bitwiseAND(low), BITS * i) for i, c in enumerate((cy, cz), 1)), cx.cast("long").bitwiseAND(low))
    return F.when(fits[0] & fits[1] & fits[2], packed).otherwise(F.raise_error(F.lit("chunk coordinates exceed 16 bits")).cast("long"))


def chunk_coordinates(cid: Column) -> list[Column]:
    """cx, cy and cz of a packed number."""
    raw = [F.shiftright(cid, BITS * i).bitwiseAND((1 << BITS) - 1) for i in range(3)]
    return [(r - F.when(r >= 1 << (BITS - 1), 1 << BITS).otherwise(0)).cast("int") for r in raw]


def grid_cell(x: Column, size: float) -> Column:
    """floor(x / size)."""
    return F.floor(x / F.lit(float(size)))


def chunk_of(x: Column, y: Column, z: Column, size: float | tuple[float, float, float]) -> Column:
    """The chunk that a point lies in."""
    size = size if isinstance(size, tuple) else (size,) * 3
    return chunk_id(*(grid_cell(c, s) for c, s in zip((x, y, z), size, strict=True)))


def chunk_box(cid: Column, size: float) -> tuple[list[Column], list[Column]]:
    """The low and the high corner."""
    at = chunk_coordinates(cid)
    return [c * F.lit(float(size)) for c in at], [(c + 1) * F.lit(float(size)) for c in at]


def curve(*chunks: Column) -> Column:
    """The place of one or two chunks together on a Z-order curve, as text that sorts along it: a letter a bit of all coordinates.

    What is near on the curve is mostly near in every coordinate, so a file that holds a stretch of it has narrow
    bounds on each, whichever of the chunks is asked for.
    """
    at = [c + (1 << (BITS - 1)) for chunk in chunks for c in chunk_coordinates(chunk)]
    digit = lambda bit: sum((F.shiftleft(F.shiftright(c, bit).bitwiseAND(1), i) for i, c in enumerate(at)), F.lit(48))
    return F.concat(*(F.char(digit(bit).cast("long")) for bit in reversed(range(BITS))))
