"""Hilbert tile ids as column expressions.

Ids count the tiles of all lower zooms first, then follow the Hilbert curve.
All functions stay in the JVM; zooms go up to 30, so ids fit a BIGINT. The
curve is walked by look-ups in a table of a few bits at a time, which compile
into the stage's code, as a fold over the bits would not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 30
#: Bits of x and of y that one look-up takes; they divide MAX_ZOOM.
STEP_BITS = 5


def first_id(zoom: Column | int) -> Column:
    """Id of the first tile of a zoom: (4**zoom - 1) / 3."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.call_function("div", F.call_function("shiftleft", F.lit(1).cast("long"), (z * 2).cast("int")) - 1, F.lit(3).cast("long"))


def zoom_bounds(min_zoom: int, max_zoom: int) -> tuple[int, int]:
    """Half-open id range [start, limit) of a range of zooms."""
    return (4**min_zoom - 1) // 3, (4 ** (max_zoom + 1) - 1) // 3


def zoom_of(tile_id: Column) -> Column:
    """Zoom of an id: half the number of bits of 3 * id + 1, rounded down."""
    return F.floor((F.length(F.bin(tile_id * 3 + 1)) - 1) / 2).cast("int")


def tile_id(zoom: Column, x: Column, y: Column) -> Column:
    """Id of tile zoom/x/y: the curve from the highest bits of x and y, STEP_BITS of each at a time."""
    table, state, place = F.lit(_TO_CURVE), _start(zoom), F.lit(0).cast("long")
    for low in _SHIFTS:
        found = _look_up(table, state, _bits(x, low, STEP_BITS) * (1 << STEP_BITS) + _bits(y, low, STEP_BITS))
        state = _state(found)
        place = place + F.shiftleft(_rest(found).cast("long"), 2 * low)
    return first_id(zoom) + place


def tile_zxy(tile: Column) -> Column:
    """struct(z, x, y) of an id: the same steps with the table turned round."""
    zoom = zoom_of(tile)
    table, state, place = F.lit(_FROM_CURVE), _start(zoom), tile - first_id(zoom)
    x = y = F.lit(0).cast("long")
    for low in _SHIFTS:
        found = _look_up(table, state, _bits(place, 2 * low, 2 * STEP_BITS))
        state, cell = _state(found), _rest(found)
        x = x + F.shiftleft(F.shiftright(cell, STEP_BITS).cast("long"), low)
        y = y + F.shiftleft(cell.bitwiseAND(F.lit((1 << STEP_BITS) - 1)).cast("long"), low)
    return F.struct(zoom.alias("z"), x.alias("x"), y.alias("y"))


def _curve_tables() -> tuple[np.ndarray, np.ndarray]:
    """(state, bits of x, bits of y) -> (state after, bits of the place on the curve), and the way back.

    A state says how the square at hand lies: whether x and y are swapped (1)
    and whether both run backwards (2). It is the table's upper index, and the
    upper part of what the table holds.
    """
    cells = 1 << 2 * STEP_BITS
    there, back = np.zeros(4 * cells, np.int32), np.zeros(4 * cells, np.int32)
    for state in range(4):
        for cell in range(cells):
            swapped, backwards = state & 1, state >> 1
            place = 0
            for b in reversed(range(STEP_BITS)):
                rx, ry = cell >> STEP_BITS + b & 1 ^ backwards, cell >> b & 1 ^ backwards
                if swapped:
                    rx, ry = ry, rx
                place = place << 2 | 3 * rx ^ ry
                if not ry:
                    swapped, backwards = swapped ^ 1, backwards ^ rx
            after = (backwards << 1 | swapped) * cells
            there[state * cells + cell] = after + place
            back[state * cells + place] = after + cell
    return there, back


_TO_CURVE, _FROM_CURVE = _curve_tables()
#: Lowest bit of each step, over all bits that the highest zoom has.
_SHIFTS = range(MAX_ZOOM - STEP_BITS, -1, -STEP_BITS)


def _start(zoom: Column) -> Column:
    """State at the highest of MAX_ZOOM bits: each bit that the zoom lacks is zero and swaps once."""
    return (F.lit(MAX_ZOOM) - zoom.cast("int")).bitwiseAND(F.lit(1))


def _bits(value: Column, low: int, count: int) -> Column:
    return F.shiftright(value.cast("long"), low).bitwiseAND(F.lit((1 << count) - 1).cast("long")).cast("int")


def _look_up(table: Column, state: Column, index: Column) -> Column:
    return F.get(table, state * (1 << 2 * STEP_BITS) + index)


def _state(found: Column) -> Column:
    return F.shiftright(found, 2 * STEP_BITS)


def _rest(found: Column) -> Column:
    return found.bitwiseAND(F.lit((1 << 2 * STEP_BITS) - 1))


def describe(tile: Column, run_length: Column) -> Column:
    """How messages name a run: ``tile z/x/y``, with its length if it is more than one tile."""
    t = tile_zxy(tile)
    name = F.format_string("tile %d/%d/%d", t["z"], t["x"], t["y"])
    return F.when(run_length == 1, name).otherwise(F.concat(name, F.format_string(" (run of %d tiles)", run_length)))


def zxy_of(tile: int) -> tuple[int, int, int]:
    """The same for one Python integer, for messages of the driver and of workers."""
    zoom = ((3 * tile + 1).bit_length() - 1) // 2
    d, x, y = tile - (4**zoom - 1) // 3, 0, 0
    for b in range(zoom):
        rx = d >> 1 & 1
        ry = (d ^ rx) & 1
        if not ry:
            if rx:
                x, y = (1 << b) - 1 - x, (1 << b) - 1 - y
            x, y = y, x
        x, y, d = x + (rx << b), y + (ry << b), d >> 2
    return zoom, x, y


def describe_one(tile: int, run_length: int = 1) -> str:
    return "tile {}/{}/{}".format(*zxy_of(tile)) + (f" (run of {run_length} tiles)" if run_length > 1 else "")
