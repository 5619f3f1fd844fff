"""Binary vector tiles as tables of polygons in degrees."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public format: fields of a tile, a layer and a feature, geometry commands, the type of polygons.
LAYERS = 3
NAME, FEATURES, EXTENT = 1, 2, 5
TYPE, GEOMETRY = 3, 4
MOVE, LINE, CLOSE = 1, 2, 7
POLYGON = 3
DEFAULT_EXTENT = 4096


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message: whole numbers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown kind of field {kind}")
        if at > len(data):
            raise ValueError("a field is cut off")
        yield key >> 3, value


def rings(commands: memoryview) -> list[list[tuple[int, int]]]:
    """The closed rings of a geometry in tile units, without their repeated first point."""
    out, ring, x, y, at = [], [], 0, 0, 0
    signed = lambda v: v >> 1 ^ -(v & 1)
    while at < len(commands):
        command, at = varint(commands, at)
        kind, count = command & 7, command >> 3
        if kind == CLOSE:
            out.append(ring)
            ring = []
            continue
        if kind not in (MOVE, LINE):
            raise ValueError(f"unknown command {kind}")
        for _ in range(count):
            dx, at = varint(commands, at)
            dy, at = varint(commands, at)
            x, y = x + signed(dx), y + signed(dy)
            ring = [(x, y)] if kind == MOVE else [*ring, (x, y)]
    return out


def polygons(payload: bytes, layer: str) -> tuple[int, list[list[list[tuple[int, int]]]]]:
    """The extent and the polygons of a layer. By the format's winding a ring of positive area (y down) opens a polygon, others are holes of the one before."""
    extent, found = DEFAULT_EXTENT, []
    for number, value in fields(memoryview(payload)):
        if number != LAYERS:
            continue
        parts = [*fields(value)]
        if bytes(dict(parts).get(NAME, b"")).decode() != layer:
            continue
        extent = dict(parts).get(EXTENT, DEFAULT_EXTENT)
        for feature in (v for n, v in parts if n == FEATURES):
            own = dict(fields(feature))
            if own.get(TYPE) != POLYGON or GEOMETRY not in own:
                continue
            mine: list[list[list[tuple[int, int]]]] = []
            for ring in rings(own[GEOMETRY]):
                area = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))
                if area > 0:
                    mine.append([ring])
                elif area < 0 and mine:
                    mine[-1].append(ring)
            found += mine
    return extent, found


def decoded(tiles: DataFrame, layer: str = "water") -> DataFrame:
    """tiles (z, x, y, payload) as z, x, y, parts (polygons of rings of [lon, lat]), problem.

    A tile without the layer has no polygons; a null payload or one that can't be read has null parts and says why.
    """

    @F.pandas_udf("parts array<array<array<array<double>>>>, problem string")
    def read(z: pd.Series, x: pd.Series, y: pd.Series, payload: pd.Series) -> pd.DataFrame:
        out = []
        for zoom, column, row, data in zip(z, x, y, payload, strict=True):
            if data is None:
                out.append((None, "no payload"))
                continue
            try:
                extent, found = polygons(bytes(data), layer)
            except (ValueError, struct.error, UnicodeDecodeError, TypeError) as e:
                out.append((None, str(e)))
                continue
            n = 2.0**zoom
            place = lambda p: [(column + p[0] / extent) / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (row + p[1] / extent) / n))))]  # noqa: B023, E731
            out.append(([[[place(p) for p in ring] for ring in rings_] for rings_ in found], None))
        return pd.DataFrame(out, columns=["parts", "problem"])

    return tiles.withColumn("_read", read("z", "x", "y", "payload")).select("z", "x", "y", "_read.parts", "_read.problem")
