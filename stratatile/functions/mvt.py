"""Mapbox Vector Tiles (version 2) to and from layers of features.

A layer is {"name", "extent", "features"}; a feature is {"geom_type", "wkb",
"props"}, a property (tag, value) with the tag of its type in the tile:
string, float, double, int, uint, sint or bool, so that it is written back as
it was. Coordinates have y upwards, from 0 to the extent.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator, Sequence
from typing import Any

from . import wkb
from .varint import put, take, unzigzag, zigzag

#: Field number of each type in a tile's Value message.
VALUE_FIELDS = {"string": 1, "float": 2, "double": 3, "int": 4, "uint": 5, "sint": 6, "bool": 7}
VALUE_TAGS = {v: k for k, v in VALUE_FIELDS.items()}


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(field number, value) of a protobuf message; lengths give bytes, fixed widths bytes too."""
    at = 0
    while at < len(data):
        key, at = take(data, at)
        kind = key & 7
        if kind == 0:
            value, at = take(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = take(data, at)
            if at + size > len(data):
                raise ValueError("the tile ends inside a field")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"a tile has no fields of wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = take(data, at)
        out.append(value)
    return out


def _value(data: bytes) -> tuple[str, Any]:
    for number, raw in fields(data):
        tag = VALUE_TAGS.get(number)
        if tag == "string":
            return tag, raw.decode("utf-8")
        if tag in ("float", "double"):
            return tag, struct.unpack("<f" if tag == "float" else "<d", raw)[0]
        if tag == "int":
            return tag, raw - (1 << 64) if raw >> 63 else raw
        if tag == "sint":
            return tag, unzigzag(raw)
        if tag == "bool":
            return tag, bool(raw)
        if tag:
            return tag, raw
    return "string", ""


def _area(ring: Sequence[tuple[int, int]]) -> int:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True))


def _parts(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Point lists of the commands, in tile coordinates (y downwards)."""
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        what, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            continue
        for _ in range(count):
            x += unzigzag(commands[at])
            y += unzigzag(commands[at + 1])
            at += 2
            if what == 1:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def _geometry(kind: int, commands: list[int], extent: int) -> tuple[str, Any] | None:
    parts = _parts(commands)
    up = lambda part: [(float(x), float(extent - y)) for x, y in part]
    if not parts:
        return None
    if kind == 1:
        points = [p for part in parts for p in up(part)]
        return ("Point", points[0]) if len(points) == 1 else ("MultiPoint", points)
    if kind == 2:
        return ("LineString", up(parts[0])) if len(parts) == 1 else ("MultiLineString", list(map(up, parts)))
    if kind != 3:
        return None
    polygons: list[list] = []
    for part in parts:
        area = _area(part)
        if not area:
            continue
        ring = up(part)
        if area > 0 or not polygons:  # y downwards: an outer ring has positive area
            polygons.append([[*ring, ring[0]]])
        else:
            polygons[-1].append([*ring, ring[0]])
    if not polygons:
        return None
    return ("Polygon", polygons[0]) if len(polygons) == 1 else ("MultiPolygon", polygons)


def _layer(data: bytes) -> dict[str, Any]:
    name, extent, keys, values, raw = "", 4096, [], [], []
    for number, value in fields(data):
        if number == 1:
            name = value.decode("utf-8")
        elif number == 2:
            raw.append(value)
        elif number == 3:
            keys.append(value.decode("utf-8"))
        elif number == 4:
            values.append(_value(value))
        elif number == 5:
            extent = value
    made = []
    for message in raw:
        tags, kind, commands = [], 0, []
        for number, value in fields(message):
            if number == 2:
                tags = packed(value)
            elif number == 3:
                kind = value
            elif number == 4:
                commands = packed(value)
        shape = _geometry(kind, commands, extent)
        if shape:
            made.append({"geom_type": shape[0], "wkb": wkb.dump(*shape), "props": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}})
    return {"name": name, "extent": extent, "features": made}


def decode(payload: bytes) -> list[dict[str, Any]]:
    """Layers of a gzipped tile, in its order; an empty payload is a tile without layers."""
    data = gzip.decompress(payload) if payload else b""
    return [_layer(value) for number, value in fields(data) if number == 3]


def _message(number: int, body: bytes) -> bytes:
    out = bytearray()
    put(out, number << 3 | 2)
    put(out, len(body))
    return bytes(out) + body


def _put_value(tag: str, value: Any) -> bytes:
    if tag == "string":
        return _message(1, str(value).encode())
    out = bytearray()
    if tag in ("float", "double"):
        put(out, VALUE_FIELDS[tag] << 3 | (5 if tag == "float" else 1))
        return bytes(out) + struct.pack("<f" if tag == "float" else "<d", value)
    put(out, VALUE_FIELDS[tag] << 3)
    put(out, zigzag(int(value)) if tag == "sint" else int(value) & (1 << 64) - 1)
    return bytes(out)


def tagged(value: Any) -> tuple[str, Any] | None:
    """(tag, value) of a plain Python value; None for what a tile can't hold."""
    if isinstance(value, tuple):
        return value
    if isinstance(value, bool):
        return "bool", value
    if isinstance(value, int):
        return ("uint", value) if value >= 1 << 63 else ("int", value)
    if isinstance(value, float):
        return "double", value
    return ("string", value) if isinstance(value, str) else None


def _ints(part: Sequence[tuple[float, float]], extent: int) -> list[tuple[int, int]]:
    """Rounded tile coordinates without repeats."""
    out: list[tuple[int, int]] = []
    for x, y in part:
        p = (round(x), extent - round(y))
        if not out or p != out[-1]:
            out.append(p)
    return out


def _commands(kind: str, coordinates: Any, extent: int) -> tuple[int, list[int]]:
    """(geometry type, commands) of a geometry; no commands if nothing is left of it."""
    out: list[int] = []
    at = (0, 0)

    def run(what: int, points: Sequence[tuple[int, int]]) -> None:
        nonlocal at
        if points:
            out.append(len(points) << 3 | what)
        for x, y in points:
            out.extend((zigzag(x - at[0]), zigzag(y - at[1])))
            at = (x, y)

    if kind in ("Point", "MultiPoint"):
        run(1, [(round(x), extent - round(y)) for x, y in ([coordinates] if kind == "Point" else coordinates)])
        return 1, out
    if kind in ("LineString", "MultiLineString"):
        for line in [coordinates] if kind == "LineString" else coordinates:
            points = _ints(line, extent)
            if len(points) > 1:
                run(1, points[:1])
                run(2, points[1:])
        return 2, out
    for polygon in [coordinates] if kind == "Polygon" else coordinates:
        for i, ring in enumerate(polygon):
            points = _ints(ring, extent)
            if points and points[0] == points[-1]:
                points.pop()
            area = _area(points) if len(points) > 2 else 0
            if not area:
                if i == 0:
                    break
                continue
            if (area > 0) != (i == 0):
                points = [points[0], *points[:0:-1]]
            run(1, points[:1])
            run(2, points[1:])
            out.append(1 << 3 | 7)
    return 3, out


def _simple(kind: str, coordinates: Any) -> list[tuple[str, Any]]:
    """A collection as its members, which become features of their own."""
    if kind == "GeometryCollection":
        return [x for k, c in coordinates for x in _simple(k, c)]
    return [(kind, coordinates)]


def encode(layers: Sequence[dict[str, Any]], extent: int) -> bytes | None:
    """Gzipped tile of layers of features with ``wkb`` on the integer grid; None if no layer keeps a geometry.

    The bytes depend on the content alone (no time stamp, keys and values in
    order of first use), so equal tiles are equal bytes on every executor.
    """
    out = bytearray()
    for layer in layers:
        keys: dict[str, int] = {}
        values: dict[tuple[str, Any], int] = {}
        made = bytearray()
        for feature in layer["features"]:
            for kind, coordinates in _simple(*wkb.load(feature["wkb"])):
                code, commands = _commands(kind, coordinates, extent)
                if not commands:
                    continue
                tags, shape = bytearray(), bytearray()
                for key, value in (feature.get("props") or {}).items():
                    pair = tagged(value)
                    if pair is None or pair[1] is None:
                        continue
                    put(tags, keys.setdefault(key, len(keys)))
                    put(tags, values.setdefault(pair, len(values)))
                for c in commands:
                    put(shape, c)
                made += _message(2, (_message(2, bytes(tags)) if tags else b"") + bytes((3 << 3, code)) + _message(4, bytes(shape)))
        if made:
            size, version = bytearray(), bytearray()
            put(size, 5 << 3)
            put(size, extent)
            put(version, 15 << 3)
            put(version, 2)
            body = bytes(version) + _message(1, layer["name"].encode()) + bytes(made) + b"".join(_message(3, k.encode()) for k in keys) + b"".join(_message(4, _put_value(*v)) for v in values) + bytes(size)
            out += _message(3, body)
    return gzip.compress(bytes(out), mtime=0) if out else None
