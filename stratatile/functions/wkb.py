"""Well-known binary to and from plain coordinates (lists of (x, y))."""

from __future__ import annotations

import struct
from typing import Any

KINDS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
NAMES = {v: k for k, v in KINDS.items()}


def _points(points: Any) -> bytes:
    flat = [v for p in points for v in p]
    return struct.pack(f"<I{len(flat)}d", len(points), *flat)


def dump(kind: str, coordinates: Any) -> bytes:
    head = struct.pack("<BI", 1, KINDS[kind])
    if kind == "Point":
        return head + struct.pack("<2d", *coordinates)
    if kind == "LineString":
        return head + _points(coordinates)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(_points, coordinates))
    part = kind.removeprefix("Multi")
    if kind == "GeometryCollection":
        return head + struct.pack("<I", len(coordinates)) + b"".join(dump(k, c) for k, c in coordinates)
    return head + struct.pack("<I", len(coordinates)) + b"".join(dump(part, c) for c in coordinates)


def load(data: bytes) -> tuple[str, Any]:
    kind, coordinates, _ = _load(data, 0)
    return kind, coordinates


def _load(data: bytes, at: int) -> tuple[str, Any, int]:
    order = "<" if data[at] else ">"
    code = struct.unpack_from(f"{order}I", data, at + 1)[0]
    kind, at = NAMES[code & 0xFF], at + 5

    def points(at: int) -> tuple[list[tuple[float, float]], int]:
        n = struct.unpack_from(f"{order}I", data, at)[0]
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
        return list(zip(flat[::2], flat[1::2], strict=True)), at + 4 + 16 * n

    if kind == "Point":
        return kind, struct.unpack_from(f"{order}2d", data, at), at + 16
    if kind == "LineString":
        line, at = points(at)
        return kind, line, at
    n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
    parts: list[Any] = []
    for _ in range(n):
        if kind == "Polygon":
            part, at = points(at)
        else:
            name, part, at = _load(data, at)
            part = (name, part) if kind == "GeometryCollection" else part
        parts.append(part)
    return kind, parts, at
