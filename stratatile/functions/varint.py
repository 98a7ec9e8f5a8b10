"""Variable-length integers, as PMTiles directories and vector tiles use them."""

from __future__ import annotations


def put(out: bytearray, value: int) -> None:
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)


def take(data: bytes, at: int) -> tuple[int, int]:
    """(value, position after it)."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def zigzag(value: int) -> int:
    return value << 1 if value >= 0 else (-value << 1) - 1


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)
