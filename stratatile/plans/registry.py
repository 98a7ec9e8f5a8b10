"""Schemas by name, from entry points of the group ``stratatile.schemas``.

A package offers a schema, or a class of them, under the schema's own name. The
schemas that come with this package are entry points like any other; they are
listed here too, so that a checkout that isn't installed has them.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from importlib.metadata import EntryPoint, entry_points

from .schema import TileSchema

GROUP = "stratatile.schemas"
SHIPPED = tuple(EntryPoint(name, f"stratatile.plans.schema:{kind}", GROUP) for name, kind in (("openmaptiles", "OpenMapTiles"), ("protomaps", "Protomaps")))


@cache
def catalogue() -> dict[str, EntryPoint]:
    """The entry point of each name; ValueError with all names that several packages offer."""
    offers: dict[str, dict[str, EntryPoint]] = defaultdict(dict)
    for point in (*SHIPPED, *entry_points(group=GROUP)):
        offers[point.name].setdefault(point.value, point)  # a point that is listed twice is one
    if clashes := [f"{name} ({', '.join(sorted(of))})" for name, of in sorted(offers.items()) if len(of) > 1]:
        raise ValueError(f"more than one package offers the schema {'; '.join(clashes)}: uninstall all but one")
    return {name: next(iter(of.values())) for name, of in sorted(offers.items())}


def schema_names() -> list[str]:
    return list(catalogue())


@cache
def schema(name: str) -> TileSchema:
    try:
        loaded = catalogue()[name].load()
    except KeyError:
        raise ValueError(f"no schema {name!r} is installed; installed are {', '.join(catalogue())}") from None
    made = loaded() if isinstance(loaded, type) else loaded
    if made.name != name:
        raise ValueError(f"the entry point {name!r} leads to a schema that has the name {made.name!r}")
    return made
