"""Feature sets as filters over decoded layers.

``layers`` is an array of struct(name, extent, features), in the order of the
tile; a feature is struct(geom_type, wkb, props), and a property value is
struct(tag, s, d, i, b), of which the tag names the field in use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<tag:string,s:string,d:double,i:decimal(20,0),b:boolean>"
FEATURE = f"struct<geom_type:string,wkb:binary,props:map<string,{VALUE}>>"
LAYERS = f"array<struct<name:string,extent:int,features:array<{FEATURE}>>>"

POLYGONS = ("Polygon", "MultiPolygon")
LINES = ("LineString", "MultiLineString")


def layer_features(layers: Column, name: str) -> Column:
    """Features of one layer; an empty array if the tile lacks it."""
    found = F.filter(layers, lambda x: x["name"] == name)
    return F.coalesce(F.get(found, F.lit(0))["features"], F.array().cast(f"array<{FEATURE}>"))


def text(feature: Column, key: str) -> Column:
    """A property as text, or null if it is missing or not a string."""
    return F.try_element_at(feature["props"], F.lit(key))["s"]


def number(feature: Column, key: str) -> Column:
    """A property as a number, or null if it is missing or not one."""
    value = F.try_element_at(feature["props"], F.lit(key))
    return F.coalesce(value["d"], value["i"].cast("double"))


def truthy(feature: Column, key: str) -> Column:
    """Whether a property is there and not false, zero or empty, as Python tests it."""
    value = F.try_element_at(feature["props"], F.lit(key))
    return F.coalesce(value["b"], F.coalesce(value["d"], value["i"].cast("double")) != 0, value["s"] != "", F.lit(False))


def is_not(value: Column, unwanted: str) -> Column:
    """True too where the value is missing, as plain <> is not."""
    return ~value.eqNullSafe(F.lit(unwanted))


def kept(features: Column, *conditions: Callable[[Column], Column]) -> Column:
    for condition in conditions:
        features = F.filter(features, condition)
    return features


def extent_of(layers: Column, default: int) -> Column:
    """Extent of the first layer; of a tile without layers, the default."""
    return F.coalesce(F.get(layers, F.lit(0))["extent"], F.lit(default))


def square(extent: Column, buffer_pixels: int) -> Column:
    """struct(low, high): the tile's square grown by its buffer, of a 256-pixel tile."""
    buffer = extent * buffer_pixels / 256.0
    return F.struct((-buffer).alias("low"), (extent + buffer).alias("high"))


def missing_layers(listed: Column, required: frozenset[str]) -> Column:
    """Names of required layers that aren't listed, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, sorted(required))), listed))


def fitting_schemas(listed: Column, required: dict[str, frozenset[str]]) -> Column:
    """Names of the schemas whose layers are all listed."""
    fits = [F.when(F.size(missing_layers(listed, layers)) == 0, F.lit(name)) for name, layers in sorted(required.items())]
    return F.array_compact(F.array(*fits))
