"""What the layers of a run are called and credit, and whether the archive has what their schema reads.

All three are the column expressions of ``functions.names`` and
``operators.features``, over one row for each thing that is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import features as fs
from .schema import TileSchema


def layer_names(spark: SparkSession, given: Sequence[tuple[str, str]]) -> list[str]:
    """Names of the layers of (profile file, name); ValueError with all that are no names or not alone."""
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "place int, file string, name string")
    judged = df.groupBy("name").agg(F.min("place").alias("place"), F.array_sort(F.collect_list("file")).alias("files"), names.valid_layer_name(F.first("name")).alias("valid"))
    wrong = [f"{r['name']!r} of {', '.join(r['files'])} is no name of a layer (letters, digits, '.', '_' and '-', a letter or digit first)" if not r["valid"] else f"{', '.join(r['files'])} have the same name {r['name']!r}" for r in judged.where(~F.col("valid") | (F.size("files") > 1)).orderBy("place").collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return [name for _, name in given]


def credit(spark: SparkSession, metadata: Any, template: str | None) -> str:
    """What a layer credits, by the archive's metadata and the run config's template."""
    declared = metadata.get("attribution") if isinstance(metadata, dict) else metadata
    if not isinstance(metadata, dict) or not isinstance(declared, str | None):
        raise ValueError(f"the archive's {'attribution' if isinstance(metadata, dict) else 'metadata'} is a {type(declared).__name__}")
    text = lambda x: F.lit(x).cast("string")
    made = spark.range(1).select(names.credited(text(declared), text(template))).first()[0]
    if made is None:
        raise ValueError(f"there is nothing to credit: the archive declares no attribution{f' for {names.SOURCE}' if template else ''}; write it out in the run config")
    return made


def check_schema(spark: SparkSession, schema: TileSchema, metadata: dict, archive: str, others: Sequence[TileSchema]) -> str | None:
    """ValueError if layers that the schema reads are not among those that the archive lists; a warning if it lists none."""
    layers = metadata.get("vector_layers")
    if not isinstance(layers, list):
        return f"{archive} lists no vector_layers, so nothing tells whether it is in schema {schema.name}"
    ids = [x.get("id") if isinstance(x, dict) else None for x in layers]
    if None in ids:
        raise ValueError(f"{archive}: layer {ids.index(None)} of vector_layers has no id")
    listed = spark.createDataFrame([(list(map(str, ids)),)], "listed array<string>")
    r = listed.select(fs.missing_layers(F.col("listed"), schema.archive_layers).alias("missing"), fs.fitting_schemas(F.col("listed"), {s.name: s.archive_layers for s in others}).alias("fits")).first()
    if r["missing"]:
        raise ValueError(f"{archive} lacks {', '.join(r['missing'])}, which schema {schema.name} reads; schemas that fit: {', '.join(r['fits']) or 'none that is installed, so look for a plugin'}")
    return None
