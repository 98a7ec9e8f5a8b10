"""Layer names and credits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYER_NAME = "[A-Za-z0-9][A-Za-z0-9._-]*"
SOURCE = "{source}"


def valid_layer_name(name: Column) -> Column:
    return name.rlike(f"^{LAYER_NAME}\\z")


def credited(declared: Column, template: Column) -> Column:
    """What a layer credits: the template with {source} filled in, else what is declared; null if there is nothing."""
    bare = lambda c: F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
    own = F.nullif(bare(declared), F.lit(""))
    given = F.nullif(bare(template), F.lit(""))
    filled = F.when(F.contains(given, F.lit(SOURCE)) & own.isNull(), F.lit(None)).otherwise(bare(F.replace(given, F.lit(SOURCE), F.coalesce(own, F.lit("")))))
    return F.when(given.isNull(), own).otherwise(filled)
