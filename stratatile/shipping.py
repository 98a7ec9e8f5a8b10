"""Give the executors' Python workers this package.

Functions that run in workers are pickled by reference, so workers must be able
to import them. A zip of the package goes out with SparkContext.addPyFile once
for each context; where the package is installed anyway, nothing changes.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_stratatile_shipped", False):
        return
    home = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp()) / "stratatile.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(made))
    context._stratatile_shipped = True
