"""Command line: ``python -m stratatile convert ARCHIVE CONFIG`` and ``setup CONFIG``.

Exit status 0, 1 if a run fails, 2 for wrong arguments or a wrong config. An
empty option counts as not given.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from .plans.config import check, count, option, read_config, zoom
from .plans.convert import convert
from .plans.install import setup

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("stratatile", description="Builds map layers from a PMTiles archive of vector tiles.")
    top.add_argument("--version", action="version", version=f"stratatile {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("convert", help="build the layers of a run config")
    build.add_argument("archive")
    build.add_argument("config")
    build.add_argument("--min-zoom", default="")
    build.add_argument("--max-zoom", default="")
    build.add_argument("--transform-processes", default="", help="tasks that run at a time on this machine; all cores by default")
    build.add_argument("-o", "--output-dir", default=".")
    build.add_argument("--overwrite", action="store_true")
    commands.add_parser("setup", help="install plugins and dependencies of a run config").add_argument("config")
    return top


def main(arguments: Sequence[str] | None = None) -> int:
    top = parser()
    given = top.parse_args(arguments)
    tasks = None
    try:
        config = read_config(given.config)
        if given.command == "convert":
            config = config.with_zooms(option(zoom, given.min_zoom, "--min-zoom"), option(zoom, given.max_zoom, "--max-zoom"))
            check(config)
            tasks = option(count, given.transform_processes, "--transform-processes")
            if not os.path.isfile(given.archive):
                raise ValueError(f"there is no file {given.archive}")
    except (OSError, ValueError) as error:
        top.error(str(error))
    try:
        if given.command == "setup":
            setup(config)
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{tasks or '*'}]").appName("stratatile").config("spark.ui.enabled", "false").getOrCreate()
        convert(spark, config, given.archive, given.output_dir or ".", tasks, given.overwrite)
    except (OSError, ValueError, RuntimeError) as error:
        print(f"stratatile {given.command}: {error}", file=sys.stderr)
        return 1
    return 0
