"""What a run says on stderr: warnings, folded groups, status lines and progress.

The form of warnings and groups is a template in an environment variable, in
which {title} and {message} are filled in; all else in it stays as it is.
"""

from __future__ import annotations

import contextlib
import os
import string
import sys
import threading
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import SparkSession

#: Seconds between two progress lines.
INTERVAL = 5.0


class Template(string.Template):
    """Fills in {title} and {message} in one pass."""

    pattern = r"\{(?:(?P<named>title|message)\}|(?P<escaped>(?!))|(?P<braced>(?!))|(?P<invalid>(?!)))"


class Console:
    """Lines on a stream; forms that the environment doesn't set have the defaults here."""

    forms = {"STRATATILE_LOG_WARNING": "warning: {title}: {message}", "STRATATILE_LOG_GROUP": "{title}:", "STRATATILE_LOG_END_GROUP": ""}

    def __init__(self, stream: TextIO | None = None) -> None:
        self.stream = stream

    def line(self, text: str) -> None:
        if text:
            print(text, file=self.stream or sys.stderr, flush=True)

    def formed(self, form: str, **values: str) -> str:
        return Template(os.environ.get(form) or self.forms[form]).safe_substitute(values)

    def warning(self, title: str, message: str) -> None:
        self.line(self.formed("STRATATILE_LOG_WARNING", title=title, message=message))

    @contextlib.contextmanager
    def step(self, title: str, spark: SparkSession | None = None, interval: float = INTERVAL) -> Iterator[None]:
        """A group of lines around a step; with a session, progress lines while its tasks run."""
        with contextlib.ExitStack() as ends:
            self.line(self.formed("STRATATILE_LOG_GROUP", title=title))
            ends.callback(lambda: self.line(self.formed("STRATATILE_LOG_END_GROUP", title=title)))
            if spark is not None:
                over = threading.Event()
                watch = threading.Thread(target=self._watch, args=(spark, title, interval, over), daemon=True)
                watch.start()
                ends.callback(watch.join)
                ends.callback(over.set)
            yield

    def _watch(self, spark: SparkSession, title: str, interval: float, over: threading.Event) -> None:
        """Counts tasks as Spark's status tracker has them; nothing is counted in the tasks themselves."""
        tracker = spark.sparkContext.statusTracker()
        while not over.wait(interval):
            stages = [s for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
            total, done = sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages)
            if total:
                self.line(f"update: {title}: {done}/{total} tasks ({100 * done / total:.1f}%) of {len(stages)} running stages")


console = Console()
