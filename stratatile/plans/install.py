"""Installing what a run needs: its plugins, then the dependencies that profiles declare.

Profiles are read as text: a ``script`` block of inline metadata (PEP 723) is
comment lines between ``# /// script`` and ``# ///`` that hold TOML.
"""

from __future__ import annotations

import importlib.metadata
import importlib.util
import shutil
import subprocess
import sys
import tempfile
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

from ..log import console
from .config import RunConfig

OPEN, CLOSE = "# /// script", "# ///"
#: Programs that install, each with a test that it is there; the first one that is does the work.
INSTALLERS: tuple[tuple[Callable[[], object], tuple[str, ...]], ...] = (
    (lambda: importlib.util.find_spec("pip"), (sys.executable, "-m", "pip", "install")),
    (lambda: shutil.which("uv"), ("uv", "pip", "install", "--python", sys.executable)),
)


def script_block(source: str) -> dict:
    """The parsed block of a source text; empty if it has none."""
    lines = source.splitlines()
    opened = [i for i, line in enumerate(lines) if line == OPEN]
    if not opened:
        return {}
    if len(opened) > 1:
        raise ValueError(f"{len(opened)} script blocks; a file has one")
    body: list[str] = []
    closed = False
    for line in lines[opened[0] + 1 :]:
        if not (line == "#" or line.startswith("# ")):
            break
        if line == CLOSE:
            closed = True
            break
        body.append(line[2:])
    if not closed:
        raise ValueError(f"the script block has no closing {CLOSE!r}")
    return tomllib.loads("\n".join(body))


def profile_requirements(path: str) -> list[str]:
    try:
        found = script_block(Path(path).read_text(encoding="utf-8")).get("dependencies", [])
    except ValueError as error:  # bad blocks and bad TOML
        raise ValueError(f"{path}: {error}") from None
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError(f"{path}: dependencies is no list of requirements")
    return found


def requirements(config: RunConfig) -> dict[str, list[str]]:
    """What to install, by step: each requirement once, in order. A profile may need a plugin, so plugins come first."""
    declared = (r for p in config.profiles for r in profile_requirements(p))
    return {"plugins": [*dict.fromkeys(config.plugins)], "dependencies of profiles": [*dict.fromkeys(declared)]}


def commands(steps: dict[str, list[str]], constraint: str) -> Iterator[tuple[str, list[str]]]:
    """The command of each step that has something to install."""
    program = next((start for there, start in INSTALLERS if there()), None)
    for title, wanted in steps.items():
        if wanted and program is None:
            raise RuntimeError(f"neither pip nor uv is here to install the {title}: {', '.join(wanted)}; install one of them or these packages")
        if wanted:
            yield title, [*program, "--constraint", constraint, *wanted]


def own_version() -> str:
    """A constraint that keeps this package at its version; empty if it runs from a checkout."""
    found = {d.metadata["Name"]: d.version for d in importlib.metadata.distributions(name="stratatile")}
    return "".join(f"{name}=={version}\n" for name, version in found.items())


def setup(config: RunConfig) -> None:
    steps = requirements(config)
    with tempfile.TemporaryDirectory() as folder:
        constraint = Path(folder, "constraint.txt")
        constraint.write_text(own_version(), encoding="utf-8")
        for title, command in commands(steps, str(constraint)):
            with console.step(f"install {title}"):
                ended = subprocess.run(command).returncode
            if ended:
                raise RuntimeError(f"installing the {title} failed with status {ended}; see the installer's lines above, mend {', '.join(steps[title])} and run setup again")
    if not any(steps.values()):
        console.line("setup: the run config and its profiles need nothing to be installed")
