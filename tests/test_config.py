import io
import json
import re
import subprocess
import sys
import time
from pathlib import Path

import pytest

import archives
from stratatile import cli
from stratatile.functions import mvt, wkb
from stratatile.log import Console
from stratatile.plans import config, credits, install, registry
from stratatile.plans.schema import SURFACE_WATER, FeatureSet, OpenMapTiles, Protomaps
from stratatile.sources.pmtiles import Entry, pack_directory, parse_directory, split

ROOT = Path(__file__).resolve().parents[1]


def write(tmp_path, text, name="run.toml"):
    (tmp_path / "p.py").write_text("PROFILE = None\n")
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_a_full_config(tmp_path):
    (tmp_path / "plugin").mkdir()
    got = config.read_config(write(tmp_path, 'profiles = ["p.py"]\nschema = "protomaps"\nmin_zoom = "2"\nmax_zoom = 5\nattribution = "x"\nplugins = ["./plugin", "other>=1"]'))
    assert got == config.RunConfig((str(tmp_path / "p.py"),), "protomaps", 2, 5, "x", (str(tmp_path / "plugin"), "other>=1"))
    assert got.with_zooms(None, 3).max_zoom == 3
    config.check(got)


@pytest.mark.parametrize(
    "text, why",
    [
        ("profiles = []", "lists no file"),
        ('profiles = ["q.py"]', "no such file"),
        ("profiles = 3", "takes a list"),
        ("profiles = [3]", "takes text"),
        ('profiles = ["p.py"]\ncolour = 1', "colour is no key"),
        ('profiles = ["p.py"]\nmin_zoom = 1.5', "whole number from 0"),
        ('profiles = ["p.py"]\nmin_zoom = true', "whole number from 0"),
        ('profiles = ["p.py"]\nmax_zoom = 31', "whole number from 0"),
        ('profiles = ["p.py"]\nschema = 1', "takes text"),
        ('profiles = ["p.py"]\nplugins = ["./none"]', "no such folder"),
        ("profiles = [", "run.toml"),
        ('schema = 1\nmax_zoom = "x"', "lists no file.*schema takes text.*max_zoom takes"),
    ],
)
def test_wrong_configs(tmp_path, text, why):
    with pytest.raises(ValueError, match=why):
        config.read_config(write(tmp_path, text))


def test_checks(tmp_path):
    for text, why in (("min_zoom = 3\nmax_zoom = 2\nschema = 'protomaps'", "above"), ("", "names no schema"), ("schema = 'x'", "not installed")):
        with pytest.raises(ValueError, match=why):
            config.check(config.read_config(write(tmp_path, f'profiles = ["p.py"]\n{text}')))
    with pytest.raises(ValueError, match="toml"):
        config.read_config("run.json")


def test_profiles(tmp_path):
    bad = tmp_path / "bad.py"
    for text, why in (("import no_such_module_here", "needs the module"), ("x = 1", "no PROFILE")):
        bad.write_text(text)
        with pytest.raises(ValueError, match=why):
            config.load_profile(str(bad))
    with pytest.raises(ValueError, match="no file"):
        config.load_profile(str(tmp_path / "none.py"))
    bad.write_text("import os\nPROFILE = type('P', (), {'name': os.path.basename('x/y')})")
    assert config.load_profile(str(bad)).name == "y"


def test_names_of_layers(spark):
    assert credits.layer_names(spark, [("x", "b"), ("y", "a.1_-")]) == ["b", "a.1_-"]
    with pytest.raises(ValueError, match="x, z have the same name 'a'.*'a/b' of y is no name"):
        credits.layer_names(spark, [("x", "a"), ("y", "a/b"), ("z", "a")])
    for bad in ("", "-a", "a\n", "é"):
        with pytest.raises(ValueError, match="no name"):
            credits.layer_names(spark, [("x", bad)])


def test_credits(spark):
    credit = lambda declared, template: credits.credit(spark, {} if declared is None else {"attribution": declared}, template)
    assert credit("  x\n", None) == credit("x", " \t") == "x"
    assert credit("a", "b {source} ") == "b a" and credit(None, "b") == credit(" ", "b") == "b"
    for declared, template in ((None, None), (" ", None), (None, "x {source}")):
        with pytest.raises(ValueError, match="nothing to credit"):
            credit(declared, template)
    for bad in ([], {"attribution": 3}):
        with pytest.raises(ValueError, match="is a"):
            credits.credit(spark, bad, "b")


def test_script_blocks(tmp_path):
    assert install.script_block("x = 1") == {}
    text = '# /// script\n# dependencies = ["a>=1", "b"]\n#\n# ///\nimport a\n'
    assert install.script_block(text) == {"dependencies": ["a>=1", "b"]}
    assert install.script_block("# /// script\n# ///\n") == {}
    for bad in (text + text, "# /// script\n# x = 1\n"):
        with pytest.raises(ValueError):
            install.script_block(bad)
    one, two = tmp_path / "1.py", tmp_path / "2.py"
    one.write_text(text)
    two.write_text(text.replace("a>=1", "c"))
    assert install.requirements(config.RunConfig((str(one), str(two)), plugins=("p", "p"))) == {"plugins": ["p"], "dependencies of profiles": ["a>=1", "b", "c"]}
    one.write_text("# /// script\n# dependencies = 'a'\n# ///\n")
    with pytest.raises(ValueError, match="no list"):
        install.profile_requirements(str(one))
    one.write_text("# /// script\n# x = \n# ///\n")
    with pytest.raises(ValueError, match="1.py"):
        install.profile_requirements(str(one))


def test_installers(monkeypatch, capsys, tmp_path):
    steps = {"plugins": ["p"], "dependencies of profiles": []}
    monkeypatch.setattr(install, "INSTALLERS", ((lambda: None, ("pip",)), (lambda: "uv", ("uv", "add"))))
    assert list(install.commands(steps, "c")) == [("plugins", ["uv", "add", "--constraint", "c", "p"])]
    monkeypatch.setattr(install, "INSTALLERS", ((lambda: None, ("pip",)),))
    with pytest.raises(RuntimeError, match="neither pip nor uv"):
        list(install.commands(steps, "c"))
    install.setup(config.RunConfig(()))
    assert "nothing to be installed" in capsys.readouterr().err
    monkeypatch.setattr(install, "INSTALLERS", ((lambda: True, (sys.executable, "-c", "raise SystemExit(3)")),))
    with pytest.raises(RuntimeError, match="status 3.*run setup again"):
        install.setup(config.RunConfig((), plugins=("p",)))
    assert cli.main(["setup", write(tmp_path, 'profiles = ["p.py"]\nplugins = ["p"]')]) == 1


def test_schemas(spark):
    assert registry.schema_names() == ["openmaptiles", "protomaps"]
    with pytest.raises(ValueError, match="no schema 'x'"):
        registry.schema("x")
    with pytest.raises(KeyError, match="no feature set 'roads'; it has surface_water, waterways"):
        Protomaps().fields_for(FeatureSet("roads"))
    assert OpenMapTiles().fields_for(SURFACE_WATER) == {}

    class More(Protomaps):
        name = "more"

    assert set(More().sets()) == set(Protomaps().sets())
    both = [OpenMapTiles(), Protomaps()]
    check = lambda metadata: credits.check_schema(spark, both[1], metadata, "a", both)
    assert check({"vector_layers": [{"id": "water"}, {"id": "earth"}]}) is None
    assert "lists no vector_layers" in check({})
    with pytest.raises(ValueError, match="lacks earth, water.*look for a plugin"):
        check({"vector_layers": []})
    with pytest.raises(ValueError, match="lacks earth, .*fit: openmaptiles"):
        check({"vector_layers": [{"id": "water"}, {"id": "waterway"}]})
    with pytest.raises(ValueError, match="no id"):
        check({"vector_layers": [{}]})


def test_lines_of_a_run(spark, monkeypatch):
    out = io.StringIO()
    console = Console(out)
    monkeypatch.setenv("STRATATILE_LOG_WARNING", "{title}|{message}|{x}")
    console.warning("{message}", "m")
    monkeypatch.setenv("STRATATILE_LOG_END_GROUP", "end {title}")
    with console.step("one"):
        console.line("inside")
    assert out.getvalue().splitlines() == ["{message}|m|{x}", "one:", "inside", "end one"]
    with console.step("slow", spark, 0.2):
        spark.range(0, 8, 1, 8).mapInPandas(lambda rows: (time.sleep(0.5) or b for b in rows), "id long").count()
    lines = out.getvalue().splitlines()
    assert any(re.fullmatch(r"update: slow: \d+/\d+ tasks \(\d+\.\d%\) of \d+ running stages", x) for x in lines) and lines[-1] == "end slow"


def test_directories_round_trip():
    some = [Entry(0, 0, 5, 1), Entry(1, 5, 6, 3), Entry(9, 0, 5, 1), Entry(2**40, 2**33, 7, 2)]
    assert parse_directory(pack_directory(some)) == some
    assert split([Entry(0, 0, 1, 5), Entry(5, 0, 1, 0), Entry(9, 1, 1, 0)], 4, 9, 100) == ([Entry(0, 0, 1, 5)], [(Entry(5, 0, 1, 0), 9)])
    assert split([Entry(5, 0, 1, 0)], 90, 200, 100)[1] == [(Entry(5, 0, 1, 0), 100)]


def test_tiles_round_trip_and_are_the_same_bytes():
    shapes = [("Point", (3.0, 4.0)), ("MultiLineString", [[(0.0, 0.0), (5.0, 5.0)], [(7.0, 0.0), (9.0, 1.0)]]), ("MultiPolygon", [[[(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]], [[(20.0, 0.0), (20.0, 9.0), (29.0, 9.0), (29.0, 0.0), (20.0, 0.0)]]])]
    layer = {"name": "a", "features": [{"wkb": wkb.dump(*s), "props": {"k": i}} for i, s in enumerate(shapes)]}
    tile = mvt.encode([layer], 256)
    assert tile == mvt.encode([layer], 256)
    back = mvt.decode(tile)[0]
    assert back["extent"] == 256 and [f["geom_type"] for f in back["features"]] == [s[0] for s in shapes]
    assert [wkb.load(f["wkb"])[1] for f in back["features"]][:2] == [shapes[0][1], shapes[1][1]]
    assert mvt.decode(b"") == [] and mvt.encode([], 256) is None
    assert mvt.encode([{"name": "a", "features": [{"wkb": wkb.dump("Polygon", [[(0, 0), (0.2, 0), (0.2, 0.2), (0, 0)]])}]}], 256) is None


def test_command_line(tmp_path, capsys):
    for arguments in (["convert", "none.pmtiles", "none.toml"], ["convert", str(tmp_path / "none"), write(tmp_path, 'profiles = ["p.py"]\nschema = "protomaps"')], ["convert", "x", write(tmp_path, 'profiles = ["p.py"]\nschema = "protomaps"'), "--transform-processes", "0"], []):
        with pytest.raises(SystemExit) as stopped:
            cli.main(arguments)
        assert stopped.value.code == 2
    with pytest.raises(SystemExit) as stopped:
        cli.main(["--version"])
    assert stopped.value.code == 0
    assert cli.main(["setup", write(tmp_path, 'profiles = ["p.py"]')]) == 0


def test_convert_as_a_command(tmp_path):
    (tmp_path / "copy.py").write_text("from stratatile.plans.profile import Profile\nfrom stratatile.plans.schema import SURFACE_WATER\nclass W(Profile):\n    name = 'w'\n    def transform(self, tile):\n        return tile.features(SURFACE_WATER)\nPROFILE = W\n")
    (tmp_path / "run.toml").write_text('profiles = ["copy.py"]\nschema = "protomaps"\nmax_zoom = 3\n')
    source = archives.write(tmp_path / "in.pmtiles", archives.smoke_tiles())
    command = [sys.executable, "-m", "stratatile", "convert", source, str(tmp_path / "run.toml"), "--min-zoom", "", "--max-zoom", "1", "--transform-processes", "2", "-o", str(tmp_path)]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "layer: " in done.stderr
    archive, tiles, _ = archives.read(str(tmp_path / "w.pmtiles"))
    assert len(tiles) == 3 and json.loads(json.dumps(archive.metadata))["maxzoom"] == "1"
    again = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert again.returncode == 1 and "exists" in again.stderr
