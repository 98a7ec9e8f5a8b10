import json
import textwrap

import pytest

import archives
from archives import box, feature
from stratatile.functions import mvt, wkb
from stratatile.plans.config import read_config
from stratatile.plans.convert import convert

COPY = """
from stratatile.plans.profile import Profile
from stratatile.plans.schema import SURFACE_WATER

class Water(Profile):
    name = "surface-water"
    def transform(self, tile):
        return [f.geometry for f in tile.features(SURFACE_WATER)]

PROFILE = Water
"""
LAND = """
from stratatile.plans.profile import Profile, one_feature, subtract_water

class Land(Profile):
    name = "{name}"
    {body}

PROFILE = Land
"""
IN_PYTHON = "def transform(self, tile):\n        return subtract_water(tile, tile.buffered_square)"
IN_COLUMNS = "def columns(self, tile):\n        return one_feature(tile.without_water(tile.buffered_square))"


def config(tmp_path, *profiles, **keys):
    names = []
    for i, text in enumerate(profiles):
        (tmp_path / f"p{i}.py").write_text(textwrap.dedent(text))
        names.append(f"p{i}.py")
    lines = [f"profiles = {json.dumps(names)}"] + [f"{k} = {json.dumps(v)}" for k, v in ({"schema": "protomaps", "max_zoom": 3} | keys).items()]
    (tmp_path / "layers.toml").write_text("\n".join(lines))
    return read_config(str(tmp_path / "layers.toml"))


@pytest.mark.parametrize("leaf, nested", [(0, False), (7, False), (7, True)])
def test_smoke(spark, tmp_path, leaf, nested):
    """Copying the lakes gives 43 tiles, one content, and the archive's credit."""
    source = archives.write(tmp_path / "in.pmtiles", archives.smoke_tiles(), leaf=leaf, nested=nested)
    written = convert(spark, config(tmp_path, COPY), source, str(tmp_path / "out"))
    assert written == [str(tmp_path / "out/surface-water.pmtiles")]
    archive, tiles, entries = archives.read(written[0])
    lakes = {archives.zxy_to_id(z, x, y) for z in range(4) for x in range(0, 1 << z, 2) for y in range(1 << z)}
    assert set(tiles) == lakes and len(lakes) == 43
    layer = mvt.decode(next(iter(tiles.values())))[0]
    assert layer["name"] == "surface-water"
    assert sorted(wkb.load(layer["features"][0]["wkb"])[1][0][:4]) == [(1024, 1024), (1024, 3072), (3072, 1024), (3072, 3072)]
    h = archive.header
    assert (h.clustered, h.addressed_tiles, h.tile_contents, h.tile_entries) == (1, 43, 1, len(entries))
    assert (h.min_zoom, h.max_zoom, h.min_lon_e7, h.max_lat_e7) == (0, 3, -1800000000, 850511287)
    assert archive.metadata == {"name": "surface-water", "format": "pbf", "minzoom": "0", "maxzoom": "3", "attribution": "&copy; Test", "vector_layers": [{"id": "surface-water", "fields": {}}]}
    # neighbours with equal content are one entry
    assert all(a.tile_id + a.run_length < b.tile_id for a, b in zip(entries, entries[1:]))


def test_land_is_the_same_in_python_and_in_columns(spark, tmp_path):
    source = archives.write(tmp_path / "in.pmtiles", archives.smoke_tiles())
    made = config(tmp_path, LAND.format(name="land", body=IN_PYTHON), LAND.format(name="land-columns", body=IN_COLUMNS))
    one, two = (archives.read(p)[1] for p in convert(spark, made, source, str(tmp_path)))
    assert len(one) == len(two) == 85
    for tile_id in one:
        a, b = (mvt.decode(t[tile_id])[0]["features"] for t in (one, two))
        assert [x["wkb"] for x in a] == [x["wkb"] for x in b]
    lake, dry = one[archives.zxy_to_id(1, 0, 0)], one[archives.zxy_to_id(1, 1, 0)]
    assert wkb.load(mvt.decode(dry)[0]["features"][0]["wkb"])[1] == [[(-128, -128), (-128, 4224), (4224, 4224), (4224, -128), (-128, -128)]] or len(wkb.load(mvt.decode(dry)[0]["features"][0]["wkb"])[1]) == 1
    assert len(wkb.load(mvt.decode(lake)[0]["features"][0]["wkb"])[1]) == 2  # a hole where the lake is


def test_properties_types_zooms_and_runs(spark, tmp_path):
    profile = """
    from stratatile.plans.profile import Profile
    from stratatile.plans.schema import WATERWAYS

    class Lines(Profile):
        name = "lines"
        def layer_fields(self, schema):
            return schema.fields_for(WATERWAYS)
        def transform(self, tile):
            return [f for f in tile.features(WATERWAYS) if f.properties.get("kind") != "ditch"]

    PROFILE = Lines
    """
    line = wkb.dump("LineString", [(0, 0), (100, 50)])
    props = {"kind": "river", "layer": ("sint", -2), "min_zoom": ("uint", 2**64 - 1), "deep": True, "w": ("float", 1.5), "d": 2.25}
    tile = mvt.encode([{"name": "water", "features": [feature(line, **props), feature(line, kind="ditch"), feature(box(0, 0, 9, 9), kind="lake"), feature(wkb.dump("Point", (5, 5)), kind="sea")]}], 4096)
    source = archives.write(tmp_path / "in.pmtiles", {0: tile}, runs={0: 85})
    made = config(tmp_path, profile, min_zoom=1, max_zoom=2, attribution="Mine, {source}")
    archive, tiles, entries = archives.read(convert(spark, made, source, str(tmp_path))[0])
    assert [(e.tile_id, e.run_length) for e in entries] == [(1, 20)]  # one run over both zooms, cut at their ends
    assert (archive.header.min_zoom, archive.header.max_zoom) == (1, 2)
    assert archive.metadata["attribution"] == "Mine, &copy; Test"
    assert archive.metadata["vector_layers"][0]["fields"]["sort_rank"] == "Number"
    only = mvt.decode(tiles[1])[0]["features"]
    assert [f["props"] for f in only] == [{"kind": ("string", "river"), "layer": ("sint", -2), "min_zoom": ("uint", 2**64 - 1), "deep": ("bool", True), "w": ("float", 1.5), "d": ("double", 2.25)}]
    assert wkb.load(only[0]["wkb"]) == ("LineString", [(0, 0), (100, 50)])


def test_openmaptiles_keeps_water_without_brunnel(spark, tmp_path):
    tile = mvt.encode([{"name": "water", "features": [feature(box(0, 0, 9, 9)), feature(box(0, 0, 8, 8), brunnel="tunnel"), feature(box(0, 0, 7, 7), brunnel="bridge")]}, {"name": "waterway", "features": [feature(wkb.dump("LineString", [(0, 0), (9, 9)]))]}], 4096)
    source = archives.write(tmp_path / "in.pmtiles", {0: tile}, {"vector_layers": [{"id": "water"}, {"id": "waterway"}], "attribution": "x"}, max_zoom=0)
    _, tiles, _ = archives.read(convert(spark, config(tmp_path, COPY, schema="openmaptiles"), source, str(tmp_path))[0])
    assert len(mvt.decode(tiles[0])[0]["features"]) == 2


def test_collapsed_geometry_and_empty_layers_leave_no_file(spark, tmp_path):
    tiny = mvt.encode([{"name": "water", "features": [feature(box(0, 0, 4, 4), tunnel="yes")]}], 4096)
    old = tmp_path / "surface-water.pmtiles"
    old.write_bytes(b"old")
    source = archives.write(tmp_path / "in.pmtiles", {0: tiny}, max_zoom=0)
    assert convert(spark, config(tmp_path, COPY), source, str(tmp_path), overwrite=True) == []
    assert not old.exists() and not list(tmp_path.glob("*.tmp"))


def test_finished_tiles_and_several_layers(spark, tmp_path):
    profile = """
    from stratatile.plans.profile import Geometry, Profile

    class Two(Profile):
        name = "two"
        def build_tile(self, tile):
            return {"a": Geometry.box(0, 0, 10, 10), "b": [Geometry.box(0, 0, 0.2, 0.2)], "c": Geometry.box(0, 0, 10, 10) - Geometry.box(0, 0, 5, 10)}

    PROFILE = Two
    """
    raw = """
    from stratatile.plans.profile import Profile

    class Raw(Profile):
        name = "raw"
        def build_tile(self, tile):
            return b"bytes" if "water" in tile.layers else None

    PROFILE = Raw
    """
    source = archives.write(tmp_path / "in.pmtiles", archives.smoke_tiles())
    two, raw_ = (archives.read(p)[1] for p in convert(spark, config(tmp_path, profile, raw), source, str(tmp_path)))
    assert [x["name"] for x in mvt.decode(two[0])] == ["a", "c"]
    assert len(raw_) == 43 and set(raw_.values()) == {b"bytes"}


def test_errors(spark, tmp_path):
    good = archives.write(tmp_path / "in.pmtiles", archives.smoke_tiles())
    out = str(tmp_path / "out")
    broken = COPY.replace("return [", "raise KeyError('x'); return [")
    with pytest.raises(RuntimeError, match=r"profile 'surface-water' failed on tile \d/\d/\d"):
        convert(spark, config(tmp_path, broken), good, out)
    with pytest.raises(ValueError, match="lacks waterway.*fit: protomaps"):
        convert(spark, config(tmp_path, COPY, schema="openmaptiles"), good, out)
    with pytest.raises(ValueError, match="holds zooms 0 to 3"):
        convert(spark, config(tmp_path, COPY, min_zoom=5, max_zoom=6), good, out)
    with pytest.raises(ValueError, match="declares no attribution"):
        convert(spark, config(tmp_path, COPY), archives.write(tmp_path / "b.pmtiles", archives.smoke_tiles(), {"vector_layers": archives.WORLD["vector_layers"]}), out)
    with pytest.raises(ValueError, match="tiles of type 2"):
        convert(spark, config(tmp_path, COPY), archives.write(tmp_path / "c.pmtiles", archives.smoke_tiles(), tile_type=2), out)
    with pytest.raises(ValueError, match="compressed"):
        convert(spark, config(tmp_path, COPY), archives.write(tmp_path / "c.pmtiles", archives.smoke_tiles(), tile_compression=1), out)
    whole = open(good, "rb").read()
    (tmp_path / "d.pmtiles").write_bytes(whole[:-10])
    with pytest.raises(ValueError, match="truncated"):
        convert(spark, config(tmp_path, COPY), str(tmp_path / "d.pmtiles"), out)
    overlapping = archives.write(tmp_path / "e.pmtiles", {i: t for i, t in archives.smoke_tiles().items() if i < 5}, runs={1: 3})
    with pytest.raises(ValueError, match="overlap"):
        convert(spark, config(tmp_path, LAND.format(name="land", body=IN_COLUMNS)), overlapping, out)
    with pytest.raises(RuntimeError, match="tile 0/0/0 can't be decoded"):
        convert(spark, config(tmp_path, COPY), archives.write(tmp_path / "f.pmtiles", {0: b"no tile"}), out)
    (tmp_path / "out").mkdir(exist_ok=True)
    (tmp_path / "out/surface-water.pmtiles").write_bytes(b"")
    with pytest.raises(ValueError, match="exists"):
        convert(spark, config(tmp_path, COPY), good, out)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["surface-water.pmtiles"]


def test_an_unlisted_archive_is_read_with_a_warning(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("STRATATILE_LOG_WARNING", "::warning title={title}::{message} {other}")
    source = archives.write(tmp_path / "in.pmtiles", {0: b""}, {"attribution": "x"}, max_zoom=0)
    assert convert(spark, config(tmp_path, COPY), source, str(tmp_path)) == []
    assert "::warning title=schema::" in capsys.readouterr().err
