from importlib.metadata import EntryPoint

import pytest

import archives
from archives import feature
from stratatile.functions import mvt, wkb
from stratatile.operators import features as fs
from stratatile.plans import registry
from stratatile.plans.config import RunConfig
from stratatile.plans.convert import convert
from stratatile.plans.schema import FeatureSet, TileSchema, provides

BORDERS = FeatureSet("borders", "Borders of countries on land.")


class WithBorders(TileSchema):
    name = "with-borders"
    archive_layers = frozenset({"boundary"})

    @provides(BORDERS, {"disputed": "Boolean"})
    def borders(self, layers):
        return fs.kept(fs.layer_features(layers, "boundary"), lambda f: fs.number(f, "admin_level") == 2, lambda f: ~fs.truthy(f, "maritime"))


SCHEMA = WithBorders()
PROFILE = """
from stratatile.plans.profile import Profile
from test_plugins import BORDERS

class Borders(Profile):
    name = "borders"
    def columns(self, tile):
        return tile.programs(BORDERS)

PROFILE = Borders
"""


@pytest.fixture
def offered(monkeypatch):
    def offer(*points):
        registry.catalogue.cache_clear()
        registry.schema.cache_clear()
        monkeypatch.setattr(registry, "entry_points", lambda group: [EntryPoint(name, value, group) for name, value in points])

    yield offer
    registry.catalogue.cache_clear()
    registry.schema.cache_clear()


def test_schemas_of_packages(offered):
    offered(("with-borders", "test_plugins:SCHEMA"))
    assert registry.schema_names() == ["openmaptiles", "protomaps", "with-borders"]
    assert registry.schema("with-borders").fields_for(BORDERS) == {"disputed": "Boolean"}
    offered(("other", "test_plugins:SCHEMA"))
    with pytest.raises(ValueError, match="has the name 'with-borders'"):
        registry.schema("other")
    for twice in ([("a", "test_plugins:SCHEMA"), ("a", "test_convert:SCHEMA")], [("protomaps", "test_plugins:SCHEMA")]):
        offered(*twice)
        with pytest.raises(ValueError, match="uninstall all but one"):
            registry.schema_names()


def test_a_layer_from_a_packages_schema(spark, tmp_path, offered):
    offered(("with-borders", "test_plugins:SCHEMA"))
    line = wkb.dump("LineString", [(0, 0), (10, 10)])
    props = [{"admin_level": 2}, {"admin_level": 2, "maritime": 0}, {"admin_level": 2, "maritime": 1}, {"admin_level": 2, "maritime": True}, {"admin_level": 4}, {}, {"admin_level": 2.0, "maritime": False, "disputed": True}]
    tile = mvt.encode([{"name": "boundary", "features": [feature(line, n=("uint", i), **p) for i, p in enumerate(props)]}], 4096)
    source = archives.write(tmp_path / "in.pmtiles", {0: tile}, {"vector_layers": [{"id": "boundary"}], "attribution": "x"}, max_zoom=0)
    (tmp_path / "borders.py").write_text(PROFILE)
    written = convert(spark, RunConfig((str(tmp_path / "borders.py"),), "with-borders"), source, str(tmp_path))
    _, tiles, _ = archives.read(written[0])
    assert [f["props"]["n"] for f in mvt.decode(tiles[0])[0]["features"]] == [("uint", 0), ("uint", 1), ("uint", 6)]
