import io
import json
import zipfile

import pytest

from furrow.operators import models, zones
from furrow.plans import views
from furrow.sources import catalog, polygons


def item(i, at, box=(0, 0, 1, 1)):
    return {"id": i, "properties": {"datetime": at}, "bbox": list(box), "assets": {"B04": {"href": f"{catalog.WEB}/{i}.B04.tif"}}}


@pytest.fixture
def folder(tmp_path):
    s30 = [item(f"s{k:03d}", f"2024-01-{k % 28 + 1:02d}T10:00:00Z") for k in range(130)] + [item("far", "2024-01-05T10:00:00Z", (50, 50, 51, 51))]
    (tmp_path / "S30.json").write_text(json.dumps({"features": s30}))
    (tmp_path / "L30.json").write_text(json.dumps({"features": [item("l1", "2024-01-09T23:59:59Z")]}))
    return str(tmp_path)


def test_data_source(spark, folder):
    catalog.register(spark)
    df = spark.read.format("scene_catalog").option("bbox", "0.5,0.5,2,2").load(folder)
    assert df.count() == 131 and df.where("sensor = 'L30'").first().item_id == "l1"
    some = spark.read.format("scene_catalog").option("sensor", "S30").option("since", "2024-01-20").option("bbox", "0.5,0.5,2,2").load(folder)
    assert some.count() == len([k for k in range(130) if k % 28 + 1 >= 20])
    two = [r.item_id for r in catalog.page(df, size=2).orderBy("sensor", "datetime", "item_id").collect()]
    assert two == ["l1", "s000", "s028"]
    last = catalog.page(df, size=2).where("sensor = 'S30'").orderBy("item_id").collect()[-1]
    assert [r.item_id for r in catalog.page(df.where("sensor = 'S30'"), (last.datetime, last.item_id), 2).orderBy("item_id").collect()] == ["s056", "s084"]
    assert catalog.assets_in_store(df).where("item_id = 'l1'").first().assets["B04"] == f"{catalog.STORE}/l1.B04.tif"


def test_items_of_saved_json(spark, folder):
    assert catalog.items(spark, folder).count() == 132
    near = catalog.within(catalog.items(spark, folder), (0.5, 0.5, 2, 2), "2024-01-01", "2024-01-03")
    assert near.select("datetime").distinct().count() == 2


def test_area_in_degrees():
    lon, lat = catalog.degrees(500000, 4500000)
    assert abs(lon + 105) < 1e-9 and abs(lat - 40.65087) < 1e-4
    a = catalog.box_in_degrees([517587.0, 4514699.0, 527283.0, 4524372.0])
    assert a[0] < a[2] and a[1] < a[3] and abs(a[1] - 40.783) < 0.01


def test_zipped_polygons_and_zones(spark, tmp_path):
    ring = "0.5,0.5,0 3.5,0.5,0 3.5,3.5,0 0.5,3.5,0"
    hole = "1.5,1.5 2.5,1.5 2.5,2.5 1.5,2.5 1.5,1.5"
    kml = f"<kml xmlns='http://www.opengis.net/kml/2.2'><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>{hole}</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark></kml>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("doc.kml", kml)
    (tmp_path / "z.kmz").write_bytes(raw.getvalue())
    edges = polygons.read_kmz(spark, str(tmp_path))
    assert edges.count() == 8 and edges.first().name == "a"
    grid = spark.createDataFrame([(x, y) for x in range(5) for y in range(5)], "x int, y int")
    got = {(r.x, r.y) for r in zones.assigned(grid, edges).where("zone = 1").collect()}
    assert got == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} - {(2, 2)}


def test_models_are_data(spark, tmp_path):
    models.save(spark, [views.BIOMASS, *views.BOOTSTRAP], str(tmp_path / "m"))
    got = models.load(spark, str(tmp_path / "m"))
    assert len(got) == 21 and models.get(got, "biomass_demo") == views.BIOMASS
    table = spark.createDataFrame([(m["name"],) for m in got], "name string")
    drawn = models.sampled(table, 5, 3).collect()
    assert drawn == models.sampled(table.repartition(3), 5, 3).collect() and len(set(drawn)) == min(5, len(got))
    with pytest.raises(KeyError):
        models.get(got, "none")
    with pytest.raises(ValueError):
        models.cover({n: views.BIOMASS for n in models.COVER})
