import random

import pytest

from furrow.operators import atsa, raster


def image(spark, *rows):
    return spark.createDataFrame([(0, y, x, int(c)) for y, r in enumerate(rows) for x, c in enumerate(r)], "t int, y int, x int, mask int")


def back(df, column="mask"):
    out = {}
    for r in df.collect():
        out.setdefault(r.y, {})[r.x] = r[column]
    return ["".join(str(out[y][x]) for x in sorted(out[y])) for y in sorted(out)]


def test_lone_clouds_and_components(spark):
    rows = ["11111111", "12111111", "11111111", "11112222", "11112222", "11111111", "11111111", "11111112"]
    got = back(raster.without_lone_clouds(image(spark, *rows), 3))
    assert got[3] == "11112222" and got[7][7] == "1"
    assert got[1] == rows[1]  # its window isn't whole
    with pytest.raises(ValueError):
        raster.without_lone_shadows(image(spark, *rows), 1)
    with pytest.raises(ValueError):
        raster.shadow_buffer(image(spark, *rows), 3, 4)


def test_components_equal_flood_fill(spark):
    r = random.Random(4)
    rows = ["".join(r.choice("122") for _ in range(20)) for _ in range(20)]
    got = {(p.y, p.x): p.big for p in raster.components(image(spark, *rows), 2, 8).where("mask = 2").collect()}
    seen = {}
    for y in range(20):
        for x in range(20):
            if rows[y][x] == "2" and (y, x) not in seen:
                todo, comp = [(y, x)], {(y, x)}
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < 20 and 0 <= d < 20 and rows[c][d] == "2" and (c, d) not in comp:
                            comp.add((c, d))
                            todo.append((c, d))
                seen |= {p: len(comp) >= 8 for p in comp}
    assert got == seen


def test_buffer_looks_back_only(spark):
    rows = ["1111", "1211", "1111", "1111"]
    assert back(raster.cloud_buffer(image(spark, *rows), 1)) == ["1111", "1221", "1221", "1111"]


def test_shadow_falls_away_from_the_sun(spark):
    rows = ["1" * 12] * 6 + ["111112111111"] + ["1" * 12] * 5
    angles = spark.createDataFrame([(0, 0, 4500.0, 9000.0, 0.0, 0.0)], "t int, corner int, sza double, saa double, vza double, vaa double")
    got = {(r.y, r.x) for r in raster.shadow_zone(image(spark, *rows), angles, 4, 0).where("zone = 1").collect()}
    assert got == {(6, 5), (6, 2)}


def test_staged_mask_codes(spark):
    from furrow.plans.images import scene

    got = atsa.mask(scene(spark, "/root/testdata/sf0.001", 6), atsa.Parameters(longest=8))
    assert {r[0] for r in got.select("mask").distinct().collect()} <= {0, 1, 2, 3} and got.count() == 6 * 576


def test_scene_has_every_chip(spark):
    import math

    import pyarrow.parquet as pq

    from furrow.plans.images import atsa_prepare

    d = "/root/testdata/sf0.001"
    table = pq.read_table(f"{d}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    dates, want = math.ceil((1 + max(r["vec_id"] for r in table)) / 9), {}
    for r in table:
        part, t = divmod(r["vec_id"], dates)
        for i, e in enumerate(r["embedding"]):
            cloud, dark = e > 0.1, e < -0.2
            blue = 400 + (2500 if cloud else -150 if dark else 0) + math.floor(abs(float(e)) * 900)
            want[t, i // 8 + 8 * (part // 3), i % 8 + 8 * (part % 3)] = (int(cloud or dark), 0, int(cloud), int(dark), float(blue))
    rows = atsa_prepare(spark, d).collect()
    got = {(r.t, r.y, r.x): (r.qa, r.water, r.qa_cloud, r.qa_shadow, r.BLUE) for r in rows}
    assert len(rows) == len(got) == 64 * len(table)
    assert got == want


def test_mask_has_every_pixel_of_the_table(spark):
    from furrow.plans.images import atsa_mask

    got = atsa_mask(spark, "/root/testdata/sf0.001")
    assert got.count() == 500 * 64 and {r[0] for r in got.select("mask").distinct().collect()} <= {0, 1, 2, 3}
