import datetime

from furrow.operators.folds import cloud_flags
from furrow.streaming import scenes


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_clear_indices_once_and_composites(spark, tmp_path):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    rows = [(0, 0, day(k), "S30", 500.0, 700.0, 1000.0, 3000.0, 2000.0, 1500.0, 0 if k != 2 else 2) for k in (0, 1, 2, 5, 5, 20, 60)]
    schema = "y int, x int, t date, sensor string, BLUE double, GREEN double, RED double, NIR1 double, SWIR1 double, SWIR2 double, FMASK int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(spark, scenes.once(scenes.clear_indices(stream())), "once")
    assert sorted(r.t.date() for r in got) == [day(0), day(1), day(5), day(20), day(60)] and {r.NDVI for r in got} == {0.5}
    whole = run(spark, scenes.composites(scenes.clear_indices(stream())), "whole", "complete")
    assert sum(r.n for r in whole) == 6 and all(r.NDVI == 0.5 for r in whole)


def test_cloud_flags_keep_state_between_batches(spark, tmp_path):
    v = [500.0, None, 900.0, 880.0, 510.0, 1400.0]
    for part in (range(3), range(3, 6)):
        rows = [(1, i, v[i]) for i in part]
        spark.createDataFrame(rows, "pix long, t_idx int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("pix long, t_idx int, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, scenes.cloud_flags(df), "flags")
    assert [r.flag for r in sorted(got, key=lambda r: r.t_idx)] == cloud_flags(v)
