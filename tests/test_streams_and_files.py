"""Streams give what batches give; files come back as they were written."""

import os

import pytest
from pyspark.sql import functions as F

from tabulon.plans import pipelines
from tabulon.sources import files
from tabulon.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture
def folder(events, tmp_path):
    path = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(path)
    # a last row far ahead moves the watermark past all windows
    events.limit(1).withColumn("ts", F.expr("timestamp'2100-01-01'")).withColumn("event_type", F.lit("end")).write.mode("append").parquet(path)
    return path


def stream(spark, folder, events):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df, *drop):
    return sorted(tuple(r) for r in df.drop(*drop).collect())


def test_windows_equal_batch(spark, events, folder, tmp_path):
    live = streams.windowed(stream(spark, folder, events), "6 hours")
    got = streams.run_once(live, str(tmp_path / "out"), str(tmp_path / "cp")).where("event_type <> 'end'").drop("total", "mean")
    assert rows(got) == rows(streams.windowed(events, "6 hours").drop("total", "mean"))


def test_sessions_equal_batch(spark, events, folder, tmp_path):
    live = streams.sessions(stream(spark, folder, events), "6 hours")
    got = streams.run_once(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(got.where("start < '2099-01-01'")) == rows(streams.sessions(events, "6 hours"))


def test_alerts_equal_batch(spark, events, folder, tmp_path):
    shape = lambda df: df.where("value > 20").select(F.col("event_type").alias("key"), "ts", F.col("value").alias("score"))
    live = streams.limited_alerts(shape(stream(spark, folder, events)), cooldown_seconds=3600, daily=5)
    got = streams.run_once(live, str(tmp_path / "out"), str(tmp_path / "cp")).where("key <> 'end'")
    want = streams.limited_alerts(shape(events), cooldown_seconds=3600, daily=5)
    assert rows(got) == rows(want) and want.count() > 0
    assert want.groupBy("key", F.to_date("ts")).count().where("count > 5").count() == 0


def test_deduplication_and_enrichment(spark, events, folder, tmp_path):
    twice = stream(spark, folder, events).union(stream(spark, folder, events))
    got = streams.run_once(streams.deduplicated(twice, ["event_id"], watermark="100 years"), str(tmp_path / "o"), str(tmp_path / "c")).where("event_type <> 'end'")
    assert got.count() == events.select("event_id").distinct().count()
    names = spark.createDataFrame([(1, "one")], "user_id long, name string")
    assert "name" in streams.enriched(events, names, "user_id").columns


def test_ingestion_reports_each_batch(spark, events, folder, tmp_path):
    target = str(tmp_path / "t")
    streams.ingest(stream(spark, folder, events), target, str(tmp_path / "c"), lambda df: df.agg(F.count("*").alias("n")))
    assert spark.read.parquet(target).count() == events.count() + 1
    assert spark.read.parquet(f"{target}_profile").agg(F.sum("n")).first()[0] == events.count() + 1


def test_csv_json_and_feather(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("user id,first-name,Empty\n1,Ann,\n2,N/A,-\n")
    df = files.read_any(spark, path)
    assert df.columns == ["user_id", "first_name", "Empty"] and [tuple(r) for r in df.collect()] == [("1", "Ann", None), ("2", None, None)]
    with open(str(tmp_path / "b.json"), "w") as f:
        f.write('{"a": 1, "b": {"c": "x", "d": {"e": 2}}}\n')
    assert files.read_json(spark, str(tmp_path / "b.json")).columns == ["a", "b.c", "b.d.e"]
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"x": [1, 2], "y": ["a", None]}), str(tmp_path / "c.feather"))
    assert [tuple(r) for r in files.read_any(spark, str(tmp_path / "c.feather"), schema="x long, y string").collect()] == [(1, "a"), (2, None)]
    with pytest.raises((RuntimeError, ValueError)):
        files.read_any(spark, str(tmp_path / "d.xlsx"), schema="x long")


def test_detection(spark, tmp_path):
    with open(tmp_path / "semi.txt", "w") as f:
        f.write("a;b;c\n1;2,5;3\n")
    with open(tmp_path / "latin.txt", "wb") as f:
        f.write("é;ü\n".encode("latin1"))
    got = {os.path.basename(r["file"]): r["delimiter"] for r in files.detect_delimiter(files.first_lines(spark, str(tmp_path))).collect()}
    assert got == {"semi.txt": "semicolon", "latin.txt": "semicolon"}
    got = {os.path.basename(r["path"]): r["encoding"] for r in files.detect_encoding(spark, str(tmp_path)).collect()}
    assert got == {"semi.txt": "utf-8", "latin.txt": "latin1"}
    listed = files.inventory(spark, str(tmp_path), checksum=True).collect()
    assert {r["size"] for r in listed} == {14, 4} and all(len(r["checksum"]) == 64 for r in listed)


def test_feature_tables(spark, events, tmp_path):
    path, registry = str(tmp_path / "f"), str(tmp_path / "r")
    files.register_features(events.select("user_id", "ts", "value"), path, registry, name="v", entity="user_id", ts="ts")
    back = spark.read.parquet(path)
    assert back.count() == events.count() and spark.read.parquet(registry).first()["features"] == "value"
    table = files.materialise(back.drop("day"), "user_id", "ts", "1970-01-01", "2999-01-01")
    assert table.count() == events.select("user_id").distinct().count()


def test_whole_jobs(spark, tmp_path):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    files.write(customers, str(tmp_path / "c"), "parquet")
    os.rename(str(tmp_path / "c"), str(tmp_path / "c.parquet"))
    out = pipelines.process(spark, str(tmp_path / "c.parquet"), str(tmp_path / "clean"))
    assert out["data"].count() == customers.dropDuplicates().count() and out["left"].count() == 0
    assert pipelines.prepare(customers, "c_acctbal").count() == customers.count()
    assert pipelines.model_health(customers, customers).first()["status"] == "healthy"
    assert pipelines.validate(customers, required=["nope"])["issues"].where("issue_type = 'missing_column'").count() == 1
    assert {r["kind"] for r in pipelines.analyse(customers)["kinds"].collect()} == {"tabular", "time_series", "text", "anomaly", "clustering"}
