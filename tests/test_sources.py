from datetime import datetime, timezone

from pyspark.sql import functions as F

from flowlens.schema import feature_schema, packet_schema
from flowlens.sources import feature_table as ft
from flowlens.sources import packets as pk

HEADER = "frame.time;frame.time_epoch;_ws.col.Source;_ws.col.Destination;_ws.col.Protocol;frame.len\n"
LINES = [
    "Aug 18;1313657280.25;10.0.0.1;10.0.0.2;TCP;60",
    "Aug 18;1313657279.5;10.0.0.2;10.0.0.1;UDP;1514",
    "Aug 18;1313657281.0;;10.0.0.1;ARP;42",
    "Aug 18;1313657282.0;10.0.0.3;10.0.0.1;TCP;70",
]


def write(folder, lines=LINES, name="capture.csv"):
    path = folder / name
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return str(path)


def test_schema():
    assert [f.name for f in packet_schema()] == HEADER.strip().split(";")
    assert len(feature_schema()) == 26 and len(feature_schema(labelled=True)) == 27


def test_read_csv(spark, tmp_path):
    path = write(tmp_path)
    packets = pk.read_packets_csv(spark, path)
    assert packets.columns == [
        "time", "time_epoch", "Source", "Destination", "Protocol", "frame_len", "parsed_time"
    ]
    first = packets.orderBy("time_epoch").first()
    assert first["parsed_time"] == datetime(2011, 8, 18, 8, 47, 59, 500000)
    assert (first["Source"], first["frame_len"]) == ("10.0.0.2", 1514)
    assert pk.preview(packets, 2).count() == 2
    assert pk.complete_packets(packets).count() == 3
    assert pk.count_incomplete(packets).first()["n_incomplete"] == 1


def test_options(spark, tmp_path):
    path = write(tmp_path)
    full = pk.read_packets_csv(spark, path, row_id=True, ordered=True)
    rows = full.collect()
    assert [r["time_epoch"] for r in rows] == sorted(r["time_epoch"] for r in rows)
    assert len({r["id"] for r in rows}) == 4


def test_stream_equals_batch(spark, tmp_path):
    write(tmp_path)
    stream = pk.read_packet_stream(spark, str(tmp_path), max_files=1)
    run = stream.writeStream.format("memory").queryName("packets_seen").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = pk.read_packets_csv(spark, str(tmp_path))
    assert spark.table("packets_seen").exceptAll(batch).isEmpty()
    assert spark.table("packets_seen").count() == batch.count()


def test_filters_reach_parquet_scan(spark, tmp_path):
    from flowlens.functions.timerange import in_time_range

    pk.read_packets_csv(spark, write(tmp_path)).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    ranged = in_time_range(stored, datetime(2011, 8, 18, 8, 48), None).select("Source")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(parsed_time" in plan
    assert "ReadSchema: struct<Source:string,parsed_time:timestamp>" in plan


def test_stored_features(spark, tmp_path):
    def key(hour):
        day = datetime(2024, 1, 1, tzinfo=timezone.utc)
        return ft.FeatureKey("/data/capture.csv", 30, 5, day, day.replace(hour=hour))

    calls = []

    def compute(value):
        def run():
            calls.append(value)
            return spark.range(value).select(F.col("id").alias("window_index"))
        return run

    root = str(tmp_path / "features")
    assert ft.read_or_compute(spark, root, key(1), compute(3)).count() == 3
    assert ft.read_or_compute(spark, root, key(2), compute(5)).count() == 5
    assert ft.read_or_compute(spark, root, key(1), compute(7)).count() == 3
    assert calls == [3, 5]
    ft.write_features(spark.range(1).toDF("window_index"), root, key(1))
    assert ft.read_features(spark, root, key(1)).count() == 1
    assert ft.read_features(spark, root, key(2)).count() == 5


def test_bad_lines_are_kept_and_counted_in_the_scan(spark, tmp_path):
    from pyspark.sql import Observation

    bad = ["Aug 18;1313657283.0;10.0.0.3;10.0.0.1;TCP;seventy", "Aug 18;1313657284.0;10.0.0.3", "Aug 18;1313657285.0;10.0.0.3;10.0.0.1;TCP;70;more", "no fields at all"]
    path = write(tmp_path, LINES[:2] + bad + LINES[2:])
    read = pk.read_packets_csv(spark, path, bad_lines=True)
    assert sorted(r.bad_line for r in read.where("bad_line IS NOT NULL").select("bad_line", "Source").collect()) == sorted(bad)
    assert read.agg(F.count("bad_line").alias("n"), F.sum("frame_len").alias("s")).first()["n"] == 4
    seen = Observation("lines")
    good = pk.good_packets(read, seen)
    assert good.exceptAll(pk.read_packets_csv(spark, write(tmp_path, name="good.csv"))).isEmpty() and good.count() == 4
    assert seen.get == {"n_lines": 8, "n_bad": 4}


def test_stored_features_of_one_file_name_in_two_folders(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    keys = [
        ft.FeatureKey(path, 30, 5, start, start.replace(microsecond=us))
        for path in ("/a/capture.csv", "/b/capture.csv") for us in (0, 1)
    ]
    root = str(tmp_path / "features")
    for n, key in enumerate(keys, 1):
        table = spark.range(n).select(F.col("id").alias("window_index"))
        assert ft.read_or_compute(spark, root, key, lambda table=table: table).count() == n
