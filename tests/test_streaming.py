import random

from pyspark.sql import functions as F

from flowlens.operators import stats
from flowlens.operators.windows import SECOND, WindowGrid
from flowlens.streaming import stats as st


def write_files(spark, folder, files):
    for packets in files:
        spark.createDataFrame(
            packets, "Source string, Destination string, us long, frame_len int"
        ).select(
            "Source", "Destination", F.timestamp_micros("us").alias("parsed_time"), "frame_len"
        ).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    schema = "Source string, Destination string, parsed_time timestamp, frame_len int"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, frame, tmp_path, name):
    run = (
        frame.writeStream.format("parquet").option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(str(tmp_path / name))


def test_late_packets_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_files(spark, folder, [[("a", "b", 1 * SECOND, 10), ("a", "b", 100 * SECOND, 20)]])
    write_files(spark, folder, [[("a", "b", 101 * SECOND, 30)]])
    write_files(spark, folder, [[("a", "b", 2 * SECOND, 99), ("a", "b", 102 * SECOND, 0)]])
    write_files(spark, folder, [[("a", "b", 300 * SECOND, 40)]])
    frame = st.stream_packet_stats(stream_of(spark, folder), 0, 10 * SECOND, 10 * SECOND, "5 seconds")
    found = {(r.window_index, r.IP): r.Tss for r in drain(spark, frame, tmp_path, "late").collect()}
    # the packet at second 2 came two micro-batches after the watermark had passed second 95
    assert found[0, "a"] == 10
    assert found[10, "a"] == 50


def test_windows_start_at_the_anchor(spark, tmp_path):
    folder = str(tmp_path / "in")
    packets = [("a", "b", 3 * SECOND + i * SECOND, 10) for i in range(60)]
    write_files(spark, folder, [packets])
    frame = st.stream_edges(stream_of(spark, folder), 3 * SECOND, 7 * SECOND, 3 * SECOND, "0 seconds")
    found = {r.window_index: r["count"] for r in drain(spark, frame, tmp_path, "edges").collect()}
    assert min(found) == 0 and set(found.values()) == {7}


def test_slots_of_a_stream_are_the_slots_of_a_batch(spark, tmp_path):
    rng = random.Random(3)
    # a third of the packets at few instants of one address
    base = 10_000 * SECOND  # a stream starts with the watermark at zero
    packets = [
        ("bot" if rng.random() < 0.4 else f"h{rng.randrange(4)}", f"h{rng.randrange(4)}",
         base + rng.randrange(20) * SECOND + (0 if rng.random() < 0.5 else rng.randrange(SECOND)), rng.randrange(40, 900))
        for _ in range(400)
    ]
    unsized = [(a, b, us, None if us % 5 == 0 else length) for a, b, us, length in packets]
    packets = unsized[::2] + unsized[1::2]  # the second file goes back to the beginning
    folder = str(tmp_path / "in")
    # packets far in the future close all slots before them
    write_files(spark, folder, [packets[:200], packets[200:], [("end", "end", base + 500 * SECOND, 1)], [("end", "end", base + 900 * SECOND, 1)]])
    grid = WindowGrid(base, 6 * SECOND, 2 * SECOND, 12)
    frame = st.stream_slot_stats(stream_of(spark, folder), grid, "30 seconds")
    streamed = drain(spark, frame, tmp_path, "slots").filter(F.col("last") < grid.end - grid.anchor)
    batch_packets = spark.read.parquet(folder).filter("Source <> 'end'")
    batch = stats.slot_stats(stats.positions(batch_packets, grid), grid.pane, SECOND).select(*streamed.columns)
    assert sorted(map(tuple, streamed.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    merged = stats.window_stats(stats.pane_stats(streamed, grid, SECOND), grid)
    assert merged.exceptAll(stats.packet_stats(batch_packets, grid)).isEmpty()


def test_features_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    from flowlens.plans.features import features
    from flowlens.streaming.features import FeatureSink

    rng = random.Random(8)
    base = 10_000 * SECOND
    packets = [
        (f"h{rng.randrange(5)}", f"h{rng.randrange(5)}", base + rng.randrange(40 * SECOND), rng.choice([None, 40, 900]))
        for _ in range(500)
    ]
    packets.sort(key=lambda p: p[2])
    # packets come up to some seconds out of order, and the last one closes what is before it
    files = [packets[i : i + 125 : 2] + packets[i + 1 : i + 125 : 2] for i in range(0, 500, 125)]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [*files, [("end", "end", base + 60 * SECOND, 1)]])
    grid = WindowGrid(base, 6 * SECOND, 2 * SECOND, 17)
    sink = FeatureSink(str(tmp_path / "sink"), grid, "12 seconds", slot=SECOND)
    assert sink.features(spark).count() == 0
    run = (
        sink.parts(stream_of(spark, folder)).writeStream.foreachBatch(sink)
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got = sink.features(spark)
    whole = spark.read.parquet(folder).where("Source <> 'end'")
    want = features(whole, grid)
    assert got.select("window_index").distinct().count() == 17
    near = [F.round(c, 9).alias(c) if c in ("centrality", "eigenvector_centrality", "Svar", "Rvar", "SITvar", "RITvar") else c for c in want.columns]
    got, want = got.select(*near), want.select(*near)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    versions = {p.name for p in (tmp_path / "sink" / "features").iterdir()}
    assert len(versions) > 1  # windows came out as they closed
    before = sorted(map(str, got.collect()))
    sink(spark.read.parquet(str(tmp_path / "sink" / "parts" / "version=0")).limit(0), 0)  # run again: nothing
    assert sorted(map(str, sink.features(spark).select(*near).collect())) == before


def test_windows_with_gaps_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(2)
    base, size, offset = 10_000 * SECOND, 3 * SECOND, 5 * SECOND
    packets = [(f"h{rng.randrange(3)}", f"h{rng.randrange(3)}", base + rng.randrange(60 * SECOND), 50) for _ in range(300)]
    folder = str(tmp_path / "in")
    write_files(spark, folder, [packets, [("end", "end", base + 900 * SECOND, 1)]])
    frame = st.stream_edges(stream_of(spark, folder), base, size, offset, "5 seconds")
    got = {tuple(r) for r in drain(spark, frame, tmp_path, "gaps").select("window_index", "Source", "Destination", "count").collect()}
    whole = spark.read.parquet(folder).where("Source <> 'end'")
    want = stats.edges(whole, WindowGrid(base, size, offset, 12))
    assert got == {tuple(r) for r in want.select("window_index", "Source", "Destination", "count").collect()}
    frame = st.stream_packet_stats(stream_of(spark, folder), base, size, offset, "5 seconds")
    rows = drain(spark, frame, tmp_path, "gapped").collect()
    assert sum(r.Spc for r in rows) == sum(n for *_, n in got)
    assert {(r.window_end - r.window_start).total_seconds() for r in rows} == {3.0}
