import json
import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions.timerange import in_time_range, instant
from flowlens.operators.detectors import Ddm, HddmA
from flowlens.plans import adapt as ad
from flowlens.plans.ensemble import batch_metrics, fit_predict
from flowlens.plans.models import Selection, as_json, candidates, select_model

COLUMNS = ["x", "y"]
CHANGE = 150


def feature_rows(spark, seconds=260, change=CHANGE):
    """Two kinds of address per second; at the change both move, and the label turns round."""
    rng = random.Random(7)
    rows = []
    for s in range(seconds):
        for i in range(6):
            bot = i % 2
            after = s >= change
            side = bot != after
            rows.append((s * 1_000_000, (60.0 if after else 0.0) + (5.0 if side else 0.0) + rng.gauss(0, 1),
                         rng.gauss(0, 1), bot))
    return spark.createDataFrame(rows, "us long, x double, y double, isBot int").select(
        instant(F.col("us")).alias("window_start"), "x", "y", "isBot"
    )


def cheap(df):
    return select_model(df, COLUMNS, time_limit=None, max_candidates=1)


def settings(**changes):
    base = dict(
        batch_seconds=10, offset_seconds=10, columns=COLUMNS, panel={"DDM": lambda: Ddm(least=3), "HDDM_A": HddmA},
        select=cheap, round_size=8,
    )
    return ad.Adaptive(**(base | changes))


def test_candidates_and_json(spark):
    rows = feature_rows(spark, 20)
    chosen = select_model(rows, COLUMNS, time_limit=None, max_candidates=2)
    again = select_model(rows.repartition(3), COLUMNS, time_limit=None, max_candidates=2)
    assert chosen.name == again.name and chosen.tried == again.tried
    assert {r.prediction for r in chosen.predict(rows).collect()} <= {0, 1}
    described = json.loads(as_json(chosen))
    assert described["name"] == chosen.name and described["stages"][0]["stage"] == "VectorAssembler"
    assert len(candidates()) == 18


def test_time_limit_still_fits_one(spark):
    chosen = select_model(feature_rows(spark, 10), COLUMNS, time_limit=0.0)
    assert isinstance(chosen, Selection) and len(chosen.tried) == 1


def test_halving_ends_with_the_candidate_that_all_rows_prefer(spark):
    rng = random.Random(3)
    # only a tree sees the ring; on few rows it does no better than the others
    points = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(1500)]
    rows = spark.createDataFrame([(x, y, int(x * x + y * y < 1.5)) for x, y in points], "x double, y double, isBot int")
    space = [c for c in candidates() if c.title in ("bayes", "logistic-0", "logistic-0/scaled", "logistic-0.1", "svc", "tree-10")]
    runs = [
        select_model(rows.repartition(n), COLUMNS, time_limit=None, space=space, least_rows=100, parallel=n) for n in (1, 3)
    ]
    assert runs[0].tried == runs[1].tried and len(runs[0].tried) == len(space)
    assert {r.name for r in runs} <= {"tree-10", "bayes"} and dict(runs[0].tried)[runs[0].name] > 0.9
    cut = select_model(rows, COLUMNS, time_limit=0.0, space=space, least_rows=100)
    assert cut.name == space[0].title and len(cut.tried) == 1


def test_single_class_is_learned(spark):
    rows = feature_rows(spark, 10).withColumn("isBot", F.lit(1))
    chosen = select_model(rows, COLUMNS, time_limit=None, max_candidates=1)
    assert {r.prediction for r in chosen.predict(rows).collect()} == {1}


def test_metrics_tell_same_from_different(spark):
    rows = feature_rows(spark)
    ref = in_time_range(rows, 0, 60_000_000, include_upper=False, on="window_start")
    same = in_time_range(rows, 70_000_000, 130_000_000, on="window_start").withColumn("batch_id", F.lit(0))
    other = in_time_range(rows, 180_000_000, 240_000_000, on="window_start").withColumn("batch_id", F.lit(1))
    found = {
        (r.batch_id, r.metric): r.value
        for r in batch_metrics(ref, same.unionByName(other), COLUMNS).collect()
    }
    assert abs(found[0, "adjusted_rand_score"]) < 0.1
    assert found[1, "adjusted_rand_score"] == pytest.approx(1.0)
    assert found[1, "accuracy_score"] == pytest.approx(1.0)
    consensus, log = fit_predict(ref, same, COLUMNS)
    assert log.count() == 42 and consensus.first()["consensus"] == 0


def test_planted_change_is_found_and_learned(spark):
    rows = feature_rows(spark)
    train = in_time_range(rows, 0, 50_000_000, include_upper=False, on="window_start")
    test = in_time_range(rows, 50_000_000, on="window_start")
    found = ad.adapt(train, test, settings()).orderBy("batch_id").collect()
    assert [r.batch_id for r in found] == list(range(21))
    alarms = [r.batch_id for r in found if r.drift_detection]
    assert alarms and alarms[0] >= 10 and alarms[0] <= 13
    assert all(r.accuracy > 0.95 for r in found if r.batch_id < 10)
    assert min(r.accuracy for r in found if 10 <= r.batch_id < alarms[0] + 1) < 0.6 or alarms[0] == 10
    assert all(r.accuracy > 0.95 for r in found if r.batch_id >= alarms[0])
    regions = ad.drift_regions(spark.createDataFrame(found)).collect()
    assert len(regions) == len(alarms)
    assert {(r.region_end - r.region_start).total_seconds() for r in regions} == {60.0}


def test_round_size_does_not_matter(spark):
    rows = feature_rows(spark, 150, 90)
    train = in_time_range(rows, 0, 50_000_000, include_upper=False, on="window_start")
    test = in_time_range(rows, 50_000_000, on="window_start")
    runs = [
        sorted(tuple(r) for r in ad.adapt(train, test, settings(round_size=n)).collect()) for n in (4, 20)
    ]
    assert runs[0] == runs[1]


def test_score_before_refit_shows_the_drop(spark):
    rows = feature_rows(spark, 150, 90)
    train = in_time_range(rows, 0, 50_000_000, include_upper=False, on="window_start")
    test = in_time_range(rows, 50_000_000, on="window_start")
    found = ad.adapt(train, test, settings(score_before_refit=True)).orderBy("batch_id").collect()
    first = next(r for r in found if r.drift_detection)
    assert first.accuracy < 0.95


def test_streaming_sink_equals_batch(spark, tmp_path):
    from flowlens.streaming.adapt import AdaptiveSink

    rows = feature_rows(spark, 150, 90)
    train = in_time_range(rows, 0, 50_000_000, include_upper=False, on="window_start")
    test = in_time_range(rows, 50_000_000, on="window_start")
    for part, (low, high) in enumerate([(50, 83), (83, 121), (121, 150)]):
        piece = in_time_range(test, low * 1_000_000, high * 1_000_000, include_upper=False, on="window_start")
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    sink = AdaptiveSink(str(tmp_path / "adaptive"), settings())
    sink.begin(train, 50_000_000)
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    run = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    streamed = sorted(tuple(r) for r in sink.statistics(spark).collect())
    batch = sorted(tuple(r) for r in ad.adapt(train, test, settings()).collect())
    assert streamed == batch[: len(streamed)]
    assert len(streamed) >= len(batch) - 1
    # a micro-batch that runs again changes nothing
    sink(test.limit(1), 1)
    assert sorted(tuple(r) for r in sink.statistics(spark).collect()) == streamed
    sink.finish(spark, test.schema)
    sink.finish(spark, test.schema)
    assert sorted(tuple(r) for r in sink.statistics(spark).collect()) == batch and sink.late(spark) == 0
    with pytest.raises(ValueError):
        sink(test.limit(1), 99)


def test_sink_waits_for_late_rows_and_counts_those_too_late(spark, tmp_path):
    from flowlens.streaming.adapt import AdaptiveSink

    rows = feature_rows(spark, 150, 90)
    train = in_time_range(rows, 0, 50_000_000, include_upper=False, on="window_start")
    test = in_time_range(rows, 50_000_000, on="window_start").persist()
    sink = AdaptiveSink(str(tmp_path / "late"), settings(), delay_seconds=60)
    sink.begin(train, 50_000_000)
    assert sink.statistics(spark).count() == 0
    for number, (low, high, odd) in enumerate([(50, 99, 0), (50, 80, 1), (80, 99, 1), (99, 120, 0), (99, 120, 1), (120, 151, 0)]):
        part = in_time_range(test, low * 1_000_000, high * 1_000_000, include_upper=False, on="window_start")
        sink(part if low == 120 else part.where(F.expr(f"unix_seconds(window_start) % 2 = {odd}")), number)
    sink(test.where("unix_seconds(window_start) < 53"), 6)
    assert sink.late(spark) == test.where("unix_seconds(window_start) < 53").count()
    sink.finish(spark, test.schema)
    batch = sorted(tuple(r) for r in ad.adapt(train, test, settings()).collect())
    assert sorted(tuple(r) for r in sink.statistics(spark).collect()) == batch


def test_no_batch_with_rows_enough(spark):
    rows = feature_rows(spark, 60, 90)
    train = in_time_range(rows, 0, 50_000_000, include_upper=False, on="window_start")
    assert ad.adapt(train, rows.limit(0), settings()).count() == 0
    assert ad.adapt(train, rows.limit(3), settings(least_rows=1000)).count() == 0
