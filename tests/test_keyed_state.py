"""Event-time buffers and the stateful operators of a stream against their batch twins."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.operators.detectors import Ddm, HddmA, detect
from flowlens.plans.detector_store import DetectorStore
from flowlens.plans.ensemble import ensemble_store, fit_predict
from flowlens.streaming.detect import stream_detect
from flowlens.streaming.keyed import OrderedBuffer, one_each
from test_streaming import drain

KIND = np.dtype([("at", "<i8"), ("x", "<i8")])


class Held:
    """State in a dictionary, in no order of its keys."""

    def __init__(self):
        self.map, self.value = {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        held = Held()
        held.exists = lambda: held.value is not None
        held.get = lambda: held.value
        held.update = lambda value: setattr(held, "value", value)
        held.clear = lambda: setattr(held, "value", None)
        return held

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(-40, 40), max_size=30), st.integers(-50, 50)), max_size=12))
def test_buffer_gives_rows_in_order(steps):
    buffer, waiting, gone = OrderedBuffer(Held(), KIND, one_each, most=4), {}, []
    for step in steps:
        if isinstance(step, int):
            out = [int(x) for rows in buffer.taken(lambda r: int(np.searchsorted(r["at"], step))) for x in rows["at"]]
            assert out == sorted(x for x in waiting if x < step)
            waiting = {x: 1 for x in waiting if x >= step}
            gone += out
        else:
            buffer.add(np.array([(x, 0) for x in step], KIND))
            waiting |= {x: 1 for x in step}
        assert all(len(v[0]) <= 4 * KIND.itemsize for v in buffer.leaves.map.values())
    assert [int(x) for rows in buffer.taken() for x in rows["at"]] == sorted(waiting)
    assert not buffer.leaves.map and buffer.directory.value is None


def series_rows(n=160):
    rng = random.Random(4)
    return [
        (name, i, float(rng.random() < (0.1 if i < n // 2 else 0.7))) for name in ("a", "b", "c") for i in range(1, n)
    ]


def test_detectors_judge_any_order_of_arrival(spark, tmp_path):
    rows = series_rows()
    random.Random(7).shuffle(rows)
    odd = [("a", 3, None), ("b", 5, float("nan")), *rows[:5]]
    schema = "series string, seq long, value double"
    timed = lambda r: spark.createDataFrame(r, schema).withColumn("hour", F.timestamp_seconds(F.col("seq") * 3600))
    folder = str(tmp_path / "in")
    for part in (rows[:200], odd, rows[200:], [("end", 10**6, 0.0)], [("a", 2, 1.0)]):
        timed(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(timed(rows).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    panel = {"DDM": Ddm, "HDDM_A": HddmA}
    found = drain(spark, stream_detect(stream, ["series"], "hour", "30 days", panel=panel), tmp_path, "found")
    want = detect(spark.createDataFrame(rows, schema), ["series"], panel=panel)
    got = found.where("series <> 'end'")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert want.where("change = 1").count() > 0


def test_calls_go_on_from_the_states_before(spark, tmp_path):
    rows = spark.createDataFrame(series_rows(), "series string, seq long, value double")
    panel = {"DDM": Ddm, "HDDM_A": HddmA}
    store = DetectorStore(str(tmp_path / "store"), ["series"], panel=panel)
    assert store.states(spark) is None and store.calls(spark) == 0
    store.detect(rows.where("seq < 60 AND series <> 'c'"))
    assert store.detect(rows.where("seq < 50")).where("series <> 'c'").count() == 0  # all seen before
    # a call that failed half-way left a folder without its mark
    spark.range(3).write.parquet(str(tmp_path / "store" / "call=3"))
    (tmp_path / "store" / "call=3" / "_SUCCESS").unlink()
    assert store.calls(spark) == 2
    store.detect(rows.where("seq >= 40 OR series = 'c'"))
    got = store.log(spark).select("series", "seq", "detector", "change")
    want = detect(rows, ["series"], panel=panel)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert store.states(spark).count() == 6
    assert {r.seq for r in store.states(spark).collect()} == {159}
    store.reset(spark)
    assert store.states(spark).count() == 0
    afresh = store.detect(rows)
    assert afresh.exceptAll(want).isEmpty() and afresh.count() == want.count()


def test_missing_values_are_no_elements(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.0), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, 1.0)], "series string, seq long, value double"
    )
    assert sorted(r.seq for r in detect(rows, ["series"], panel={"DDM": Ddm}).collect()) == [1, 4]
    assert detect(rows.limit(0), ["series"]).count() == 0


def test_ensemble_in_two_calls(spark, tmp_path):
    rng = np.random.default_rng(0)
    reference = spark.createDataFrame([(float(x), float(y)) for x, y in rng.normal(size=(40, 2))], "f double, g double")
    batches = spark.createDataFrame(
        [(b, float(x) + b, float(y)) for b in range(6) for x, y in rng.normal(size=(30, 2))], "batch_id long, f double, g double"
    )
    panel = {"HDDM_A": HddmA, "DDM": lambda: Ddm(least=2)}
    _, want = fit_predict(reference, batches, ["f", "g"], panel)
    store = ensemble_store(str(tmp_path / "ensemble"), panel)
    parts = [fit_predict(reference, batches.where(f"batch_id {op} 3"), ["f", "g"], panel, store)[1] for op in ("<", ">=")]
    got = parts[0].unionByName(parts[1])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
