import math
import random
from itertools import combinations

import pytest

from flowlens.operators import detectors as dt

STEP = [0.1] * 200 + [0.9] * 200
RAMP = [i / 1000 for i in range(1000)]


def run(make, values):
    one = make()
    return [i for i, x in enumerate(values) if one.add(x)]


def noisy(level, n, seed):
    rng = random.Random(seed)
    return [float(rng.random() < level) for _ in range(n)]


@pytest.mark.parametrize("name", dt.DETECTORS)
def test_constant_series_never_changes(name):
    assert run(dt.DETECTORS[name], [0.3] * 500) == []


@pytest.mark.parametrize("name", ["ADWIN", "DDM", "HDDM_A", "HDDM_W", "KSWIN"])
def test_a_step_is_found_soon_after(name):
    first = run(dt.DETECTORS[name], STEP)[0]
    assert 200 <= first < 260


def test_page_hinkley_needs_a_long_rise():
    found = run(dt.DETECTORS["PageHinkley"], [0.1] * 200 + [2.0] * 200)
    assert found and 200 < found[0] < 260
    assert run(dt.DETECTORS["PageHinkley"], [2.0] * 200 + [0.1] * 200) == []


def test_eddm_sees_errors_come_closer():
    sparse = [1.0 if i % 20 == 19 else 0.0 for i in range(1200)]
    dense = [1.0 if i % 2 else 0.0 for i in range(400)]
    found = run(dt.Eddm, sparse + dense)
    assert found and found[0] > 1200
    assert run(dt.Eddm, dense * 4) == []


def test_a_ramp_is_found():
    for name in ("ADWIN", "HDDM_A", "HDDM_W", "KSWIN"):
        assert run(dt.DETECTORS[name], RAMP)


def test_a_fall_is_no_change_for_one_sided_tests():
    for name in ("HDDM_A", "HDDM_W"):
        assert run(dt.DETECTORS[name], STEP[::-1]) == []


@pytest.mark.parametrize("name", dt.DETECTORS)
def test_missing_numbers_do_not_raise_and_do_not_alarm(name):
    values = [0.3] * 60 + [math.nan] * 5 + [0.3] * 60
    assert run(dt.DETECTORS[name], values) == []


@pytest.mark.parametrize("name", dt.DETECTORS)
def test_state_survives_a_dump_at_any_place(name):
    values = noisy(0.2, 150, 1) + noisy(0.8, 150, 2) + noisy(0.1, 150, 3)
    whole = run(dt.DETECTORS[name], values)
    one, found = dt.DETECTORS[name](), []
    for i, x in enumerate(values):
        if one.add(x):
            found.append(i)
        if i % 7 == 0:
            one = dt.DETECTORS[name]().load(one.dump())
    assert found == whole


def test_adwin_buckets_keep_the_window():
    one, kept = dt.Adwin(), []
    for x in noisy(0.5, 500, 4):
        kept.append(x)
        assert not one.add(x)
        assert sum(b[0] for b in one.buckets) == len(kept)
        assert sum(b[1] for b in one.buckets) == pytest.approx(sum(kept))
        sizes = [b[0] for b in one.buckets]
        assert sizes == sorted(sizes, reverse=True)
        assert all(sizes.count(s) <= one.row for s in sizes)
    whole = [0, 0.0, 0.0]
    for b in one.buckets:
        whole = dt._joined(whole, b)
    mean = sum(kept) / len(kept)
    assert whole[2] == pytest.approx(sum((x - mean) ** 2 for x in kept))


def test_ddm_follows_the_definition():
    values = noisy(0.1, 300, 5) + noisy(0.6, 300, 6)
    found, seen, low = [], [], (math.inf, math.inf)
    for i, x in enumerate(values):
        seen.append(x)
        p = sum(seen) / len(seen)
        s = math.sqrt(max(p * (1 - p), 0) / len(seen))
        if len(seen) >= 30:
            if p + s <= sum(low):
                low = (p, s)
            if p + s > low[0] + 3 * low[1]:
                found.append(i)
                seen, low = [], (math.inf, math.inf)
    assert run(dt.Ddm, values) == found and found


def test_ks_chance_counts_all_splits():
    n = 4
    pooled = range(2 * n)
    distances = [
        dt.ks_distance(list(pick), [x for x in pooled if x not in pick]) for pick in combinations(pooled, n)
    ]
    for h in range(1, n + 1):
        share = sum(d >= h / n - 1e-12 for d in distances) / len(distances)
        assert dt.ks_chance(h / n, n) == pytest.approx(share)


def test_series_run_apart_and_in_order(spark):
    rows = [("up", i, x) for i, x in enumerate(STEP)] + [("flat", i, 0.3) for i in range(400)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "series string, seq long, value double").repartition(5)
    found = dt.detect(table, ["series"])
    assert found.count() == 800 * 7
    changes = {(r.series, r.detector): r.seq for r in found.filter("change = 1").orderBy("seq", ascending=False).collect()}
    assert {k[0] for k in changes} == {"up"}
    for name in dt.DETECTORS:
        expected = run(dt.DETECTORS[name], STEP)
        assert changes.get(("up", name)) == (expected[0] if expected else None)
    both = dt.consensus(found, ["series"], "change")
    assert {(r.series, r.consensus) for r in both.collect()} == {("up", 1), ("flat", 0)}


def test_epochs_restart_detectors(spark):
    from flowlens.plans.ensemble import with_epochs

    table = spark.createDataFrame([("s", i, x) for i, x in enumerate(STEP)], "series string, seq long, value double")
    assert dt.detect(with_epochs(table, [200]), ["series", "epoch"]).filter("change = 1").isEmpty()
