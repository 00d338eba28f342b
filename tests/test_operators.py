"""Closed-form fixtures and properties of the time-series operators."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewright.functions.align import Aligner, frame_at_or_after, frame_count, frame_time
from tidewright.functions.fields import FieldSelector
from tidewright.functions.names import SplitMix64, bits_double, catalog_line, double_bits, fnv1a, parse_catalog_line, valid_name
from tidewright.model import CorruptError, EpisodeSpec, TimeSpan
from tidewright.operators import quality, resample, stats
from tidewright.operators.predicates import Pred, aggregate_all
from tidewright.operators.scan import blocked, running, dedup, first_and_last, latest, merge, scan, window

NAN = float("nan")


def pairs(df):
    return [(r["ts"], r["value"]) for r in df.collect()]


def test_scan_with_predicate(samples):
    got = pairs(scan(samples([(0, 10 * i, i) for i in range(100)]), 0, 100, 290, Pred.gt(15)))
    assert got == [(10 * i, float(i)) for i in range(16, 30)]


@pytest.mark.parametrize(("agg", "value"), [("min", 1), ("max", 3), ("sum", 6), ("avg", 2), ("count", 3)])
def test_aggregates(samples, agg, value):
    df = samples([(1, 5, 1), (1, 6, 2), (1, 7, 3)])
    assert pairs(scan(df, 1, 0, 10, agg=agg)) == [(0, float(value))]
    assert pairs(scan(df, 1, 50, 90, agg=agg)) == []


def test_first_writer_and_predicate_before_dedup(samples):
    a = [(1, t, t, 1) for t in range(100)]
    b = [(1, t, 1000 + t, 2) for t in range(50, 150)]
    df = samples(a + b)
    plain = pairs(scan(df, 1, 0, 1000))
    assert plain == [(t, float(t)) for t in range(100)] + [(t, 1000.0 + t) for t in range(100, 150)]
    assert pairs(scan(df, 1, 0, 1000, Pred.gt(500))) == [(t, 1000.0 + t) for t in range(50, 150)]


def test_latest_keeps_the_first_of_equal_times(samples):
    rows = latest(samples([(1, 100, 1.0), (1, 100, 2.0), (1, 50, 0.5), (2, -5, 7)])).collect()
    assert {r["series"]: (r["ts"], r["value"]) for r in rows} == {1: (100, 1.0), 2: (-5, 7.0)}


def test_nan_in_predicates_and_aggregates(samples):
    df = samples([(1, 1, NAN), (1, 2, 5), (2, 1, NAN)])
    assert pairs(scan(df, 1, 0, 9, Pred.gt(1))) == [(2, 5.0)]
    assert pairs(scan(df, 1, 0, 9, Pred.between(0, math.inf))) == [(2, 5.0)]
    got = {r["series"]: r for r in dedup(df).groupBy("series").agg(*aggregate_all(F.col("value"))).collect()}
    assert (got[1]["min"], got[1]["max"], got[1]["count"]) == (5.0, 5.0, 2.0)
    assert math.isnan(got[1]["sum"])
    assert (got[2]["min"], got[2]["max"]) == (math.inf, -math.inf)


def test_empty_table(samples, spark):
    none = samples([(1, 1, 1)]).limit(0)
    assert scan(none, 1, 0, 9).count() == 0
    assert latest(none).count() == 0
    assert first_and_last(none).count() == 0


def test_window_is_half_open_and_merges_by_lane(samples):
    df = samples([(1, 10, 1), (1, 20, 2), (2, 10, 3), (2, 30, 4)])
    got = [(r["ts"], r["lane"], r["value"]) for r in window(df, [2, 1, 2], TimeSpan(10, 30)).collect()]
    assert got == [(10, 0, 3.0), (10, 1, 1.0), (10, 2, 3.0), (20, 1, 2.0)]
    with pytest.raises(CorruptError):
        TimeSpan(5, 5)


def test_merge_keeps_duplicates(samples):
    a, b = samples([(1, 5, 1, 1)]), samples([(1, 5, 2, 2)])
    assert [r["value"] for r in merge(a, b).collect()] == [1.0, 2.0]


@pytest.mark.parametrize(("ts", "at", "past"), [(0, 0, 0), (7, 0, 7), (10, 10, 0), (-1, -10, 9), (-10, -10, 0), (-11, -20, 9)])
def test_alignment(spark, ts, at, past):
    row = spark.range(1).select(Aligner(10).align(F.lit(ts).cast("long")).alias("a"), Aligner(10).jitter(F.lit(ts).cast("long")).alias("j")).first()
    assert (row["a"], row["j"]) == (at, past)


def test_correction_saturates(spark):
    low, high = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    a, b = Aligner(10, 100, 50), Aligner(10, -100, -50)
    row = spark.range(1).select(a.correct(F.lit(1000).cast("long")), a.correct(low), b.correct(high), b.correct(F.lit(0).cast("long")), Aligner(3).align(low)).first()
    assert list(row) == [850, -(2**63), 2**63 - 1, 150, -(2**63)]
    with pytest.raises(CorruptError):
        Aligner(0)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-(10**18), 10**18), st.integers(1, 10**6), st.integers(0, 10**9))
def test_frame_arithmetic(spark, start, hz, offset):
    row = spark.range(1).select(frame_at_or_after(F.lit(start + offset).cast("long"), start, hz).alias("f")).first()
    assert row["f"] == -(-offset * hz // 10**9)
    t = spark.range(1).select(frame_time(F.lit(offset).cast("long"), start, hz).alias("t")).first()["t"]
    assert t == start + offset * 10**9 // hz
    assert frame_count(start, start + offset, hz) == offset * hz // 10**9 + 1


def lvcf(rows, spec):
    """What a frame grid holds, by definition."""
    if spec.frame_hz:
        grid = [spec.start + i * 10**9 // spec.frame_hz for i in range(frame_count(spec.start, spec.end, spec.frame_hz))]
    else:
        lanes = {s for _, s in spec.series}
        grid = sorted({t for s, t, _ in rows if s in lanes and spec.start <= t <= spec.end})
    out = []
    for k, t in enumerate(grid):
        prev = grid[k - 1] if k else None
        cells, n = [], 0
        for _, s in spec.series:
            own = [(x, v) for r, x, v in rows if r == s and spec.start <= x <= t]
            cells.append(max(own)[1] if own else None)
            n += sum(1 for x, _ in own if prev is None or x > prev)
        out.append((t, *cells, n))
    return out


@pytest.mark.parametrize("hz", [3, 7, 1000, None])
def test_resampling_matches_its_definition(samples, monkeypatch, hz):
    monkeypatch.setattr(resample, "BLOCK", 4)
    rng = SplitMix64(hz or 5)
    rows = list({(s, rng.next() % 2_000_000_000): None for s in (1, 2) for _ in range(15)})
    rows = [(s, t, rng.uniform()) for s, t in rows]
    spec = EpisodeSpec("e", (("a.x", 1), ("b", 2), ("again", 1)), 100_000_000, 1_100_000_000, hz)
    got = resample.frames(samples(rows), spec).orderBy("timestamp").collect()
    back = [(r["timestamp"], *[None if math.isnan(r[c]) else r[c] for c, _ in spec.series], r["frame_samples"]) for r in got]
    assert back == lvcf(rows, spec)


def test_two_rates_on_a_grid(samples):
    ms = 1_000_000
    df = samples([(1, 10 * ms * i, i) for i in range(101)] + [(2, 40 * ms * i, 1000 + i) for i in range(26)])
    spec = EpisodeSpec("e", (("fast", 1), ("slow", 2)), 0, 1000 * ms, 50)
    out = resample.frames(df, spec).orderBy("frame")
    rows = out.collect()
    assert [r["fast"] for r in rows] == [2.0 * f for f in range(51)]
    assert [r["slow"] for r in rows] == [1000.0 + f // 2 for f in range(51)]
    assert [r["frame_samples"] for r in rows] == [2] + [2 + (f % 2 == 0) for f in range(1, 51)]
    found = {r["column"]: r for r in resample.column_stats(out, spec).collect()}
    assert (found["fast"]["min"], found["fast"]["max"], found["fast"]["count"], found["fast"]["samples"], found["slow"]["samples"]) == (0.0, 100.0, 51, 101, 26)


@pytest.mark.parametrize("bad", [{"name": ""}, {"series": ()}, {"series": (("a", 1), ("a", 2))}, {"series": (("", 1),)}, {"frame_hz": 0}, {"end": -1}])
def test_bad_episodes_are_rejected(bad):
    good = {"name": "e", "series": (("a", 1),), "start": 0, "end": 10, "frame_hz": 5}
    EpisodeSpec(**good).validate()
    with pytest.raises(CorruptError):
        EpisodeSpec(**(good | bad)).validate()


def test_field_selectors(spark):
    assert FieldSelector.parse("/pose/position/x").path == "$['pose']['position']['x']"
    assert str(FieldSelector.parse("scan/ranges[0][1]")) == "scan/ranges[0][1]"
    for bad in ("", "a//b", "a[", "a[x]", "/", "[1]"):
        with pytest.raises(CorruptError):
            FieldSelector.parse(bad)
    data = ['{"a":[1,2.5]}', '{"a":[1,"2"]}', '{"a":[1,true]}', '{"a":[1,null]}', '{"a":5}', "not json", '{"a":[0,1e300]}', None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, p string")
    got = [r["v"] for r in df.select("i", FieldSelector.parse("a[1]").extract(F.col("p")).alias("v")).orderBy("i").collect()]
    assert got == [2.5, None, None, None, None, None, 1e300, None]


def test_catalog_lines(spark):
    good = catalog_line("seg-000001-s7.seg", 7, -5, 9, -1.5, math.inf, 3)
    lines = [good, "A bad", "B" + good[1:], good.replace("seg-", "/seg-"), ""]
    found = [r["c"] for r in spark.createDataFrame([(x,) for x in lines], "value string").select(parse_catalog_line(F.col("value")).alias("c")).collect()]
    assert found[1:] == [None] * 4
    assert (found[0]["series"], found[0]["min_ts"], bits_double(int(found[0]["min_bits"])), bits_double(int(found[0]["max_bits"]))) == (7, -5, -1.5, math.inf)
    names = spark.createDataFrame([("a",), ("a/b",), (".a",), ("a\\b",), ("",)], "n string").select(valid_name(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in names] == [True, False, False, False, False]
    assert double_bits(bits_double(12345)) == 12345


def test_verdicts_count_downtime(samples, spark):
    p = 1_000_000
    rows = [(1, i * p, 0) for i in range(100)] + [(1, (i + 200) * p, 0) for i in range(100)] + [(2, i * p, 0) for i in range(0, 300, 2)]
    channels = spark.createDataFrame([(1, 1000.0), (2, 1000.0), (3, None)], "series long, rate double")
    got = {r["series"]: r for r in quality.verdicts(samples(rows), channels, 0, 300 * p).collect()}
    assert (got[1]["interruptions"], got[1]["downtime_ns"], got[1]["ok"]) == (1, 100 * p, True)
    assert (got[2]["actual"], got[2]["expected"], got[2]["ok"]) == (150, 300, False)
    assert (got[3]["actual"], got[3]["rate"], got[3]["ok"]) == (0, 1000.0, False)


def test_digest_is_the_ordered_hash(samples):
    import struct

    rows = [(1, 5, 1.5), (1, 3, -2.0), (2, 1, 0.25)]
    got = {r["series"]: r["digest"] for r in quality.digest(samples(rows)).collect()}
    assert got[1] == f"{fnv1a(b''.join(struct.pack('<Iqd', 1, t, v) for t, v in [(3, -2.0), (5, 1.5)])):016x}"
    assert fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_episode_window(samples):
    get = lambda rows: [tuple(r) for r in quality.episode_window(samples(rows)).collect()]
    assert get([(0, 1, 1), (0, 5, 0)]) == [(1, 5)]
    assert get([(0, 1, 1), (0, 5, 0), (0, 9, 1)]) == [(9, 0)]
    assert get([(0, 5, 0)]) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_percentiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    o, n = sorted(values), len(values)
    want = {"nearest": (0.99, o[-(-n * 99 // 100) - 1]), "rounded": (0.9, o[min(n - 1, math.floor((n - 1) * 0.9 + 0.5))]), "truncated": (0.95, o[int((n - 1) * 0.95)]), "upper_median": (0.5, o[n // 2])}
    for kind, (q, value) in want.items():
        assert stats.percentile(df, "g", "v", q, kind, "p").first()["p"] == value


def test_pareto_fit_needs_fifty_excesses(spark):
    few = spark.createDataFrame([("g", i) for i in range(60)], "g string, v long")
    u = spark.createDataFrame([("g", 30)], "g string, u long")
    assert stats.gpd_fit(few, "g", "v", u).first()["xi"] is None
    many = spark.createDataFrame([("g", i) for i in range(200)], "g string, v long")
    row = stats.gpd_fit(many, "g", "v", u).first()
    e = [i - 30 for i in range(31, 200)]
    m = sum(e) / len(e)
    v = sum((x - m) ** 2 for x in e) / len(e)
    assert math.isclose(row["xi"], 0.5 * (1 - m * m / v))
    assert math.isclose(row["beta"], 0.5 * m * (m * m / v + 1))


@pytest.mark.parametrize("rows", [1, 3, 10**6])
def test_blocks_do_not_change_running_sums(samples, rows):
    times = [(s, t) for s in (1, 2) for t in sorted({(i * i * 37) % 1009 * s for i in range(60)})]
    df = samples([(s, t, t % 7) for s, t in times])
    got = {(r["series"], r["ts"]): r["total"] for r in running(blocked(df, rows), "value", "total").collect()}
    for s in (1, 2):
        total = 0
        for _, t in (x for x in times if x[0] == s):
            total += t % 7
            assert got[s, t] == total
