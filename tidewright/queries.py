"""Registered queries of the time-series operators over the `events` and `orders` tables, and their DuckDB SQL.

A series is a user; ts is nanoseconds; event_id is the order of writing. Sums and means of the SQL check are rounded,
as the two engines add doubles in different orders.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .db import Db
from .export import episode_path, export_episode
from .functions.align import Aligner, due_ns, floor_div, frame_count, lag_us
from .functions.fields import FieldSelector
from .functions.names import parse_catalog_line, parse_segment_name, segment_name, valid_name
from .model import SENTINEL_SERIES, EpisodeSpec, TimeSpan
from .operators import quality, resample, stats
from .operators.predicates import Pred, aggregate_all, time_zone_overlaps
from .operators.scan import chunks, dedup, first_and_last, in_range, latest, scan, scan_each, window
from .plans.store import SegmentStore, archivable, compaction_plan, prune, zone_maps
from .sources.files import committed, encode_frames, frames_in
from .sources.segments import pack, unpack
from .streaming.ingest import batch_table, bind, first_writers, latest_values, start_bridge
from .streaming.lru import simulate

DAY = 86_400_000_000_000
HOUR = DAY // 24
BASE = 1_704_067_200_000_000_000
T0, T1 = BASE + 3 * DAY, BASE + 20 * DAY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The sample view in SQL, and the first writers of a relation.
S = "S AS (SELECT CAST(user_id AS BIGINT) AS series, epoch_us(ts) * 1000 AS ts, value, event_id AS seq, event_type, props FROM events)"


def first_of(relation: str) -> str:
    return f"(SELECT * FROM {relation} QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY seq) = 1)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("long").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), "value", F.col("event_id").cast("long").alias("seq"), "event_type", "props")


def register(name: str, sql: str | None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Make a function of the sample view a query."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(samples(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(c: str, digits: int = 4) -> Column:
    return F.round(c, digits).alias(c)


def sql_floor(x: str, g: int) -> str:
    """Floor of x to a multiple of g in SQL, whose % truncates."""
    return f"({x} - ((({x}) % {g}) + {g}) % {g})"


# --- scans ---

PREDS = {"gt": Pred.gt(50.0), "lt": Pred.lt(20.0), "between": Pred.between(10.0, 60.0)}
PRED_SQL = {"gt": "value > 50.0", "lt": "value < 20.0", "between": "value BETWEEN 10.0 AND 60.0"}
RANGE_SQL = f"series = 3 AND ts BETWEEN {T0} AND {T1}"


@register("scan_range", f"WITH {S} SELECT ts, value FROM {first_of(f'(SELECT * FROM S WHERE {RANGE_SQL})')}")
def scan_range(s: DataFrame) -> DataFrame:
    return scan(s, 3, T0, T1)


for _k, _p in PREDS.items():
    register(f"scan_pred_{_k}", f"WITH {S} SELECT ts, value FROM {first_of(f'(SELECT * FROM S WHERE {RANGE_SQL} AND {PRED_SQL[_k]})')}")(lambda s, p=_p: scan(s, 3, T0, T1, p))

AGG_SQL = {"min": "min(value)", "max": "max(value)", "sum": "round(sum(value), 4)", "avg": "round(avg(value), 8)", "count": "CAST(count(value) AS DOUBLE)"}
for _a, _f in AGG_SQL.items():
    register(
        f"scan_agg_{_a}",
        f"WITH {S} SELECT CAST({T0} AS BIGINT) AS ts, {_f} AS value FROM {first_of(f'(SELECT * FROM S WHERE {RANGE_SQL})')} HAVING count(*) > 0",
    )(lambda s, a=_a: scan(s, 3, T0, T1, agg=a).select("ts", rounded("value", 8 if a == "avg" else 4)))
register("scan_agg_empty", f"WITH {S} SELECT CAST({BASE - 2 * DAY} AS BIGINT) AS ts, CAST(count(*) AS DOUBLE) AS value FROM S WHERE ts BETWEEN {BASE - 2 * DAY} AND {BASE - DAY} HAVING count(*) > 0")(
    lambda s: scan(s, 3, BASE - 2 * DAY, BASE - DAY, agg="count")
)

EACH_SQL = "min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, round(avg(value), 8) AS avg, CAST(count(value) AS DOUBLE) AS count"


def _each(df: DataFrame) -> DataFrame:
    return df.withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 8)})


@register("agg_by_series", f"WITH {S} SELECT series, {EACH_SQL} FROM {first_of('S')} GROUP BY series")
def agg_by_series(s: DataFrame) -> DataFrame:
    return _each(scan_each(s, -(2**63), 2**63 - 1))


@register("agg_by_series_pred", f"WITH {S} SELECT series, {EACH_SQL} FROM {first_of(f'(SELECT * FROM S WHERE ts BETWEEN {T0} AND {T1} AND value > 50.0)')} GROUP BY series")
def agg_by_series_pred(s: DataFrame) -> DataFrame:
    return _each(scan_each(s, T0, T1, Pred.gt(50.0)))


def agg_orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second series set; its day-granular times hold natural duplicates."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = o.select(F.col("o_custkey").alias("series"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return _each(scan_each(s, -(2**63), 2**63 - 1))


QUERIES["agg_orders_by_customer"] = agg_orders_by_customer
ORACLE["agg_orders_by_customer"] = (
    "WITH S AS (SELECT o_custkey AS series, epoch_us(o_orderdate) * 1000 AS ts, o_totalprice AS value, o_orderkey AS seq FROM orders) "
    f"SELECT series, {EACH_SQL} FROM {first_of('S')} GROUP BY series"
)

ALIGNED = f"(SELECT series, {sql_floor('ts', DAY)} AS ts, value, seq FROM S)"


def _by_day(s: DataFrame) -> DataFrame:
    return s.withColumn("ts", Aligner(DAY).align(F.col("ts")))


@register("align_dedup_first_writer", f"WITH {S} SELECT series, ts, value FROM {first_of(ALIGNED)}")
def align_dedup_first_writer(s: DataFrame) -> DataFrame:
    return dedup(_by_day(s))


@register("pred_before_dedup", f"WITH {S} SELECT series, ts, value FROM {first_of(f'(SELECT * FROM {ALIGNED} WHERE value > 50.0)')}")
def pred_before_dedup(s: DataFrame) -> DataFrame:
    return dedup(in_range(_by_day(s), -(2**63), 2**63 - 1, Pred.gt(50.0)))


@register("pred_after_dedup", f"WITH {S} SELECT series, ts, value FROM {first_of(ALIGNED)} WHERE value > 50.0")
def pred_after_dedup(s: DataFrame) -> DataFrame:
    return dedup(_by_day(s)).filter(Pred.gt(50.0).column(F.col("value")))


@register("latest_by_series", f"WITH {S} SELECT series, ts, value FROM S QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, seq) = 1")
def latest_by_series(s: DataFrame) -> DataFrame:
    return latest(s)


@register("latest_tie_first_writer", f"WITH {S} SELECT series, ts, value FROM {ALIGNED} QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, seq) = 1")
def latest_tie_first_writer(s: DataFrame) -> DataFrame:
    return latest(_by_day(s))


@register(
    "first_and_last",
    f"WITH {S}, D AS {first_of('S')} SELECT series, min(ts) AS first_ts, arg_min(value, ts) AS first_value, max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM D GROUP BY series",
)
def first_last(s: DataFrame) -> DataFrame:
    return first_and_last(s)


LANES = [3, 7, 3, 11]
LANE_SQL = " UNION ALL ".join(f"SELECT {i} AS lane, series, ts, value FROM D WHERE series = {x}" for i, x in enumerate(LANES))


@register("window_merge_halfopen", f"WITH {S}, D AS {first_of(f'(SELECT * FROM S WHERE ts >= {T0} AND ts < {T1})')} {LANE_SQL}")
def window_merge_halfopen(s: DataFrame) -> DataFrame:
    return window(s, LANES, TimeSpan(T0, T1))


@register("chunk_assign", f"WITH {S}, D AS {first_of('S')} SELECT series, ts, value, (r - 1) // 16 AS chunk, (r - 1) % 16 AS place FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS r FROM D)")
def chunk_assign(s: DataFrame) -> DataFrame:
    return chunks(s, 16)


# --- scalar functions ---

SHIFT = BASE + 10 * DAY + 12_345_678_901


def _about_zero(s: DataFrame) -> Column:
    return F.col("ts") - F.lit(SHIFT)


@register("align_grid", f"WITH {S} SELECT seq, {sql_floor(f'(ts - {SHIFT})', 1_000_000_007)} AS aligned FROM S")
def align_grid(s: DataFrame) -> DataFrame:
    return s.select("seq", Aligner(1_000_000_007).align(_about_zero(s)).alias("aligned"))


@register("jitter_grid", f"WITH {S} SELECT seq, (((ts - {SHIFT}) % 1000000007) + 1000000007) % 1000000007 AS jitter FROM S")
def jitter_grid(s: DataFrame) -> DataFrame:
    return s.select("seq", Aligner(1_000_000_007).jitter(_about_zero(s)).alias("jitter"))


@register("ptp_correct", f"WITH {S} SELECT seq, ts - 1500 - 250 AS corrected, {sql_floor('(ts - 1500 - 250)', 1000000)} AS aligned FROM S")
def ptp_correct(s: DataFrame) -> DataFrame:
    a = Aligner(1_000_000, 1500, 250)
    return s.select("seq", a.correct(F.col("ts")).alias("corrected"), a.align(F.col("ts")).alias("aligned"))


@register("align_saturates", f"WITH {S} SELECT seq, CAST(-9223372036854775808 AS BIGINT) AS aligned, CAST(9223372036854775807 AS BIGINT) AS corrected FROM S")
def align_saturates(s: DataFrame) -> DataFrame:
    """Times within 50 ns of either end of the range."""
    low, high = F.lit(-(2**63)).cast("long") + F.col("ts") % 50, F.lit(2**63 - 1).cast("long") - F.col("ts") % 50
    return s.select("seq", Aligner(10, 100).align(low).alias("aligned"), Aligner(10, -100).correct(high).alias("corrected"))


@register("lag_us", f"WITH {S} SELECT seq, greatest({T1} - ts, 0) // 1000 AS lag_us FROM S")
def lag(s: DataFrame) -> DataFrame:
    return s.select("seq", lag_us(T1, F.col("ts")).alias("lag_us"))


@register("replay_schedule", f"WITH {S}, D AS {first_of(f'(SELECT * FROM S WHERE {RANGE_SQL})')} SELECT ts, value, CAST(trunc(greatest(ts - (SELECT min(ts) FROM D), 0) / 4.0) AS BIGINT) AS due_ns FROM D")
def replay_schedule(s: DataFrame) -> DataFrame:
    found = scan(s, 3, T0, T1, ordered=False)
    return found.crossJoin(F.broadcast(found.agg(F.min("ts").alias("first")))).select("ts", "value", due_ns(F.col("ts"), F.col("first"), 4.0).alias("due_ns"))


@register("json_field_extract", f"WITH {S} SELECT seq, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, CAST(NULL AS DOUBLE) AS missing FROM S")
def json_field_extract(s: DataFrame) -> DataFrame:
    return s.select("seq", FieldSelector.parse("/k").extract(F.col("props")).alias("k"), FieldSelector.parse("k/x[1]").extract(F.col("props")).alias("missing"))


@register(
    "json_nested_extract",
    f"""WITH {S}, P AS (SELECT seq, '{{"pose":{{"x":[1,' || CAST(series AS VARCHAR) || ',{{"y":' || CAST(seq AS VARCHAR) || '}}]}},"s":"5","b":true}}' AS p FROM S)
    SELECT seq, CAST(json_extract_string(p, '$.pose.x[1]') AS DOUBLE) AS a, CAST(json_extract_string(p, '$.pose.x[2].y') AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS text, CAST(NULL AS DOUBLE) AS flag FROM P""",
)
def json_nested_extract(s: DataFrame) -> DataFrame:
    p = F.concat(F.lit('{"pose":{"x":[1,'), F.col("series").cast("string"), F.lit(',{"y":'), F.col("seq").cast("string"), F.lit('}]},"s":"5","b":true}'))
    fields = {"a": "pose/x[1]", "b": "/pose/x[2]/y", "text": "s", "flag": "b"}
    return s.select("seq", *[FieldSelector.parse(f).extract(p).alias(n) for n, f in fields.items()])


@register("segment_name_parse", f"WITH {S} SELECT DISTINCT series, 'seg-' || lpad(CAST(seq % 50 AS VARCHAR), 6, '0') || '-s' || CAST(series AS VARCHAR) || '.seg' AS name, seq % 50 AS seg_seq FROM S")
def segment_name_parse(s: DataFrame) -> DataFrame:
    names = s.select(segment_name(F.col("seq") % 50, F.col("series")).alias("name")).distinct()
    return names.withColumn("p", parse_segment_name(F.col("name"))).filter(valid_name(F.col("name"))).select("p.series", "name", "p.seg_seq")


@register("catalog_line_parse", f"WITH {S} SELECT 'n' || CAST(seq AS VARCHAR) AS name, series, ts AS min_ts, ts + 5 AS max_ts, CAST(7 AS BIGINT) AS count FROM S WHERE seq % 3 <> 0")
def catalog_line_parse(s: DataFrame) -> DataFrame:
    tag = F.when(F.col("seq") % 3 == 0, "B").otherwise("A")
    line = F.concat_ws(" ", tag, F.concat(F.lit("n"), F.col("seq").cast("string")), *[c.cast("string") for c in (F.col("series"), F.col("ts"), F.col("ts") + 5, F.lit(1), F.lit(2), F.lit(7))])
    return s.select(parse_catalog_line(line).alias("c")).filter("c is not null").select("c.name", "c.series", "c.min_ts", "c.max_ts", "c.count")


# --- resampling ---

def _scaled(s: DataFrame) -> DataFrame:
    """Series 3 and 7 on a clock on which a month lasts less than an hour, so that kHz grids have a few thousand frames."""
    return s.withColumn("ts", floor_div(F.col("ts") - F.lit(BASE), 3_000_000))


SCALED = f"(SELECT series, (ts - {BASE}) // 3000000 AS ts, value, seq FROM S)"
FIXED = EpisodeSpec("fixed", (("a.pos", 3), ("b", 7), ("a2", 3)), 1_000_000, 860_000_000, 1000)
UNION = EpisodeSpec("union", (("a", 3), ("b", 7)), 1_000_000, 860_000_000)
_N = frame_count(FIXED.start, FIXED.end, FIXED.frame_hz)
_G = f"G AS (SELECT i AS frame, {FIXED.start} + (i * 1000000000) // {FIXED.frame_hz} AS timestamp FROM range({_N}) t(i))"


def _lane(name: str, series: int) -> str:
    return f"{name} AS (SELECT ts, value FROM {first_of(f'(SELECT * FROM {SCALED} WHERE series = {series} AND ts BETWEEN {FIXED.start} AND {FIXED.end})')})"


FRAMES_SQL = f"""WITH {S}, {_lane('A', 3)}, {_lane('B', 7)}, {_G},
V AS (SELECT G.frame, G.timestamp, A.value AS a, B.value AS b FROM G ASOF LEFT JOIN A ON G.timestamp >= A.ts ASOF LEFT JOIN B ON G.timestamp >= B.ts),
C AS (SELECT frame, count(*) FILTER (WHERE s = 3) AS n0, count(*) FILTER (WHERE s = 7) AS n1 FROM
  (SELECT 3 AS s, ts FROM A UNION ALL SELECT 7, ts FROM B) x ASOF JOIN G ON G.timestamp >= x.ts GROUP BY frame)"""
NAN = "CAST('nan' AS DOUBLE)"


@register("resample_lvcf_fixed", f"{FRAMES_SQL} SELECT CAST(frame AS BIGINT) AS frame, CAST(timestamp AS BIGINT) AS timestamp, coalesce(a, -1) AS a_pos, coalesce(b, -1) AS b, coalesce(a, -1) AS a2 FROM V")
def resample_lvcf_fixed(s: DataFrame) -> DataFrame:
    f = resample.frames(_scaled(s), FIXED)
    return f.select("frame", "timestamp", *[F.nanvl(F.col(c), F.lit(-1.0)).alias(n) for c, n in (("`a.pos`", "a_pos"), ("b", "b"), ("a2", "a2"))])


@register(
    "frame_sample_counts",
    f"""WITH {S}, D AS {first_of(f'(SELECT * FROM {SCALED} WHERE series IN (3, 7) AND ts BETWEEN {FIXED.start} AND {FIXED.end})')},
    K AS (SELECT CAST(ceil(CAST(ts - {FIXED.start} AS DECIMAL(38,0)) * {FIXED.frame_hz} / 1000000000.0) AS BIGINT) AS frame, series FROM D)
    SELECT CAST(i AS BIGINT) AS frame, CAST(2 * count(*) FILTER (WHERE series = 3) + count(*) FILTER (WHERE series = 7) AS BIGINT) AS frame_samples, count(*) FILTER (WHERE series = 3) AS n0, count(*) FILTER (WHERE series = 7) AS n1
    FROM range({_N}) t(i) LEFT JOIN K ON K.frame = i GROUP BY i""",
)
def frame_sample_counts(s: DataFrame) -> DataFrame:
    return resample.frames(_scaled(s), FIXED).select("frame", "frame_samples", "n0", "n1")


@register(
    "resample_union_grid",
    f"""WITH {S}, D AS {first_of(f'(SELECT * FROM {SCALED} WHERE series IN (3, 7) AND ts BETWEEN {UNION.start} AND {UNION.end})')},
    U AS (SELECT ts AS timestamp, max(value) FILTER (WHERE series = 3) AS a, max(value) FILTER (WHERE series = 7) AS b, count(*) AS frame_samples FROM D GROUP BY ts)
    SELECT timestamp, coalesce(last_value(a IGNORE NULLS) OVER w, -1) AS a, coalesce(last_value(b IGNORE NULLS) OVER w, -1) AS b, frame_samples FROM U WINDOW w AS (ORDER BY timestamp ROWS UNBOUNDED PRECEDING)""",
)
def resample_union_grid(s: DataFrame) -> DataFrame:
    return resample.frames(_scaled(s), UNION).select("timestamp", F.nanvl("a", F.lit(-1.0)).alias("a"), F.nanvl("b", F.lit(-1.0)).alias("b"), "frame_samples")


@register(
    "column_stats",
    f"""{FRAMES_SQL}, L AS (SELECT 'a.pos' AS column, a AS v, frame FROM V UNION ALL SELECT 'b', b, frame FROM V UNION ALL SELECT 'a2', a, frame FROM V)
    SELECT L.column, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, count(v) AS count, count(*) AS frames FROM L GROUP BY L.column""",
)
def column_statistics(s: DataFrame) -> DataFrame:
    return resample.column_stats(resample.frames(_scaled(s), FIXED), FIXED).select("column", "min", "max", rounded("mean"), "count", "frames")


# --- gaps, episodes, trends ---

GAPS = f"G AS (SELECT *, ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) AS gap FROM {first_of('S')})"


@register("gap_analysis", f"WITH {S}, {GAPS} SELECT series, count(*) AS samples, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap_ns, round(avg(gap) / 1e9, 3) AS mean_gap_s FROM G GROUP BY series")
def gap_analysis(s: DataFrame) -> DataFrame:
    return quality.gap_report(s).select("series", "samples", "max_gap_ns", F.round(F.col("mean_gap_ns") / 1e9, 3).alias("mean_gap_s"))


SESSION = f"R AS (SELECT series, ts, coalesce(sum(CASE WHEN gap > {10 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts), 0) AS session FROM G)"


@register("interruption_sessions", f'WITH {S}, {GAPS}, {SESSION} SELECT series, CAST(session AS BIGINT) AS session, min(ts) AS "start", max(ts) AS "end", count(*) AS samples FROM R GROUP BY series, session')
def interruption_sessions(s: DataFrame) -> DataFrame:
    return quality.sessions(s, HOUR)


MARKERS = "(SELECT 0 AS series, ts, CASE event_type WHEN 'signup' THEN 1.0 ELSE 0.0 END AS value, seq FROM S WHERE event_type IN ('signup', 'purchase'))"


@register(
    "episode_window",
    f'WITH {S}, L AS (SELECT max(ts) FILTER (WHERE value = 1) AS o, max(ts) FILTER (WHERE value = 0) AS c FROM {first_of(MARKERS)}) SELECT o AS "start", CASE WHEN c > o THEN c ELSE 0 END AS "end" FROM L WHERE o IS NOT NULL',
)
def episode_window(s: DataFrame) -> DataFrame:
    marks = s.filter(F.col("event_type").isin("signup", "purchase")).select(F.lit(0).cast("long").alias("series"), "ts", F.when(F.col("event_type") == "signup", 1.0).otherwise(0.0).alias("value"), "seq")
    return quality.episode_window(marks)


RATE = 2 / 86_400


@register(
    "episode_verdict",
    f"""WITH {S}, C AS (SELECT CAST(i AS BIGINT) AS series, CASE WHEN i % 2 = 0 THEN CAST({RATE!r} AS DOUBLE) ELSE CAST({RATE / 2!r} AS DOUBLE) END AS rate FROM range(1, 40) t(i)),
    P AS (SELECT *, CAST(floor(1e9 / rate) AS BIGINT) AS period FROM C),
    G AS (SELECT D.series, D.ts, D.ts - lag(D.ts) OVER (PARTITION BY D.series ORDER BY D.ts) AS gap, period FROM {first_of(f'(SELECT * FROM S WHERE ts BETWEEN {T0} AND {T1})')} D JOIN P ON P.series = D.series),
    A AS (SELECT series, count(*) AS actual, max(gap) AS g, count(*) FILTER (WHERE gap > 10 * period) AS i, sum(gap - period) FILTER (WHERE gap > 10 * period) AS d FROM G GROUP BY series),
    V AS (SELECT P.series, rate, CAST(trunc(CAST({T1 - T0} - coalesce(d, 0) AS DOUBLE) * rate / 1e9) AS BIGINT) AS expected, coalesce(actual, 0) AS actual, coalesce(g, 0) AS max_gap_ns, coalesce(i, 0) AS interruptions, CAST(coalesce(d, 0) AS BIGINT) AS downtime_ns FROM P LEFT JOIN A ON A.series = P.series)
    SELECT series, rate, expected, CAST(actual AS BIGINT) AS actual, CAST(max_gap_ns AS BIGINT) AS max_gap_ns, CAST(interruptions AS BIGINT) AS interruptions, downtime_ns, abs(actual - expected) <= 3 AS ok FROM V""",
)
def episode_verdict(s: DataFrame) -> DataFrame:
    channels = s.sparkSession.range(1, 40).select(F.col("id").alias("series"), F.when(F.col("id") % 2 == 0, F.lit(RATE)).otherwise(F.lit(RATE / 2)).alias("rate"))
    return quality.verdicts(s, channels, T0, T1)


@register("trend_mean_clamped", f"WITH {S}, D AS {first_of(f'(SELECT * FROM S WHERE ts BETWEEN {T0} AND {T1})')} SELECT series, count(*) AS samples, greatest(-3000.0, least(3000.0, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) * -0.5)) AS target FROM D GROUP BY series HAVING count(*) >= 20")
def trend_mean_clamped(s: DataFrame) -> DataFrame:
    """Of values in whole hundredths, whose sum is exact in any order."""
    return quality.trend(s.withColumn("value", F.round(F.col("value") * 100)), T0, T1, 20, -0.5, 3000.0)


@register(
    "derivative_last_two",
    f"""WITH {S}, D AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS r, lead(ts) OVER (PARTITION BY series ORDER BY ts DESC) AS pt, lead(value) OVER (PARTITION BY series ORDER BY ts DESC) AS pv FROM {first_of('S')})
    SELECT series, round((value - pv) / (greatest(ts - pt, 1) / 1e9), 9) AS slope FROM D WHERE r = 1 AND pt IS NOT NULL""",
)
def derivative_last_two(s: DataFrame) -> DataFrame:
    return quality.derivative(s).select("series", rounded("slope", 9))


@register("fresh_latest", f"WITH {S} SELECT series, ts, value FROM (SELECT * FROM S QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, seq) = 1) WHERE ts >= {BASE + 28 * DAY}")
def fresh_latest(s: DataFrame) -> DataFrame:
    return quality.fresh(latest(s), BASE + 28 * DAY)


@register("settled_samples", f"WITH {S} SELECT series, ts, value FROM S WHERE ts <= {T1} - 100000000")
def settled_samples(s: DataFrame) -> DataFrame:
    return quality.settled(s, T1).select("series", "ts", "value")


@register("catch_up_grid", f"WITH {S}, L AS (SELECT series, {sql_floor('max(ts)', HOUR)} AS a FROM S GROUP BY series) SELECT series, unnest(range(a, {BASE + 30 * DAY} + 1, {HOUR})) AS ts FROM L WHERE a <= {BASE + 30 * DAY}")
def catch_up_grid(s: DataFrame) -> DataFrame:
    state = s.groupBy("series").agg(F.max("ts").alias("ts")).select("series", Aligner(HOUR).align(F.col("ts")).alias("next_ts"))
    return quality.catch_up(state, BASE + 30 * DAY, 1 / 3600)


#: The bits of a double in SQL: sign, exponent and fraction, by exact divisions by powers of two.
_BITS = """X AS (SELECT series, ts, abs(value) AS a, value < 0 AS neg, CASE WHEN value = 0 THEN 0 ELSE CAST(floor(log2(abs(value))) AS INTEGER) END AS e0 FROM D),
Y AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN a / pow(2.0, e0) >= 2 THEN e0 + 1 WHEN a / pow(2.0, e0) < 1 THEN e0 - 1 ELSE e0 END AS e FROM X),
V AS (SELECT series, ts, (CASE WHEN neg THEN CAST(9223372036854775808 AS HUGEINT) ELSE 0 END) + CASE WHEN a = 0 THEN 0 ELSE CAST(e + 1023 AS HUGEINT) * 4503599627370496 + CAST((a / pow(2.0, e) - 1) * 4503599627370496.0 AS HUGEINT) END AS bits FROM Y)"""
_LE = "list_transform(range({n}), lambda i: CAST(({x} // CAST(pow(256.0, i) AS HUGEINT)) % 256 AS HUGEINT))"


@register(
    "fnv_digest",
    f"""WITH {S}, D AS {first_of('S')}, {_BITS},
    B AS (SELECT series, ts, list_concat(list_concat({_LE.format(n=4, x='CAST(series AS HUGEINT)')}, {_LE.format(n=8, x='CAST(ts AS HUGEINT)')}), {_LE.format(n=8, x='bits')}) AS b FROM V),
    L AS (SELECT series, flatten(list(b ORDER BY ts)) AS b FROM B GROUP BY series)
    SELECT series, lower(lpad(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), b), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) AS digest FROM L""",
)
def fnv_digest(s: DataFrame) -> DataFrame:
    return quality.digest(s)


#: One step a write; t holds a struct for each series in memory: its id, its last write and its samples.
LRU_SQL = f"""WITH RECURSIVE {S}, W AS (SELECT row_number() OVER (ORDER BY seq) AS i, CAST(seq AS BIGINT) AS seq, series FROM S),
R AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s BIGINT, l BIGINT, n BIGINT)[]) AS t, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS victim
  UNION ALL SELECT i, list_append(list_filter(t, lambda x: x.s <> series), {{'s': series, 'l': i, 'n': 1 + coalesce(list_sum(list_transform(list_filter(t, lambda x: x.s = series), lambda x: x.n)), 0)::BIGINT}}), size - gone + 1, victim
  FROM (SELECT W.i, series, R.size, CASE WHEN full_ THEN list_filter(R.t, lambda x: x.l <> low) ELSE R.t END AS t, CASE WHEN full_ THEN list_filter(R.t, lambda x: x.l = low)[1].n ELSE 0 END AS gone, CASE WHEN full_ THEN list_filter(R.t, lambda x: x.l = low)[1].s END AS victim
    FROM (SELECT *, size >= 500 AS full_, list_min(list_transform(t, lambda x: x.l)) AS low FROM R) R JOIN W ON W.i = R.i + 1))
SELECT seq, series, R.victim FROM R JOIN W ON W.i = R.i"""
register("lru_simulation", LRU_SQL)(lambda s: simulate(s, 500))


# --- statistics ---

CENTS = "LAT AS (SELECT event_type AS variant, CAST(round(value * 100) AS BIGINT) AS ns FROM events)"
ORDERED = "O AS (SELECT variant, ns, row_number() OVER (PARTITION BY variant ORDER BY ns) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM LAT)"


def latencies(s: DataFrame) -> DataFrame:
    return s.select(F.col("event_type").alias("variant"), F.round(F.col("value") * 100).cast("long").alias("ns"))


_PERCENTILES = {
    "pct_nearest_rank": ("nearest", 0.99, "(n * 99 + 99) // 100 - 1"),
    "pct_rounded": ("rounded", 0.999, "CAST(floor((n - 1) * 0.999 + 0.5) AS BIGINT)"),
    "pct_truncated": ("truncated", 0.95, "CAST(floor((n - 1) * 0.95) AS BIGINT)"),
    "upper_median": ("upper_median", 0.5, "n // 2"),
}
for _n, (_kind, _q, _i) in _PERCENTILES.items():
    register(_n, f"WITH {CENTS}, {ORDERED} SELECT variant, ns AS p FROM O WHERE i = {_i}")(lambda s, k=_kind, q=_q: stats.percentile(latencies(s), "variant", "ns", q, k, "p"))


@register("pct_sliding_window", f"WITH {S}, W AS (SELECT series, CAST(round(value * 100) AS BIGINT) AS ns FROM S QUALIFY row_number() OVER (PARTITION BY series ORDER BY seq DESC) <= 32), O AS (SELECT series, ns, row_number() OVER (PARTITION BY series ORDER BY ns) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM W) SELECT series, ns AS p FROM O WHERE i = (n * 99 + 99) // 100 - 1")
def pct_sliding_window(s: DataFrame) -> DataFrame:
    last = stats.sliding(s.select("series", "seq", F.round(F.col("value") * 100).cast("long").alias("ns")), "series", "seq", 32)
    return stats.percentile(last, "series", "ns", 0.99, "nearest", "p")


HDR_SQL = """H AS (SELECT variant, greatest(ns, 1) AS v, greatest(length(bin(greatest(ns, 1))) - 11, 0) AS d FROM LAT),
C AS (SELECT variant, ((v >> d) + 1) * (CAST(1 AS BIGINT) << d) - 1 AS value, count(*) AS n FROM H GROUP BY variant, 2),
R AS (SELECT *, sum(n) OVER (PARTITION BY variant ORDER BY value) AS upto, sum(n) OVER (PARTITION BY variant) AS every FROM C)
SELECT variant, q, value FROM R, (VALUES (CAST(0.5 AS DOUBLE)), (0.99), (0.999)) t(q) WHERE upto >= greatest(ceil(q * every), 1) AND upto - n < greatest(ceil(q * every), 1)"""


@register("hdr_quantiles", f"WITH {CENTS}, {HDR_SQL}")
def hdr_quantiles(s: DataFrame) -> DataFrame:
    return stats.quantile_sketch(latencies(s), "variant", "ns", [0.5, 0.99, 0.999])


@register("jitter_stats", f"WITH {CENTS}, {ORDERED} SELECT variant, any_value(n) AS n, round(avg(ns), 4) AS mean, round(stddev_pop(ns), 4) AS stddev, greatest(max(ns) FILTER (WHERE i = floor((n - 1) * 0.999 + 0.5)) - max(ns) FILTER (WHERE i = floor((n - 1) * 0.5 + 0.5)), 0) AS jitter FROM O GROUP BY variant")
def jitter_stats(s: DataFrame) -> DataFrame:
    d = latencies(s)
    hi, lo = (stats.percentile(d, "variant", "ns", q, "rounded", n) for q, n in ((0.999, "hi"), (0.5, "lo")))
    out = stats.spread(d, "variant", "ns").join(hi, "variant").join(lo, "variant")
    return out.select("variant", "n", rounded("mean"), rounded("stddev"), F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast("long").alias("jitter"))


LIMITS = {"over_1k": 1_000, "over_5k": 5_000, "over_10k": 10_000, "over_50k": 50_000}


@register("exceedance", f"WITH {CENTS} SELECT variant, " + ", ".join(f"avg(CASE WHEN ns > {x} THEN 1.0 ELSE 0.0 END) AS {n}" for n, x in LIMITS.items()) + " FROM LAT GROUP BY variant")
def exceedance(s: DataFrame) -> DataFrame:
    return stats.exceedance(latencies(s), "variant", "ns", LIMITS)


GPD = f"""{CENTS}, {ORDERED}, U AS (SELECT variant, ns AS u FROM O WHERE i = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT)),
E AS (SELECT L.variant, any_value(u) AS u, count(*) AS n, count(*) FILTER (WHERE ns > u) AS n_u, avg(CAST(ns - u AS DOUBLE)) FILTER (WHERE ns > u) AS m, var_pop(CAST(ns - u AS DOUBLE)) FILTER (WHERE ns > u) AS v FROM LAT L JOIN U ON U.variant = L.variant GROUP BY L.variant),
F AS (SELECT *, CASE WHEN n_u >= 50 AND m > 0 AND v > 0 THEN 0.5 * (1 - m * m / v) END AS xi, CASE WHEN n_u >= 50 AND m > 0 AND v > 0 THEN 0.5 * m * (m * m / v + 1) END AS beta FROM E)"""


def _fit(s: DataFrame) -> DataFrame:
    d = latencies(s)
    return stats.gpd_fit(d, "variant", "ns", stats.percentile(d, "variant", "ns", 0.9, "rounded", "u"))


@register("gpd_fit", f"WITH {GPD} SELECT variant, u, n, n_u, round(xi, 6) AS xi, round(beta, 4) AS beta FROM F")
def gpd(s: DataFrame) -> DataFrame:
    return _fit(s).select("variant", "u", "n", "n_u", rounded("xi", 6), rounded("beta", 4))


LEVELS = {"rl_1e6": 1e6, "rl_1e7": 1e7, "rl_1e8": 1e8}
LEVEL_SQL = ", ".join(f"round(CASE WHEN {x!r} * n_u / n <= 1 THEN u WHEN abs(xi) < 1e-9 THEN u + beta * ln({x!r} * n_u / n) ELSE u + beta / xi * (pow({x!r} * n_u / n, xi) - 1) END, 2) AS {k}" for k, x in LEVELS.items())


@register("return_levels", f"WITH {GPD} SELECT variant, {LEVEL_SQL} FROM F")
def return_levels(s: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("n", "n_u", "u", "xi", "beta")]
    return _fit(s).select("variant", *[F.round(stats.return_level(F.lit(x), *c), 2).alias(k) for k, x in LEVELS.items()])


# --- message binding ---

BOUND = {"purchase": (101, True), "signup": (102, False), "view": (103, False)}
BINDING_SQL = "B AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {s}, {str(d).lower()})" for t, (s, d) in BOUND.items()) + ") t(topic, series, durable))"
MESSAGE_SQL = f"{S}, {BINDING_SQL}, M AS (SELECT S.seq, S.event_type AS topic, S.ts, CASE WHEN S.seq % 10 = 0 THEN '{{\"k\": \"text\"}}' ELSE props END AS p FROM S), J AS (SELECT M.*, B.series, B.durable, CASE WHEN B.series IS NOT NULL AND json_type(p, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(p, '$.k') AS DOUBLE) END AS value FROM M LEFT JOIN B ON B.topic = M.topic)"


def _bound(s: DataFrame) -> DataFrame:
    rows = [(t, x, d, "k") for t, (x, d) in BOUND.items()]
    bindings = s.sparkSession.createDataFrame(rows, "topic string, series long, durable boolean, field string")
    payload = F.when(F.col("seq") % 10 == 0, F.lit('{"k": "text"}')).otherwise(F.col("props"))
    return bind(s.select("seq", F.col("event_type").alias("topic"), "ts", payload.alias("payload")), bindings)


@register("topic_binding_join", f"WITH {MESSAGE_SQL} SELECT seq, topic, CAST(series AS BIGINT) AS series, value, durable, (value IS NULL) AS skipped FROM J")
def topic_binding_join(s: DataFrame) -> DataFrame:
    return _bound(s).select("seq", "topic", "series", "value", "durable", "skipped")


@register("bridge_counters", f"WITH {MESSAGE_SQL} SELECT count(*) AS received, count(value) AS written, count(*) - count(value) AS skipped, count(*) FILTER (WHERE durable AND value IS NOT NULL) AS durable FROM J")
def bridge_counters(s: DataFrame) -> DataFrame:
    return _bound(s).agg(F.count("*").alias("received"), F.count("value").alias("written"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"), F.count(F.when(F.col("durable") & ~F.col("skipped"), 1)).alias("durable"))


# --- segments ---

SEG = f"(ts - {BASE}) // {DAY}"
SEG_SQL = f"Z AS (SELECT series, {SEG} AS seg_seq, min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_val, max(value) AS max_val, count(*) AS count FROM S GROUP BY series, {SEG})"


def _segmented(s: DataFrame) -> DataFrame:
    return s.withColumn("seg_seq", floor_div(F.col("ts") - F.lit(BASE), DAY))


def _catalog(s: DataFrame) -> DataFrame:
    return zone_maps(_segmented(s), "series", "seg_seq")


@register("zone_maps", f"WITH {S}, {SEG_SQL} SELECT * FROM Z")
def zones(s: DataFrame) -> DataFrame:
    return _catalog(s)


@register("zone_prune", f"WITH {S}, {SEG_SQL} SELECT series, seg_seq FROM Z WHERE max_ts >= {T0} AND min_ts <= {T1} AND max_val > 120.0")
def zone_prune(s: DataFrame) -> DataFrame:
    return prune(_catalog(s), None, T0, T1, Pred.gt(120.0)).select("series", "seg_seq")


@register("zone_pruned_scan", f"WITH {S} SELECT series, ts, value FROM {first_of(f'(SELECT * FROM S WHERE ts BETWEEN {T0} AND {T1} AND value > 120.0)')}")
def zone_pruned_scan(s: DataFrame) -> DataFrame:
    alive = prune(_catalog(s), None, T0, T1, Pred.gt(120.0)).select("series", "seg_seq")
    return dedup(in_range(_segmented(s).join(alive, ["series", "seg_seq"], "left_semi"), T0, T1, Pred.gt(120.0)))


@register("segment_union_dedup", f"WITH {S}, X AS (SELECT series, {sql_floor('ts', DAY)} AS ts, value, seq % 3 AS seg, seq FROM S) SELECT series, ts, value FROM X QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY seg, seq) = 1")
def segment_union_dedup(s: DataFrame) -> DataFrame:
    return dedup(_by_day(s).withColumn("seg_seq", F.col("seq") % 3))


TIERED = "T AS (SELECT *, CASE WHEN (series + seg_seq) % 7 = 0 THEN 'cold' ELSE 'local' END AS tier FROM Z)"


def _tiered(s: DataFrame) -> DataFrame:
    return _catalog(s).withColumn("tier", F.when((F.col("series") + F.col("seg_seq")) % 7 == 0, "cold").otherwise("local"))


@register(
    "compaction_tail_plan",
    f"""WITH {S}, {SEG_SQL}, {TIERED}, N AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seg_seq) AS place FROM T),
    B AS (SELECT *, coalesce(max(CASE WHEN tier <> 'local' OR count > 2 THEN place END) OVER (PARTITION BY series), 0) AS stop FROM N),
    R AS (SELECT *, count(*) OVER (PARTITION BY series) AS k FROM B WHERE place > stop) SELECT series, seg_seq, count FROM R WHERE k >= 2""",
)
def compaction_tail_plan(s: DataFrame) -> DataFrame:
    return compaction_plan(_tiered(s), 2).select("series", "seg_seq", "count")


@register("archive_candidates", f"WITH {S}, {SEG_SQL}, {TIERED} SELECT series, seg_seq FROM T WHERE tier = 'local' AND max_ts < {T0}")
def archive_candidates(s: DataFrame) -> DataFrame:
    return archivable(_tiered(s), T0).select("series", "seg_seq")


@register("catalog_counts", f"WITH {S}, {SEG_SQL}, {TIERED} SELECT tier, count(*) AS segments, CAST(sum(count) AS BIGINT) AS rows FROM T GROUP BY tier")
def catalog_counts(s: DataFrame) -> DataFrame:
    return _tiered(s).groupBy("tier").agg(F.count("*").alias("segments"), F.sum("count").alias("rows"))


@register("time_overlap", f"WITH {S}, {SEG_SQL} SELECT series, seg_seq FROM Z WHERE max_ts >= {T0} AND min_ts <= {T0 + DAY}")
def time_overlap(s: DataFrame) -> DataFrame:
    return _catalog(s).filter(time_zone_overlaps(F.col("min_ts"), F.col("max_ts"), T0, T0 + DAY)).select("series", "seg_seq")


@register("committed_source", f"WITH {S}, X AS (SELECT CASE WHEN seq % 5 = 0 THEN 4294967295 ELSE series END AS series, ts, value FROM S) SELECT series, count(*) AS n FROM X WHERE series <> 4294967295 GROUP BY series")
def committed_source(s: DataFrame) -> DataFrame:
    marked = s.withColumn("series", F.when(F.col("seq") % 5 == 0, F.lit(SENTINEL_SERIES)).otherwise(F.col("series")))
    return committed(marked).groupBy("series").agg(F.count("*").alias("n"))


@register("aggregate_nan_safe", f"WITH {S}, X AS (SELECT series, CASE WHEN seq % 4 = 0 OR series % 10 = 0 THEN NULL ELSE value END AS v FROM S) SELECT series, coalesce(min(v), 1e308) AS lo, coalesce(max(v), -1e308) AS hi, CAST(count(*) AS DOUBLE) AS count FROM X GROUP BY series")
def aggregate_nan_safe(s: DataFrame) -> DataFrame:
    """NaN takes no part in minimum and maximum; a series of NaN alone gives infinities (shown as +-1e308)."""
    v = F.when((F.col("seq") % 4 == 0) | (F.col("series") % 10 == 0), F.lit(float("nan"))).otherwise(F.col("value"))
    out = s.withColumn("value", v).groupBy("series").agg(*aggregate_all(F.col("value")))
    return out.select("series", F.least("min", F.lit(1e308)).alias("lo"), F.greatest("max", F.lit(-1e308)).alias("hi"), "count")


# --- the store: written, changed and read again ---


def scratch(spark: SparkSession) -> str:
    """A new directory in the folder that driver and executors share; it goes when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewright-")
    path = f"{root.rstrip('/')}/db-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def _sealed(s: DataFrame, cold: bool = False) -> SegmentStore:
    """Three batches by seq % 3, sealed one after the other; day-aligned times make them overlap."""
    path = scratch(s.sparkSession)
    store = SegmentStore(s.sparkSession, path, f"{path}/cold" if cold else None)
    for k in range(3):
        store.seal(_by_day(s).filter(F.col("seq") % 3 == k))
    return store


#: In SQL: a seal keeps the first writer of a time; of segments the first one's sample is visible, after the predicate.
SEALED_SQL = f"Q AS (SELECT * FROM (SELECT series, {sql_floor('ts', DAY)} AS ts, value, seq % 3 + 1 AS seg_seq, seq FROM S) QUALIFY row_number() OVER (PARTITION BY series, ts, seg_seq ORDER BY seq) = 1)"
VISIBLE_SQL = "SELECT series, ts, value FROM (SELECT * FROM Q WHERE {cond}) QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY seg_seq) = 1"
_MERGED_SQL = f"WITH {S}, {SEALED_SQL} {VISIBLE_SQL.format(cond=f'ts BETWEEN {T0} AND {T1} AND value > 50.0')}"


@register("store_scan", _MERGED_SQL)
def store_scan(s: DataFrame) -> DataFrame:
    return _sealed(s).visible(None, T0, T1, Pred.gt(50.0))


@register("compact_identity", _MERGED_SQL)
def compact_identity(s: DataFrame) -> DataFrame:
    """A predicated scan after the segments were merged: duplicates survive the merge, in their order of writing."""
    store = _sealed(s)
    store.compact()
    return store.visible(None, T0, T1, Pred.gt(50.0))


_ZONES_SQL = "min(ts) AS min_ts, max(ts) AS max_ts, min(value) AS min_val, max(value) AS max_val, count(*) AS count"


@register("store_catalog", f"WITH {S}, {SEALED_SQL} SELECT 'seg-' || lpad(CAST(seg_seq AS VARCHAR), 6, '0') || '-s' || CAST(series AS VARCHAR) || '.seg' AS name, series, seg_seq, {_ZONES_SQL}, 'local' AS tier FROM Q GROUP BY series, seg_seq")
def store_catalog(s: DataFrame) -> DataFrame:
    return _sealed(s).catalog().drop("home", "distinct", "mates")


@register("store_compacted_catalog", f"WITH {S}, {SEALED_SQL}, M AS (SELECT series, count(DISTINCT seg_seq) AS parts, max(seg_seq) AS last, {_ZONES_SQL} FROM Q GROUP BY series) SELECT series, CASE WHEN parts > 1 THEN 4 ELSE last END AS seg_seq, min_ts, max_ts, min_val, max_val, count FROM M")
def store_compacted_catalog(s: DataFrame) -> DataFrame:
    store = _sealed(s)
    store.compact()
    return store.catalog().select("series", "seg_seq", "min_ts", "max_ts", "min_val", "max_val", "count")


def _in_thirds(s: DataFrame) -> SegmentStore:
    """Batches of ten days each, of which the first is archived."""
    path = scratch(s.sparkSession)
    store = SegmentStore(s.sparkSession, path, f"{path}/cold")
    for k in range(3):
        lo = F.col("ts") >= BASE + 10 * k * DAY if k else F.lit(True)
        store.seal(s.filter(lo & (F.col("ts") < BASE + 10 * (k + 1) * DAY if k < 2 else F.lit(True))))
    store.archive_older_than(BASE + 10 * DAY)
    return store


@register("store_archived_scan", f"WITH {S} SELECT series, ts, value FROM {first_of(f'(SELECT * FROM S WHERE ts BETWEEN {T0} AND {T1})')}")
def store_archived_scan(s: DataFrame) -> DataFrame:
    """Local and archived segments in one scan."""
    return _in_thirds(s).visible(None, T0, T1)


@register("store_tiers", f"WITH {S}, D AS {first_of('S')}, P AS (SELECT series, least(greatest((ts - {BASE}) // {10 * DAY}, 0), 2) AS k, count(*) AS n FROM D GROUP BY ALL) SELECT CASE WHEN k = 0 THEN 'cold' ELSE 'local' END AS tier, count(*) AS segments, CAST(sum(n) AS BIGINT) AS rows FROM P GROUP BY 1")
def store_tiers(s: DataFrame) -> DataFrame:
    return _in_thirds(s).catalog().groupBy("tier").agg(F.count("*").alias("segments"), F.sum("count").alias("rows"))


@register("store_reopened_latest", f"WITH {S}, {SEALED_SQL} SELECT series, ts, value FROM Q QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, seg_seq) = 1")
def store_reopened_latest(s: DataFrame) -> DataFrame:
    """Merged, cleaned up and opened anew."""
    store = _sealed(s)
    store.compact()
    store.vacuum()
    return latest(SegmentStore(s.sparkSession, store.root).samples(None, -(2**63), 2**63 - 1))


def _reopened(s: DataFrame) -> Db:
    """An engine with everything sealed and three single writes in its log, opened again without a seal: two new times, and one that is taken."""
    path = scratch(s.sparkSession)
    db = Db(path, spark=s.sparkSession)
    db.ingest(s)
    taken = db.latest(3)[0]
    for ts, value in ((T0, 1.0), (T0 + 1, 2.0), (taken, 3.0)):
        db.put(3, ts, value)
    db.flush()
    return Db(path, spark=s.sparkSession)


_LOGGED = f"W AS (SELECT series, ts, value, seq FROM S UNION ALL SELECT 3, {T0}, 1.0, 1000000000000 UNION ALL SELECT 3, {T0 + 1}, 2.0, 1000000000001)"


@register("db_replayed_scan", f"WITH {S}, {_LOGGED} SELECT ts, value FROM {first_of(f'(SELECT * FROM W WHERE {RANGE_SQL})')}")
def db_replayed_scan(s: DataFrame) -> DataFrame:
    return _reopened(s).scan_frame(3, T0, T1)


@register("db_replayed_avg", f"WITH {S}, {_LOGGED} SELECT CAST({T0} AS BIGINT) AS ts, round(avg(value), 8) AS value FROM {first_of(f'(SELECT * FROM W WHERE {RANGE_SQL} AND value BETWEEN 1.5 AND 60.0)')} HAVING count(*) > 0")
def db_replayed_avg(s: DataFrame) -> DataFrame:
    return _reopened(s).scan_frame(3, T0, T1, Pred.between(1.5, 60.0), "avg").select("ts", rounded("value", 8))


@register("segment_files", f"WITH {S} SELECT series, ts, value FROM {first_of('S')} WHERE ts BETWEEN {T0} AND {T1}")
def segment_files(s: DataFrame) -> DataFrame:
    """Binary segment files, written and read."""
    return unpack(pack(dedup(s)), T0, T1).select("series", "ts", "value")


@register("log_files", f"WITH {S} SELECT series, ts, value, CAST(seq AS BIGINT) AS seq FROM (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY seq) - 1 AS seq, count(*) OVER (PARTITION BY series) AS n FROM S) WHERE series % 5 <> 0 OR seq < n - 1")
def log_files(s: DataFrame) -> DataFrame:
    """Binary logs, of which every fifth lost its last byte: the frame it belongs to is not read."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        data = encode_frames([(int(x), int(t), float(v)) for x, t, v in pdf.sort_values("seq")[["series", "ts", "value"]].itertuples(index=False)])
        series = int(pdf["series"].iloc[0])
        return pd.DataFrame({"path": [str(series)], "content": [data[:-1] if series % 5 == 0 else data]})

    logs = s.select("series", "ts", "value", "seq").groupBy("series").applyInPandas(write, "path string, content binary")
    return frames_in(logs).select("series", "ts", "value", "seq")


@register("episode_export", f"{FRAMES_SQL} SELECT CAST(timestamp AS BIGINT) AS timestamp, coalesce(a, -1) AS a_pos, coalesce(b, -1) AS b, coalesce(a, -1) AS a2 FROM V")
def episode_export(s: DataFrame) -> DataFrame:
    """An exported episode file, read again."""
    root = scratch(s.sparkSession)
    export_episode(_scaled(s), FIXED, root)
    found = s.sparkSession.read.parquet(episode_path(root, 0))
    return found.select("timestamp", *[F.nanvl(F.col(c), F.lit(-1.0)).alias(n) for c, n in (("`a.pos`", "a_pos"), ("b", "b"), ("a2", "a2"))])


# --- streams: from files, until nothing is left ---


def _streamed(df: DataFrame, root: str) -> DataFrame:
    df.coalesce(1).write.parquet(f"{root}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{root}/in")


@register("stream_bridge", f"WITH {MESSAGE_SQL} SELECT CASE WHEN durable THEN 'durable' ELSE 'fast' END AS lane, CAST(series AS BIGINT) AS series, count(*) AS n, round(sum(value), 4) AS total FROM J WHERE value IS NOT NULL GROUP BY ALL")
def stream_bridge(s: DataFrame) -> DataFrame:
    """What the bridge's two lanes wrote."""
    root, spark = scratch(s.sparkSession), s.sparkSession
    payload = F.when(F.col("seq") % 10 == 0, F.lit('{"k": "text"}')).otherwise(F.col("props"))
    stream = _streamed(s.select(F.col("event_type").alias("topic"), "ts", payload.alias("payload")), root)
    bindings = spark.createDataFrame([(t, x, d, "k") for t, (x, d) in BOUND.items()], "topic string, series long, durable boolean, field string")
    query, _ = start_bridge(stream, bindings, f"{root}/checkpoint", batch_table(f"{root}/fast"), batch_table(f"{root}/durable"))
    query.awaitTermination()
    lanes = [spark.read.parquet(f"{root}/{lane}").select(F.lit(lane).alias("lane"), "series", "value") for lane in ("fast", "durable")]
    return lanes[0].unionByName(lanes[1]).groupBy("lane", "series").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("stream_first_writers", f"WITH {S} SELECT series, ts, value FROM {first_of(ALIGNED)}")
def stream_first_writers(s: DataFrame) -> DataFrame:
    root = scratch(s.sparkSession)
    found = first_writers(_streamed(_by_day(s).select("series", "ts", "value", "seq"), root), 100 * DAY)
    found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.sparkSession.read.schema("series long, ts long, value double").parquet(f"{root}/out")


@register("stream_latest", f"WITH {S} SELECT series, ts, value FROM {ALIGNED} QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC, seq) = 1")
def stream_latest(s: DataFrame) -> DataFrame:
    root = scratch(s.sparkSession)
    found = latest_values(_streamed(_by_day(s).select("series", "ts", "value", "seq"), root))
    write = found.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).start().awaitTermination()
    return s.sparkSession.read.parquet(f"{root}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, min, max, sum and avg of every series' visible samples in a range that meet a predicate."""
    return QUERIES["agg_by_series_pred"](spark, sf_dir)
