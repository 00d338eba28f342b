"""Storage, streaming, export, protocol and files."""

import json
import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewright.db import ChunkBuffer, Db
from tidewright.edge import EdgeConfig, EdgeNode
from tidewright.export import export_episode, main, stream_episode
from tidewright.functions.names import catalog_line
from tidewright.model import Config, CorruptError, EpisodeSpec, NotFoundError, ProtocolError
from tidewright.operators.predicates import Pred
from tidewright.operators.scan import scan
from tidewright.plans.store import SegmentStore
from tidewright.protocol import Put, Scan, _text, handle_line, parse_command, server
from tidewright.sources.files import archive_catalog, decode_frames, encode_frames, latencies, log_frames, mirror_datagram, parse_datagram
from tidewright.sources.generator import series_samples, workload
from tidewright.sources.segments import decode_segment, encode_segment, read_segments
from tidewright.sources.specs import load_bindings, parse_bindings, parse_episodes, save_bindings
from tidewright.streaming import ingest
from tidewright.streaming.lru import LruTable, drop_oldest, simulate
from tidewright.streaming.replay import Replay, schedule

BASE = 1_700_000_000_000_000_000


def store_with(spark, tmp_path, *segments, cold=False):
    store = SegmentStore(spark, str(tmp_path / "db"), str(tmp_path / "cold") if cold else None)
    for rows in segments:
        store.seal(spark.createDataFrame([(s, t, float(v), i) for i, (s, t, v) in enumerate(rows)], "series long, ts long, value double, seq long"))
    return store


def visible(store, series, t0, t1, pred=None):
    return [(r["ts"], r["value"]) for r in scan(store.samples(series, t0, t1, pred), series, t0, t1, pred).collect()]


def test_compaction_changes_no_scan(spark, tmp_path):
    store = store_with(spark, tmp_path, [(1, t, t) for t in range(100)], [(1, t, 1000 + t) for t in range(50, 150)], [(1, t, 2000 + t) for t in range(120, 180)] + [(2, 1, 1)])
    before = [visible(store, 1, 0, 999, p) for p in (None, Pred.gt(500), Pred.gt(2000), Pred.lt(60))]
    assert len(before[0]) == 180
    assert before[1][:1] == [(50, 1050.0)]
    assert store.catalog().count() == 4
    both = lambda: [sorted(tuple(r)[1:] for r in store.visible(1, 0, 999, p).collect()) for p in (None, Pred.gt(500), Pred.gt(2000), Pred.lt(60))]
    assert both() == before
    assert store.compact() == {"runs": 1, "input_segments": 3, "output_segments": 1, "rows": 260}
    assert store.catalog().count() == 2
    assert [visible(store, 1, 0, 999, p) for p in (None, Pred.gt(500), Pred.gt(2000), Pred.lt(60))] == before
    assert both() == before
    assert {r["series"]: r["distinct"] for r in store.catalog().collect()} == {1: False, 2: True}
    assert store.compact()["runs"] == 0
    assert store.vacuum() == 2
    assert visible(SegmentStore(spark, store.root), 1, 0, 999) == before[0]


def test_archive_and_zone_maps(spark, tmp_path):
    store = store_with(spark, tmp_path, [(1, t, 10) for t in range(100)], [(1, t, 20) for t in range(100, 200)], cold=True)
    before = visible(store, 1, 0, 500)
    assert store.archive_older_than(100) == 1
    assert store.archive_older_than(100) == 0
    assert visible(store, 1, 0, 500) == before
    clean = store.visible(None, 0, 500)
    assert sorted(tuple(r)[1:] for r in clean.collect()) == before
    assert "HashAggregate" not in clean._jdf.queryExecution().executedPlan().toString()
    bare = SegmentStore(spark, store.root)
    assert visible(bare, 1, 0, 500, Pred.between(50, 60)) == []  # pruned without the cold tier
    assert len(visible(bare, 1, 150, 500)) == 50
    with pytest.raises(NotFoundError):
        visible(bare, 1, 0, 500)


def test_concurrent_commits_do_not_overwrite(spark, tmp_path):
    store = store_with(spark, tmp_path, [(1, 1, 1)])
    with pytest.raises(NotFoundError):
        store._commit(store.catalog(), 0)


def test_facade(spark, tmp_path):
    db = Db(str(tmp_path / "db"), spark=spark)
    rows = [(1, BASE + 1000 * i, float(i)) for i in range(1000)]
    db.put_batch(rows)
    assert db.memtable_len == 1000
    assert db.latest(1) == (BASE + 999_000, 999.0)
    assert db.scan(1, BASE, BASE + 10**7, "avg") == [(BASE, 499.5)]
    assert db.put_durable(1, BASE + 1_000_000, 7.0) == 1001
    assert db.segment_count == 0
    db.seal()
    db.put(1, BASE + 1_000_000, 8.0)
    db.put(2, -5, 1.0)
    assert db.latest(1) == (BASE + 1_000_000, 7.0)
    again = Db(str(tmp_path / "db"), spark=spark)
    assert again.scan(1, BASE, BASE + 10**7, "count") == [(BASE, 1001.0)]
    assert again.latest(9) is None
    assert [r["lane"] for r in db.window([2, 1], -10, BASE + 1).collect()] == [0, 1]
    db.seal()
    assert db.compact() == 1
    assert db.compaction_stats()["input_segments"] == 2
    assert db.segment_count == 2
    with pytest.raises(CorruptError):
        db.put(2**32 - 1, 0, 0.0)
    with pytest.raises(CorruptError):
        Db(spark=spark)
    with pytest.raises(ValueError, match="sync"):
        Db(str(tmp_path), sync="never", spark=spark)


@pytest.mark.parametrize(("sync", "lost"), [("always", 0), ("group", 3), ("none", 8)])
def test_a_crash_loses_no_durable_sample(spark, tmp_path, sync, lost):
    """A new engine on the directory stands for the process after a kill: nothing was closed or sealed."""
    db = Db(str(tmp_path / "db"), sync=sync, group_interval_us=10**9, spark=spark)
    for i in range(5):
        db.put(1, i, float(i))
    if sync != "none":
        db.flush()
    for i in range(5, 8):
        db.put(1, i, float(i))
    assert db.durable_watermark == 8 - lost
    again = Db(str(tmp_path / "db"), spark=spark)
    assert again.scan(1, 0, 99) == [(i, float(i)) for i in range(8 - lost)]
    again.put(1, 0, 50.0)
    again.put(1, 9, 9.0)
    again.seal()
    last = Db(str(tmp_path / "db"), spark=spark)
    assert last.memtable_len == 0
    assert last.scan(1, 0, 99) == [(i, float(i)) for i in range(8 - lost)] * (lost < 8) + ([(0, 50.0)] if lost == 8 else []) + [(9, 9.0)]


def test_a_torn_log_ends_at_its_last_whole_frame(spark, tmp_path):
    db = Db(str(tmp_path / "db"), sync="always", spark=spark)
    for i in range(3):
        db.put(1, i, 1.0)
    (last,) = [p for p in (tmp_path / "db" / "log").glob("*3.log")]
    last.write_bytes(last.read_bytes()[:-1])
    for crc in (tmp_path / "db" / "log").glob(".*.crc"):
        crc.unlink()
    assert Db(str(tmp_path / "db"), spark=spark).scan(1, 0, 9, "count") == [(0, 2.0)]


def test_writers_lose_nothing_during_seals(spark, tmp_path):
    db = Db(str(tmp_path / "db"), sync="none", spark=spark)

    def write(lane):
        for i in range(300):
            db.put(lane, i, float(i))
            time.sleep(0.002)

    threads = [threading.Thread(target=write, args=(lane,)) for lane in (1, 2)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        db.seal()
    db.seal()
    assert db.memtable_len == 0
    assert [db.scan(lane, 0, 999, "count")[0][1] for lane in (1, 2)] == [300.0, 300.0]


def test_a_failed_seal_keeps_the_buffer(spark, tmp_path, monkeypatch):
    db = Db(str(tmp_path / "db"), spark=spark)
    db.put(1, 1, 1.0)
    monkeypatch.setattr(db.store, "seal", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        db.seal()
    assert db.scan(1, 0, 9) == [(1, 1.0)]
    assert Db(str(tmp_path / "db"), spark=spark).scan(1, 0, 9) == [(1, 1.0)]


def test_one_of_two_writers_commits(spark, tmp_path):
    store = store_with(spark, tmp_path, [(1, 1, 1)])
    both, found = threading.Barrier(2), []

    def commit():
        mine = SegmentStore(spark, store.root)
        base, catalog = mine.version(), mine.catalog()
        both.wait()
        try:
            mine._commit(catalog, base)
            found.append("done")
        except NotFoundError:
            found.append("lost")

    threads = [threading.Thread(target=commit) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == ["done", "lost"]
    assert store.version() == 2
    assert [size > 0 for _, size in store.listing()] == [True]


def test_numbers_of_the_protocol():
    assert [_text(v) for v in (float("nan"), float("inf"), 1e16, 1.5, -0.25, 3.0, 1e-7, 0.1)] == ["NaN", "inf", "10000000000000000", "1.5", "-0.25", "3", "0.0000001", "0.1"]


def test_last_line_of_a_name_counts(spark, tmp_path):
    path = tmp_path / "archive.log"
    path.write_text("\n".join([catalog_line("a", 1, 0, 5, 1.0, 2.0, 3), "broken", catalog_line("b", 1, 0, 5, float("nan"), 2.5, 3), catalog_line("a", 1, 0, 9, -1.0, 2.0, 4)]) + "\n")
    got = {r["name"]: (r["max_ts"], r["min_val"], r["count"]) for r in archive_catalog(spark, str(path)).collect()}
    assert got["a"] == (9, -1.0, 4)
    assert got["b"][1] != got["b"][1]


def test_deterministic_profile_evicts_series(spark):
    db = Db(config=Config.deterministic().with_(memtable_max=4), spark=spark)
    for row in [(1, 1, 1.0), (2, 1, 2.0), (1, 2, 1.5), (3, 1, 3.0), (3, 2, 3.5), (2, 5, 9.0)]:
        db.put(*row)
    assert (db.latest(1), db.latest(2), db.latest(3), db.lru_evictions) == (None, (5, 9.0), (2, 3.5), 2)


def test_lru_simulation(spark):
    rows = [(0, 1, 1, 1.0), (1, 2, 1, 2.0), (2, 1, 2, 1.5), (3, 3, 1, 3.0), (4, 3, 2, 3.5), (5, 2, 5, 9.0)]
    df = spark.createDataFrame(rows, "seq long, series long, ts long, value double")
    assert [r["victim"] for r in simulate(df, 4).orderBy("seq").collect()] == [None, None, None, None, 2, 1]
    assert drop_oldest(range(5), 3) == ([2, 3, 4], 2)
    assert LruTable(2).latest(1) is None


def test_chunk_buffer(spark, tmp_path):
    chunk = ChunkBuffer(Db(str(tmp_path / "db"), spark=spark), 2, 10)
    chunk.push(1, 0, 1.0)
    chunk.push(1, 10, 2.0)
    with pytest.raises(CorruptError):
        chunk.push(1, 20, 3.0)
    assert chunk.seal_chunk() == 2
    assert chunk.pending == 0
    assert chunk.db.scan(1, 0, 99) == [(0, 1.0), (10, 2.0)]


def test_edge_node_aligns(spark, tmp_path):
    assert EdgeConfig.safety_island().engine.data_dir is None
    assert EdgeConfig.planning().engine.cold_dir
    node = EdgeNode(EdgeConfig.cognition().with_(engine=Config(data_dir=str(tmp_path / "db")), align_ns=10), spark)
    node.ingest(1, 17, 1.0)
    node.ingest(1, -1, 2.0)
    node.ingest_table(spark.createDataFrame([(1, 25, 3.0, 0)], "series long, ts long, value double, seq long"))
    assert node.scan(1, -100, 100) == [(-10, 2.0), (10, 1.0), (20, 3.0)]
    assert node.health()["segments"] == 2
    with pytest.raises(CorruptError):
        EdgeNode(EdgeConfig.cognition().with_(align_ns=0), spark)


def test_protocol(spark, tmp_path):
    assert parse_command("  ") is None
    assert parse_command("put 3 1700000000 21.5") == Put(3, 1700000000, 21.5)
    assert parse_command("scan 3 0 100 max") == Scan(3, 0, 100, "max")
    for bad in ("put x 1 2", "put 1 x 2", "put 1 2 x", "scan 1 2", "scan 1 2 3 median", "drop 1", "put 99999999999 1 2"):
        with pytest.raises(ProtocolError):
            parse_command(bad)
    db = Db(str(tmp_path / "db"), spark=spark)
    assert handle_line(db, "put 3 10 21.5") == "OK\n"
    assert handle_line(db, "put 3 20 4") == "OK\n"
    assert handle_line(db, "scan 3 0 100") == "10 21.5\n20 4\nEND\n"
    assert handle_line(db, "scan 3 0 100 count") == "0 2\nEND\n"
    assert handle_line(db, "nope") == "ERR protocol error: unknown command: nope\n"


def test_protocol_server(spark, tmp_path):
    import socket

    out = server(("127.0.0.1", 0), Db(str(tmp_path / "db"), spark=spark))
    threading.Thread(target=out.serve_forever, daemon=True).start()
    with socket.create_connection(out.server_address) as c, c.makefile("rw") as f:
        f.write("put 1 5 2.5\nscan 1 0 9\n")
        f.flush()
        assert [f.readline() for _ in range(3)] == ["OK\n", "5 2.5\n", "END\n"]
    out.shutdown()


def test_export_layout_and_cli(spark, tmp_path, capsys):
    ms = 1_000_000
    store = store_with(spark, tmp_path, [(7, ms * i, i) for i in range(200)] + [(8, ms * i, 10_000 + i) for i in range(200)])
    toml = "[[episode]]\nname = 'demo'\nstart_ns = 0\nend_ns = 199000000\nframe_hz = 1000\n[[episode.series]]\ncolumn = 'joint0.pos'\nid = 7\n[[episode.series]]\ncolumn = 'b'\nid = 8\n"
    toml += toml.replace("demo", "late").replace("start_ns = 0", "start_ns = 199000001").replace("199000000\n", "199000001\n")
    (tmp_path / "e.toml").write_text(toml)
    out = tmp_path / "out"
    main(["--db", store.root, "--spec", str(tmp_path / "e.toml"), "--out", str(out)])
    assert "demo: 200 frames, 400 samples" in capsys.readouterr().out
    table = spark.read.parquet(str(out / "data/chunk-000/episode_000000.parquet"))
    assert table.columns == ["timestamp", "joint0.pos", "b"]
    assert table.count() == 200
    lines = [json.loads(x) for x in (out / "meta/episodes.jsonl").read_text().splitlines()]
    assert [(x["episode_index"], x["length"]) for x in lines] == [(0, 200), (1, 1)]
    stats = json.loads((out / "meta/stats.json").read_text())
    assert stats["columns"]["b"] == {"min": None, "max": None, "mean": None, "count": 0, "frames": 1}
    assert json.loads((out / "meta/info.json").read_text())["features"]["timestamp"]["dtype"] == "int64"


def test_spec_files(spark, tmp_path):
    for bad in ("[[episode]]\nname = 'x'", "[[episode]]\nnme = 1", "not toml ["):
        with pytest.raises(CorruptError):
            parse_episodes(bad)
    rows = [{"topic": "/a", "series": 7, "durable": True, "field": "effort[3]"}, {"topic": "b\"q", "series": 8, "durable": False, "field": "x"}]
    save_bindings(rows, str(tmp_path / "b.toml"))
    assert parse_bindings((tmp_path / "b.toml").read_text()) == rows
    assert load_bindings(spark, str(tmp_path / "b.toml")).count() == 2
    with pytest.raises(CorruptError):
        parse_bindings("[[bindings]]\ntopic='a'\nseries=1\nfield='x'\nqos=1")


def test_log_frames_stop_at_corruption(spark, tmp_path):
    data = encode_frames([(1, 5, 2.5), (2**32 - 1, 0, 0.0), (2, -7, math.inf)])
    assert len(data) == 84
    assert list(decode_frames(data))[2] == (2, -7, math.inf)
    (tmp_path / "a.log").write_bytes(data + b"\x14")
    (tmp_path / "b.log").write_bytes(data[:30] + b"\xff" + data[31:])
    rows = {(r["path"][-5:], r["series"], r["ts"]) for r in log_frames(spark, str(tmp_path / "*.log")).collect()}
    assert rows == {("a.log", 1, 5), ("a.log", 2, -7), ("b.log", 1, 5)}
    assert parse_datagram(mirror_datagram(3, -1, 0.5)) == (3, -1, 0.5)


def test_latency_files(spark, tmp_path):
    (tmp_path / "latencies-x-sync-group-r2.csv").write_text("100\nbad\n5\n")
    rows = sorted(tuple(r) for r in latencies(spark, str(tmp_path / "*.csv"), 2.0, -20.0).collect())
    assert rows == [("group", 2, 0), ("group", 2, 180)]


def test_workload_is_deterministic(spark):
    rows = sorted((r["ts"], r["value"]) for r in workload(spark, 2, 50).filter("series = 1").collect())
    assert rows == list(series_samples(1, 50))
    assert all(500 <= b[0] - a[0] < 1500 for a, b in zip(rows, rows[1:], strict=False))


def stream_of(spark, tmp_path, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 * (i < len(batches) - 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_bridge(spark, tmp_path):
    rows = [("j", BASE + i * 1_000_000, json.dumps({"effort": [0.0, 0.1, 0.2, i]})) for i in range(100)]
    bad = [("other", BASE, "{}"), ("j", BASE, '{"effort": "x"}')]
    stream = stream_of(spark, tmp_path, "topic string, ts long, payload string", rows, bad)
    bindings = spark.createDataFrame([("j", 7, True, "effort[3]")], "topic string, series long, durable boolean, field string")
    count = ingest.DurableCount()
    lane, durable = ingest.batch_table(str(tmp_path / "lane")), count.sink(ingest.batch_table(str(tmp_path / "durable")))
    query, stats = ingest.start_bridge(stream, bindings, str(tmp_path / "cp"), lane, durable, now_ns=lambda: BASE + 100_000_000)
    query.awaitTermination()
    assert (stats.received, stats.written, stats.skipped) == (102, 100, 2)
    assert count.watermark == 100
    assert stats.lag_p99() > 0
    got = spark.read.parquet(str(tmp_path / "durable"))
    assert [tuple(r) for r in got.select(F.max("value"), F.count("*")).collect()] == [(99.0, 100)]


def test_streaming_first_writer_and_latest(spark, tmp_path):
    schema = "series long, ts long, value double, seq long"
    stream = stream_of(spark, tmp_path, schema, [(1, BASE, 1.0, 0), (1, BASE, 2.0, 1), (1, BASE + 5, 3.0, 2)], [(1, BASE, 9.0, 3), (1, BASE - 7, 4.0, 4), (2, BASE, 5.0, 5)])
    for name, df, mode in (("firsts", ingest.first_writers(stream), "append"), ("lasts", ingest.latest_values(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("firsts").collect()) == [(1, BASE - 7, 4.0), (1, BASE, 1.0), (1, BASE + 5, 3.0), (2, BASE, 5.0)]
    assert sorted(tuple(r) for r in spark.table("lasts").collect()) == [(1, BASE + 5, 3.0), (2, BASE, 5.0)]


def test_replay(samples):
    df = samples([(7, BASE + i * 1_000_000, i) for i in range(10)])
    plan = schedule(df, 7, BASE, BASE + 10**9, 2.0)
    assert [r["due_ns"] for r in plan.collect()][:3] == [0, 500_000, 1_000_000]
    assert json.loads(plan.first()["payload"]) == {"ts": BASE, "value": 0.0}
    seen = []
    r = Replay(plan, lambda ts, payload: seen.append(ts))
    while not r.is_done():
        time.sleep(0.01)
    assert (len(seen), r.progress()) == (10, 10)
    with pytest.raises(CorruptError):
        schedule(df, 7, 0, 1, 0.0)


def test_export_episode_counts(samples, tmp_path):
    df = samples([(3, 1_000_000 * i, i / 2) for i in range(100)])
    meta = export_episode(df, EpisodeSpec("e", (("p", 3),), 0, 99_000_000), str(tmp_path / "x"))
    assert (meta["frames"], meta["series_samples"], set(meta["frame_samples"])) == (100, {"p": 100}, {1})


def test_episode_sink_gets_bounded_chunks(samples):
    class Sink:
        sizes, closed = [], 0

        def write_chunk(self, chunk):
            self.sizes.append(len(chunk))

        def close(self):
            self.closed += 1

    sink = Sink()
    assert stream_episode(samples([(1, 1_000_000, 5.0)]), EpisodeSpec("e", (("p.x", 1),), 0, 10**9, 10_000), sink) == 10_001
    assert (sink.sizes, sink.closed) == ([8192, 1809], 1)


def test_segment_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    cases = {
        1: (np.array([5]), np.array([math.inf])),
        2: (np.array([-(2**62), 0, 1, 2**62]), np.array([math.nan, 0.0, -0.0, 1e-300])),
        3: (np.cumsum(rng.integers(1, 2000, 3000)) + BASE, np.round(rng.normal(0, 50, 3000), 1)),
        4: (np.arange(2000), np.full(2000, 7.0)),
    }
    for s, (ts, values) in cases.items():
        data = encode_segment(s, ts, values)
        series, back, same = decode_segment(data)
        assert series == s
        assert (back == ts).all()
        assert (same.view(np.uint64) == values.astype(float).view(np.uint64)).all()
        (tmp_path / f"{s}.seg").write_bytes(data)
        for at in (3, 20, len(data) // 2, len(data) - 1):
            with pytest.raises(CorruptError):
                decode_segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(CorruptError):
            decode_segment(data[:-7])
    rows = read_segments(spark, str(tmp_path / "*.seg")).groupBy("series").count().collect()
    assert {r["series"]: r["count"] for r in rows} == {1: 1, 2: 4, 3: 3000, 4: 2000}
    with pytest.raises(CorruptError):
        encode_segment(1, np.zeros(0), np.zeros(0))


def test_put_lines(spark):
    lines = ["put 3 10 2.5", "  put 4 -7 nan ", "put x 1 2", "scan 1 2 3", "put 1 2", "", "put 4294967295 1 2"]
    got = ingest.put_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["series"], r["ts"]) for r in got] == [(3, 10), (4, -7)]
