"""Sealed segments as Parquet with a versioned catalog: seal, prune, archive, compact.

A seal writes one directory of rows; a segment is a series' share of it. The catalog is a table of segments with their zone maps.
Every change writes a new catalog version beside the old one and becomes visible with it, so readers keep a
consistent snapshot and a failed job leaves only unreferenced files.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import segment_name
from ..model import SEGMENTS, NotFoundError
from ..operators.predicates import Pred, time_zone_overlaps
from ..operators.scan import dedup, in_range

#: After so many milliseconds a claim on a catalog version is taken for left by a dead writer.
STALE_MS = 3_600_000
_ROWS = "series long, ts long, value double, seg_seq long, seq long, home long"


def zone_maps(rows: DataFrame, *by: str) -> DataFrame:
    """Bounds and count of each group; value bounds leave NaN out and are NaN where nothing else is."""
    v = F.when(~F.isnan("value"), F.col("value"))
    nan = F.lit(float("nan"))
    return rows.groupBy(*by).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.coalesce(F.min(v), nan).alias("min_val"), F.coalesce(F.max(v), nan).alias("max_val"), F.count("*").alias("count"))


def prune(catalog: DataFrame, series: int | None, t0: int, t1: int, pred: Pred | None = None) -> DataFrame:
    """Segments that can hold a sample of the scan, by series and both zone maps, before any file is opened."""
    out = catalog.filter(time_zone_overlaps(F.col("min_ts"), F.col("max_ts"), t0, t1))
    if series is not None:
        out = out.filter(F.col("series") == series)
    return out.filter(pred.zone(F.col("min_val"), F.col("max_val"))) if pred else out


def archivable(catalog: DataFrame, before_ts: int) -> DataFrame:
    return catalog.filter((F.col("tier") == "local") & (F.col("max_ts") < before_ts))


def compaction_plan(catalog: DataFrame, max_count: int = 1 << 20) -> DataFrame:
    """The segments to merge: for each series the whole run of eligible segments (local, of at most max_count rows) at its end, if two or more."""
    at = Window.partitionBy("series").orderBy("seg_seq")
    ok = (F.col("tier") == "local") & (F.col("count") <= max_count)
    placed = catalog.withColumn("_at", F.row_number().over(at)).withColumn("_stop", F.max(F.when(~ok, F.col("_at"))).over(Window.partitionBy("series")))
    run = placed.withColumn("_stop", F.coalesce("_stop", F.lit(0))).filter(F.col("_at") > F.col("_stop"))
    return run.withColumn("_n", F.count("*").over(Window.partitionBy("series"))).filter("_n >= 2").drop("_at", "_stop", "_n")


class SegmentStore:
    """Segments under a directory of any file system that Spark reads; archived ones under `cold`."""

    def __init__(self, spark: SparkSession, root: str, cold: str | None = None):
        self.spark, self.root, self.cold = spark, root.rstrip("/"), cold and cold.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def version(self) -> int:
        """The newest complete catalog version; 0 before the first seal."""
        fs, target = self._fs(f"{self.root}/catalog")
        if not fs.exists(target):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._exists(f"{self.root}/catalog/{n}/_SUCCESS")), default=0)

    def catalog(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(SEGMENTS).parquet(f"{self.root}/catalog/v{v:09d}") if v else self.spark.createDataFrame([], SEGMENTS)

    def _commit(self, catalog: DataFrame, base: int) -> None:
        """Publish a catalog made from version `base`; fails if another writer was faster.

        The number after `base` is claimed by creating a file that must not exist, which the file system grants to one writer
        only. A claim whose writer died is given up after STALE_MS.
        """
        claim = f"{self.root}/catalog/claim-{base + 1:09d}"
        fs, target = self._fs(claim)
        if self.version() != base:
            raise NotFoundError("the catalog changed meanwhile; try again")
        if fs.exists(target) and time.time() * 1000 - fs.getFileStatus(target).getModificationTime() > STALE_MS:
            fs.delete(target, False)
        try:
            fs.create(target, False).close()
        except Exception as x:
            raise NotFoundError("the catalog changed meanwhile; try again") from x
        try:
            if self.version() != base:
                raise NotFoundError("the catalog changed meanwhile; try again")
            catalog.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/catalog/v{base + 1:09d}")
        finally:
            fs.delete(target, False)

    def _place(self, tier: str, home: int) -> str:
        return f"{self.root if tier == 'local' else self.cold}/data/home={home:09d}"

    def _write(self, rows: DataFrame, tier: str, home: int, placed: bool = False) -> None:
        """Rows clustered by series and time, so that Parquet's own statistics prune them, in one pass.

        Unless they are `placed` by ranges of these, a rebalancing shuffle merges small partitions and splits a hot series over many files.
        """
        rows = rows.withColumn("home", F.lit(home).cast("long")).select("series", "ts", "value", "seg_seq", "seq", "home")
        rows = rows if placed else rows.hint("rebalance", "series")
        rows.sortWithinPartitions("series", "ts", "seg_seq", "seq").write.parquet(self._place(tier, home))

    def next_home(self, catalog: DataFrame) -> int:
        top = catalog.agg(F.max("home"), F.max("seg_seq")).first()
        home = max(top[0] or 0, top[1] or 0) + 1
        while any(self._exists(self._place(tier, home)) for tier in ("local", "cold") if tier == "local" or self.cold):
            home += 1  # left by a job that failed
        return home

    def seal(self, rows: DataFrame) -> int:
        """Write (series, ts, value, seq) as one segment a series, the first writer of each ts only; returns their number."""
        base, catalog = self.version(), self.catalog()
        home = self.next_home(catalog)
        # Ranges of (series, ts) bring the writers of one ts together, split a hot series and order the files, in one shuffle.
        dealt = rows.select("series", "ts", "value", "seq").repartitionByRange("series", "ts")
        best = dealt.groupBy("series", "ts").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
        self._write(best.withColumn("seg_seq", F.lit(home).cast("long")), "local", home, placed=True)
        made = self._entries(home, "local").withColumn("distinct", F.lit(True)).persist()
        try:
            n = made.count()
            self._commit(catalog.unionByName(made.withColumn("mates", F.lit(n).cast("long"))), base)
            return n
        finally:
            made.unpersist()

    def _entries(self, home: int, tier: str) -> DataFrame:
        """Catalog rows of a written directory, but for `distinct`: whether no ts of the segment has two writers."""
        stored = self.spark.read.schema(_ROWS).parquet(self._place(tier, home))
        zones = zone_maps(stored, "series", "seg_seq")
        return zones.select(segment_name(F.col("seg_seq"), F.col("series")).alias("name"), "series", "seg_seq", "min_ts", "max_ts", "min_val", "max_val", "count", F.lit(tier).alias("tier"), F.lit(home).cast("long").alias("home"))

    def read(self, segments: DataFrame) -> DataFrame:
        """The rows of catalog entries. Only the directories they name are read; the driver gets one row for each of these."""
        homes = segments.select("tier", "home").distinct().collect()
        if not homes:
            return self.spark.createDataFrame([], _ROWS)
        return self._open(homes).join(segments.select("series", "seg_seq", "home"), ["series", "seg_seq", "home"], "left_semi")

    def _open(self, homes: list) -> DataFrame:
        """The rows of whole directories (tier, home)."""
        for h in homes:
            if h["tier"] != "local" and not self.cold:
                raise NotFoundError("a segment is archived, but there is no cold tier")
            if not self._exists(self._place(h["tier"], h["home"])):
                raise NotFoundError(f"missing: {self._place(h['tier'], h['home'])}")
        return self.spark.read.schema(_ROWS).parquet(*[self._place(h["tier"], h["home"]) for h in homes])

    def samples(self, series: int | None, t0: int, t1: int, pred: Pred | None = None) -> DataFrame:
        """Rows of the range with their provenance: catalog pruning first, the filters pushed into Parquet second."""
        rows = in_range(self.read(prune(self.catalog(), series, t0, t1, pred)), t0, t1, pred, series)
        return rows.select("series", "ts", "value", F.lit(1).alias("layer"), "seg_seq", "seq")

    def visible(self, series: int | None, t0: int, t1: int, pred: Pred | None = None) -> DataFrame:
        """(series, ts, value) of the range after deduplication.

        Series whose surviving segments do not overlap in time and have one writer for each ts need no deduplication: they
        are a plain Parquet scan. The zone maps say which; only the others are shuffled.
        """
        catalog = self.catalog()
        found = prune(catalog, series, t0, t1, pred)
        before = Window.partitionBy("series").orderBy("min_ts", "seg_seq").rowsBetween(Window.unboundedPreceding, -1)
        marked = found.withColumn("_meets", ~F.col("distinct") | F.coalesce(F.max("max_ts").over(before) >= F.col("min_ts"), F.lit(False)))
        marked = marked.withColumn("_mixed", F.max("_meets").over(Window.partitionBy("series"))).drop("_meets")
        # One row for each directory: whether all that was written there is still in the catalog, and whether a series needs deduplication.
        live = catalog.groupBy("tier", "home").agg((F.count("*") == F.max("mates")).alias("whole"))
        homes = marked.groupBy("tier", "home").agg(F.max("_mixed").alias("mixed")).join(live, ["tier", "home"]).collect()
        if homes and all(h["whole"] and not h["mixed"] for h in homes):
            return in_range(self._open(homes), t0, t1, pred, series).select("series", "ts", "value")
        rows = lambda which: in_range(self.read(which.drop("_mixed")), t0, t1, pred, series)
        plain = rows(marked.filter(~F.col("_mixed"))).select("series", "ts", "value")
        mixed = marked.filter("_mixed")
        if mixed.isEmpty():
            return plain
        return plain.unionByName(dedup(rows(mixed).select("series", "ts", "value", "seg_seq", "seq")))

    def archive_older_than(self, before_ts: int) -> int:
        """Move segments that end before `before_ts` to the cold tier; returns their number."""
        if not self.cold:
            raise NotFoundError("there is no cold tier")
        base, catalog = self.version(), self.catalog()
        old = archivable(catalog, before_ts)
        if not (n := old.count()):
            return 0
        home = self.next_home(catalog)
        self._write(self.read(old), "cold", home)
        made = self._entries(home, "cold").join(old.select("name", "distinct"), "name").withColumn("mates", F.lit(n).cast("long"))
        self._commit(catalog.join(old.select("name"), "name", "left_anti").unionByName(made), base)
        return n

    def compact(self, series: int | None = None, max_count: int = 1 << 20) -> dict[str, int]:
        """Merge each series' tail run into one segment, duplicates kept; returns runs, inputs, outputs and rows.

        Merged rows keep their order of writing as `seq`, so scans with any predicate see what they saw before.
        """
        base, catalog = self.version(), self.catalog()
        plan = compaction_plan(catalog, max_count)
        if series is not None:
            plan = plan.filter(F.col("series") == series)
        inputs = plan.agg(F.count("*"), F.count_distinct("series"), F.sum("count")).first()
        if not inputs[0]:
            return {"runs": 0, "input_segments": 0, "output_segments": 0, "rows": 0}
        home = self.next_home(catalog)
        # Only writers of one ts compete: their rank is their order, whatever else the series holds.
        rank = F.row_number().over(Window.partitionBy("series", "ts").orderBy("seg_seq", "seq")) - 1
        merged = self.read(plan).withColumn("seq", rank.cast("long")).withColumn("seg_seq", F.lit(home).cast("long"))
        self._write(merged, "local", home)
        most = self.spark.read.schema(_ROWS).parquet(self._place("local", home)).groupBy("series").agg((F.max("seq") == 0).alias("distinct"))
        made = self._entries(home, "local").join(most, "series").withColumn("mates", F.lit(inputs[1]).cast("long"))
        self._commit(catalog.join(plan.select("name"), "name", "left_anti").unionByName(made), base)
        return {"runs": 1, "input_segments": inputs[0], "output_segments": inputs[1], "rows": inputs[2]}

    def listing(self, tier: str = "local") -> list[tuple[str, int]]:
        """Path and bytes of every data file of a tier, by path."""
        fs, top = self._fs(f"{self.root if tier == 'local' else self.cold}/data")
        if not fs.exists(top):
            return []
        files, out = fs.listFiles(top, True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-"):
                out.append((f.getPath().toString(), f.getLen()))
        return sorted(out)

    def vacuum(self, keep: int = 1) -> int:
        """Delete catalog versions but the newest `keep`, and data directories that none of these names."""
        newest = self.version()
        fs, top = self._fs(f"{self.root}/catalog")
        if not newest:
            return 0
        used, gone = set(), 0
        for v in range(max(1, newest - keep + 1), newest + 1):
            if self._exists(f"{self.root}/catalog/v{v:09d}/_SUCCESS"):
                used |= {(r["tier"], r["home"]) for r in self.spark.read.schema(SEGMENTS).parquet(f"{self.root}/catalog/v{v:09d}").select("tier", "home").distinct().collect()}
        for s in fs.listStatus(top):
            name = s.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= newest - keep:
                fs.delete(s.getPath(), True)
        for tier in ("local", *(["cold"] if self.cold else [])):
            fs, data = self._fs(f"{self.root if tier == 'local' else self.cold}/data")
            for s in fs.listStatus(data) if fs.exists(data) else []:
                if (tier, int(s.getPath().getName().removeprefix("home="))) not in used:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone
