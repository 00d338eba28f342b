"""Connected components, and linking inside candidate buckets without forming all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps over tables in the shared folder; a step is two shuffles of
    edges, hub nodes are split by skew joins, and nothing but the count and checksum of the edges reaches the driver.
    """
    spark = edges.sparkSession

    def step(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        joined = e.join(least, F.col("a") == F.col("u"))
        if larger:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        return joined.select(F.explode(both).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()

    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = materialize(start)
    mark = None
    while True:
        after, made = materialize(step(step(now, True), False))
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = after, made
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node, least) of the rows (bucket, node) in buckets with two nodes or more, each once; `least` is the bucket's smallest node.

    One shuffle sorts the rows by bucket and node; runs are then found while they stream by, so a bucket of any size
    takes no memory. Most buckets have one node and end here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, prior, size = None, 0, 0, 0  # the open run: bucket, first and latest node, nodes so far
        for batch in batches:
            bucket, node = (batch.column(i).to_numpy() for i in range(2))
            fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])] if len(bucket) else np.zeros(0, bool)
            if len(bucket) and bucket[0] == last and node[0] == prior:
                fresh[0] = False
            bucket, node = bucket[fresh], node[fresh]
            if not len(bucket):
                continue
            if bucket[0] == last and size == 1:  # its first node has not been passed on yet
                bucket, node, size = np.r_[last, bucket], np.r_[least, node], 0
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            length = np.diff(np.r_[begin, len(bucket)])
            first = node[begin]
            counted = length.copy()
            if bucket[0] == last and size:
                first[0], counted[0] = least, length[0] + size
            keep = np.repeat(counted > 1, length)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(node[keep]), pa.array(np.repeat(first, length)[keep])], ["bucket", "node", "least"])
            last, least, prior, size = bucket[-1], first[-1], node[-1], int(counted[-1])

    return rows.select("bucket", "node").repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "bucket long, node long, least long")


def components_in_buckets(
    members: DataFrame,
    nodes: DataFrame,
    known: DataFrame,
    likely: Callable[[Column, Column], Column],
    confirm: Callable[[DataFrame], DataFrame],
    links_across: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, root) after linking all confirmed pairs that share a bucket; nodes without a link may be left out.

    members: (bucket, node) or `shared_buckets`. nodes: (node, sig). known: pairs (a, b) that are linked already.
    `likely` says from two `sig` columns whether a pair can be linked; `confirm` keeps the linked ones of pairs (a, b).

    First each bucket's members are tried against its smallest node only, which joins a large group of copies in
    as many pairs as it has members. Then, only in buckets whose members are still in different components, pairs
    from different components that `likely` admits are tried. Every linked pair of a bucket is thus either
    confirmed or already inside one component, so no component is missed and no group of copies is paired up.
    `links_across`, where given, does the second step itself: it gets (bucket, node, root) of these buckets and returns
    links (a, b) that join all components which a linked pair of a bucket joins.
    """
    spark = members.sparkSession
    if "least" not in members.columns:
        least = members.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select("bucket", "least")
        members = members.join(least, "bucket")
    star = members.filter(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    star, drawn = materialize(star.distinct())
    tried = star.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    tried, _ = materialize(tried.filter(likely(F.col("sa"), F.col("sb"))).select("a", "b"))
    discard(spark, drawn)
    linked, _ = materialize(confirm(tried).select("a", "b").unionByName(known.select("a", "b")))
    roots, _ = materialize(connected_components(linked))

    placed, at = materialize(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    rest, _ = materialize(placed.join(mixed, "bucket", "left_semi"))
    discard(spark, at)
    if links_across:
        more, _ = materialize(links_across(rest))
        return roots if more.isEmpty() else connected_components(linked.unionByName(more))
    rest = rest.join(nodes, "node")
    left, right = (rest.select("bucket", F.col("node").alias(n), F.col("sig").alias(f"s{n}"), F.col("root").alias(f"r{n}")) for n in "ab")
    across = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & likely(F.col("sa"), F.col("sb")))
    fresh, _ = materialize(across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    more, _ = materialize(confirm(fresh).select("a", "b"))
    if more.isEmpty():
        return roots
    return connected_components(linked.unionByName(more))
