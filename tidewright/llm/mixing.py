"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, others, packed, width

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
LIMIT = 3
#: Documents of a source in one block, on average.
BLOCK_DOCS = 2048
#: Per-source and per-edge-block tables are broadcast up to so many rows (16 bytes each and the source's name), else joined by shuffle.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, limit: int = LIMIT) -> DataFrame:
    """Target size of each source (one row a source: source, source_size); adds `target`.

    Sources in code point order, null last, weigh cycle[0], cycle[1], ... repeating. Shares of the total
    follow the weights; a target stops at `limit` times its source's size and the excess goes to the others by
    weight. In closed form: by rising size per weight the capped sources are a prefix, and the rest share what is left.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * limit).cast("double"))
    upward = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past = upward.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(past), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("place", F.row_number().over(upward))
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"]
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(settled, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def split_quotas(quota: np.ndarray, capacity: list[int], seed: int) -> np.ndarray:
    """Blocks of each source (columns) that go to each output shard (rows); sums equal quotas and capacities exactly.

    A node of the tree halves its shards and draws the left half's vector from the multivariate
    hypergeometric law of the blocks it holds, so that every placement of blocks into shards is equally likely.
    """
    out = np.zeros((len(capacity), len(quota)), np.int64)
    stack = [(0, len(capacity), np.asarray(quota, np.int64), 1)]
    while stack:
        lo, hi, held, node = stack.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, node]))
        left, rest = np.zeros(len(held), np.int64), int(held.sum())
        draw = int(sum(capacity[lo:mid]))
        for i, n in enumerate(held):  # marginals: one hypergeometric draw a source
            rest -= int(n)
            left[i] = int(rng.hypergeometric(int(n), rest, draw)) if draw else 0
            draw -= int(left[i])
        stack += [(lo, mid, left, 2 * node), (mid, hi, held - left, 2 * node + 1)]
    return out


def _of_source(left: DataFrame, right: DataFrame, *also: str, how: str = "inner") -> DataFrame:
    """Join on `_source`, null equal to null, and on the columns `also`."""
    right = right.select(*[F.col(c).alias(f"_r_{c}" if c in ("_source", *also) else c) for c in right.columns])
    same = F.col("_source").eqNullSafe(F.col("_r__source"))
    for c in also:
        same &= F.col(c) == F.col(f"_r_{c}")
    return left.join(right, same, how).drop("_r__source", *[f"_r_{c}" for c in also])


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the one block where a source's target falls: which keys to take, in permuted order, so as to end near the target."""
    pdf = pdf.sort_values("_key")
    left, take = float(pdf["_left"].iloc[0]), []
    for key, size in zip(pdf["_key"].to_numpy(), pdf["_sum"].to_numpy(), strict=True):
        if size <= left:
            take.append(key)
            left -= size
    rest = pdf[~pdf["_key"].isin(take) & (pdf["_sum"] < 2 * left)]
    if len(rest):  # one more that overshoots by less than what is short
        take.append(rest.sort_values(["_sum", "_key"])["_key"].iloc[0])
    return pd.DataFrame({"_source": [pdf["_source"].iloc[0]] * len(take), "_key": take})


def mix(docs: DataFrame, shards: int = 8, seed: int = 17, cycle: tuple[int, ...] = CYCLE, limit: int = LIMIT, text: str = "text", source: str = "source", key: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Every row with how often the mix takes it; adds `size` (words), `source_size`, `target`, `copies`, `places`.

    `places` has one struct (shard, rank) for each copy: the output shard and the place in its local shuffle.
    Rows are permuted inside their source by a hash of the key and cut into blocks; the source's quota of
    blocks, whole passes first, is split exactly among the output shards, and each shard draws disjoint runs of
    permuted blocks. The block in which the target falls is taken in part. Equal keys of a source go together.

    A null text has 0 words; null sources form one source, last; a null key is a key of its own. Rows without
    words are taken once in each whole pass. Empty input gives an empty result. Columns called like one of the
    added ones, in any case, are replaced. The driver gets one row for each source, never one for each document or block.
    """
    added = ("size", "source_size", "target", "copies", "places")
    names = others(docs, *added)
    hashed = F.xxhash64(F.coalesce(docs[key].cast("string"), F.lit("\0")), F.lit(seed))
    base = docs.select(packed(docs, *added).alias("_row"), n_words(docs[text]).alias("size"), docs[source].alias("_source"), hashed.alias("_key"))
    narrow, _ = materialize(base.groupBy("_source", "_key").agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows")))
    per_source = narrow.groupBy("_source").agg(F.sum("_sum").alias("source_size"), F.sum("_rows").alias("_docs"))
    goal = targets(per_source.select(F.col("_source").alias("source"), "source_size"), cycle, limit).withColumnRenamed("source", "_source")
    goal = _of_source(goal, per_source.select("_source", "_docs"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(limit))).otherwise(1)
    goal = goal.withColumn("_passes", passes.cast("int")).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    goal = goal.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_docs") / block_docs)).cast("int"))
    goal, _ = materialize(goal)
    block = F.pmod(F.shiftright(F.col("_key"), 20), F.col("_blocks").cast("long")).cast("int")
    cells = _of_source(narrow, goal.select("_source", "_blocks", "_rest")).withColumn("_block", block)
    order = Window.partitionBy("_source").orderBy(F.xxhash64("_block", F.lit(seed + 1)), "_block")
    blocks = cells.groupBy("_source", "_block").agg(F.sum("_sum").alias("_words"), F.first("_rest").alias("_rest"))
    blocks = blocks.withColumn("_at", F.row_number().over(order) - 1).withColumn("_upto", F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("_left", F.col("_rest") - (F.col("_upto") - F.col("_words")))
    part = F.when(F.col("_rest") < 0.5, 0).when(F.col("_upto") <= F.col("_rest"), 1).when(F.col("_left") > 0, 2).otherwise(0)
    blocks, _ = materialize(blocks.select("_source", "_block", "_at", "_left", part.alias("_part")))
    edge = _of_source(cells, blocks.filter("_part = 2").select("_source", "_block", "_left"), "_block")
    source_type = base.schema["_source"].dataType.simpleString()
    chosen, _ = materialize(edge.select("_source", "_key", "_sum", "_left").groupBy("_source").applyInPandas(_cut, f"_source {source_type}, _key long").withColumn("_chosen", F.lit(True)))

    quota = blocks.groupBy("_source").agg(F.sum((F.col("_part") > 0).cast("int")).alias("_extra"), F.count("*").alias("_n"))
    rows = _of_source(goal, quota).orderBy(F.col("_source").asc_nulls_last()).select("_source", "source_size", "target", "_passes", "_blocks", "_n", "_extra").collect()
    total = np.array([r["_passes"] * r["_n"] + r["_extra"] for r in rows], np.int64)
    whole = int(total.sum())
    capacity = [whole * (i + 1) // shards - whole * i // shards for i in range(shards)]
    ends = np.cumsum(split_quotas(total, capacity, seed), axis=0)
    plan = docs.sparkSession.createDataFrame(
        [(*r[:6], [int(x) for x in ends[:, i]]) for i, r in enumerate(rows)],
        f"_source {source_type}, source_size long, target double, _passes int, _blocks int, _n long, _ends array<long>",
    )
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df

    out = _of_source(base, few(plan, len(rows))).withColumn("_block", block)
    out = _of_source(out, blocks.select("_source", "_block", "_at", "_part"), "_block")
    out = _of_source(out, few(chosen, chosen.count()), "_key", how="left")
    extra = (F.col("_part") == 1) | ((F.col("_part") == 2) & F.coalesce(F.col("_chosen"), F.lit(False)))
    out = out.withColumn("copies", F.col("_passes") + extra.cast("int"))
    # Pass p of a source draws its block at place p * n + at; the shard is the run of quotas that holds it.
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda p: F.struct(
        F.size(F.filter("_ends", lambda e: e <= p.cast("long") * F.col("_n") + F.col("_at"))).alias("shard"),
        F.xxhash64(F.col("_key"), p, F.lit(seed + 2)).alias("rank"),
    )
    out = out.withColumn("places", F.transform(passes, place))  # before the input's columns get their names back
    return out.select(*[F.col("_row")[c].alias(c) for c in names], "size", "source_size", "target", "copies", "places")


def draw(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of `mix` as its output: `columns` of each copy, in the files of its shard and there in the order of its local shuffle.

    Shards are cut into ranges of the order, so that no task holds a whole shard.
    """
    copies = mixed.select(F.struct(*[mixed[f"`{c}`"] for c in columns]).alias("row"), F.explode("places").alias("at"))
    order = [F.col("at")["shard"], F.col("at")["rank"]]
    dealt = copies.repartitionByRange(width(mixed.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select(*[F.col("row")[c].alias(c) for c in columns])
