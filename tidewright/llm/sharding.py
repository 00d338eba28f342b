"""Sharding by jump consistent hashing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, others, packed, width

#: The generator of the jump hash, x -> MULTIPLIER * x + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757
LIMB = 22
_LOW = (1 << LIMB) - 1
_TOP = (1 << (64 - 2 * LIMB)) - 1


def _limbs(key: Column) -> list[Column]:
    return [key.bitwiseAND(_LOW), F.shiftrightunsigned(key, LIMB).bitwiseAND(_LOW), F.shiftrightunsigned(key, 2 * LIMB).bitwiseAND(_TOP)]


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to shards - 1.

    The 64-bit state is kept as limbs of 22, 22 and 20 bits so that no product overflows under ANSI
    arithmetic. A lambda folds over at most `shards` steps; once a jump lands past the end nothing changes.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    k0, k1, k2 = (MULTIPLIER >> (LIMB * i) & (_LOW, _LOW, _TOP)[i] for i in range(3))

    def step(s: Column, _: Column) -> Column:
        x0 = s["a"] * F.lit(k0) + 1
        x1 = s["a"] * F.lit(k1) + s["b"] * F.lit(k0) + F.shiftright(x0, LIMB)
        x2 = s["a"] * F.lit(k2) + s["b"] * F.lit(k1) + s["c"] * F.lit(k0) + F.shiftright(x1, LIMB)
        a, b, c = x0.bitwiseAND(_LOW), x1.bitwiseAND(_LOW), x2.bitwiseAND(_TOP)
        high = F.shiftright(b, 33 - LIMB) + c * F.lit(1 << (2 * LIMB - 33))
        jump = F.floor((s["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double")))
        go = s["to"] < shards
        return F.struct(
            F.when(go, a).otherwise(s["a"]).alias("a"),
            F.when(go, b).otherwise(s["b"]).alias("b"),
            F.when(go, c).otherwise(s["c"]).alias("c"),
            F.when(go, s["to"]).otherwise(s["at"]).alias("at"),
            F.when(go, jump).otherwise(s["to"]).alias("to"),
        )

    a, b, c = _limbs(key)
    begin = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), begin, step, lambda s: s["at"]).cast("int")


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", ties: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into a shard by its key; adds `shard`, `grown_shard` (with one shard more) and `slot`.

    Law: the key and the shard count decide. A null key counts as key -1. `slot` numbers the rows of a
    shard from 0 without gaps, in the order of (crc32 of the key's text, key, and the columns `ties`: without any, crc32
    and length of the text); fully equal rows take their slots in any order. Empty input gives an empty result. Columns of
    the input stay, apart from any called shard, grown_shard or slot in any case, which are replaced.

    Rows are dealt out by ranges of this order and, last, their place in the input, so that no key and no group of equal
    rows is too large for a task. Ordered rows are written with their place; a row's slot is its place less that of the first
    of its shard in its range, plus the rows of the shard in the ranges before, from a table of one row a shard and range.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    ident = F.coalesce(docs[key].cast("long"), F.lit(-1))
    if ties:
        rest = [docs[c] for c in ties]
    else:
        has = text.lower() in (c.lower() for c in docs.columns)
        body = F.coalesce(docs[text], F.lit("")) if has else F.lit("")
        rest = [F.crc32(body.cast("binary")), F.octet_length(body)]
    names = others(docs, "shard", "grown_shard", "slot")
    own = docs.select(
        packed(docs, "shard", "grown_shard", "slot").alias("row"),
        jump_hash(ident, shards).alias("shard"),
        jump_hash(ident, shards + 1).alias("grown"),
        F.crc32(ident.cast("string").cast("binary")).alias("first"),
        ident.alias("key"),
        *[c.alias(f"tie{i}") for i, c in enumerate(rest)],
        F.monotonically_increasing_id().alias("nth"),
    )
    order = ["shard", "first", "key", *[f"tie{i}" for i in range(len(rest))], "nth"]
    dealt = own.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    # monotonically_increasing_id numbers the rows of a range one by one, and ranges in their order.
    rows, _ = materialize(dealt.select("row", "shard", "grown", F.monotonically_increasing_id().alias("place")))
    cells = rows.groupBy("shard", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("shard").alias("of"), "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("shift"))
    slot = (F.col("place") + F.col("shift")).cast("long").alias("slot")
    placed = rows.join(cells, (F.col("shard") == F.col("of")) & (F.shiftright("place", 33) == F.col("part")))
    return placed.select(*[F.col("row")[c].alias(c) for c in names], "shard", F.col("grown").alias("grown_shard"), slot)
