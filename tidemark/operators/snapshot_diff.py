"""What changed between consecutive full snapshots of a table.

Keys get persistent ordinals, kept in a dictionary on disk. A snapshot is then a compressed bitmap (only its non-empty 64-bit
words are rows) with column vectors aligned to the set bits, which hold fingerprints of the compared values. Additions and
removals are AND-NOTs of the words of two consecutive snapshots; changes among common keys are found by reading both
vectors at the key's rank in its word. Words with equal bits and equal vectors are dropped before anything is expanded.
Everything is built-in expressions; the table is read once, and the shuffles carry one row for up to 64 keys.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import bounded_broadcast, cut_lineage, shared_path, stored

WORD = 64


def ordinals(keys: DataFrame, key: str, dictionary: str, buckets: int = 256) -> DataFrame:
    """The dictionary ``(key, ordinal)`` on disk, after the new ones of the non-null ``keys`` were appended.

    Ordinals are dense; keys that the dictionary holds keep theirs, and new keys are numbered after them. Numbering is by hash
    bucket, then by key within it, so no task sees more than its share of the distinct keys. One writer is assumed.
    """
    spark = keys.sparkSession
    fresh = keys.select(key).where(F.col(key).isNotNull()).distinct()
    first = 0
    if stored(spark, dictionary):
        known = spark.read.parquet(dictionary)
        fresh = fresh.join(known.select(key), key, "left_anti")
        first = known.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    fresh = fresh.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    sizes = fresh.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    numbered = fresh.join(F.broadcast(offsets), "_bucket").select(key, (F.col("_offset") + place - 1 + first).cast("long").alias("ordinal"))
    numbered.write.mode("append").parquet(dictionary)
    return spark.read.parquet(dictionary)


def _bits_below(word: Column, bit: Column) -> Column:
    """How many set bits of a word come before ``bit``: the rank, which is the index into the aligned vector."""
    return F.bit_count(word.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))


def _fingerprint(values: list[str]) -> Column:
    """128 bits of the values of ``held``, nulls marked, so that a vector's width does not grow with the compared columns."""
    marked = [x for v in values for x in (F.col(f"held.{v}").isNull(), F.col(f"held.{v}"))]
    return F.struct(F.xxhash64(*marked).alias("h"), F.xxhash64(F.lit(1), *marked).alias("g"))


def snapshot_changes(rows: DataFrame, *, key: str, snapshot: str, values: list[str], latest_by: list[str], dictionary: str | None = None) -> DataFrame:
    """``(key, snapshot, change_kind)``: ``added``, ``removed`` or ``changed`` against the previous snapshot of the table.

    Of several rows of one key in one snapshot the greatest by ``latest_by`` holds (ties: by the values). A change is a
    difference in any of ``values``, null against value included. Rows without key or snapshot identify nothing and are
    ignored. The first snapshot has no result, an empty table none at all; other columns of ``rows`` are ignored.
    ``dictionary`` is the folder of the keys' ordinals, extended by new keys; without it one is made for this run.
    """
    spark = rows.sparkSession
    order = [F.col(c).alias(f"o{i}") for i, c in enumerate(latest_by)]
    state = (
        rows.where(F.col(snapshot).isNotNull())  # rows without key make a delivery all the same
        .groupBy(F.col(key).alias("_key"), F.col(snapshot).alias("_snapshot"))
        .agg(F.max(F.struct(*order, F.struct(*values).alias("held")))["held"].alias("held"))
    )
    state = cut_lineage(state.select("_key", "_snapshot", _fingerprint(values).alias("print")))
    # One row per delivery. Deliveries by day are bounded by the calendar; finer ones are broadcast only if they are few.
    deliveries = state.select("_snapshot").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_snapshot")))
    deliveries = bounded_broadcast(cut_lineage(deliveries))
    n = deliveries.count()
    numbers = ordinals(state, "_key", dictionary or shared_path(spark, f"keys-{uuid4().hex}"))

    words = (
        state.join(numbers, "_key")
        .join(deliveries, "_snapshot")
        .groupBy(F.expr(f"ordinal div {WORD}").alias("_word"), "_no")
        .agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr(f"cast(ordinal % {WORD} AS int)"))).alias("bits"),
            F.array_sort(F.collect_list(F.struct((F.col("ordinal") % WORD).alias("bit"), "print"))).alias("cells"),
        )
        .select("_word", "_no", F.struct("bits", F.transform("cells", lambda c: c["print"]).alias("vector")).alias("w"))
    )
    # A word meets the one of the delivery before; where the next delivery lacks it, all its keys are gone there.
    by_delivery = Window.partitionBy("_word").orderBy("_no")
    before, after = F.lag(F.struct("_no", "w")).over(by_delivery), F.lead("_no").over(by_delivery)
    met = words.select("_word", "_no", "w", before.alias("before"), after.alias("after"))
    step = lambda no, a, b: F.struct(no.alias("_no"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast(words.schema["w"].dataType)
    own = F.when(F.col("_no") > 1, step(F.col("_no"), F.when(F.col("before._no") == F.col("_no") - 1, F.col("before.w")), F.col("w")))
    gone = F.when((F.col("_no") < n) & ~F.col("after").eqNullSafe(F.col("_no") + 1), step(F.col("_no") + 1, F.col("w"), none))
    steps = F.filter(F.array(own, gone), lambda s: s.isNotNull() & ~s["a"].eqNullSafe(s["b"]))
    pairs = (
        met.select("_word", F.inline(steps))
        .select("_word", "_no", F.coalesce("a.bits", F.lit(0)).alias("a"), F.coalesce("b.bits", F.lit(0)).alias("b"), F.col("a.vector").alias("va"), F.col("b.vector").alias("vb"))
        .withColumn("gained", F.col("b").bitwiseAND(F.bitwise_not("a")))
        .withColumn("lost", F.col("a").bitwiseAND(F.bitwise_not("b")))
        .withColumn("common", F.col("a").bitwiseAND(F.col("b")))
    )
    has = lambda column, bit: F.call_function("shiftright", F.col(column), bit).bitwiseAND(F.lit(1)) == 1
    bit = F.col("bit")
    opened = pairs.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where(F.call_function("shiftright", F.col("a").bitwiseOR(F.col("b")), bit).bitwiseAND(F.lit(1)) == 1)
    at = lambda vector, column: F.get(F.col(vector), _bits_below(F.col(column), bit))
    kind = (
        F.when(has("gained", bit), "added")
        .when(has("lost", bit), "removed")
        .when(has("common", bit) & ~at("va", "a").eqNullSafe(at("vb", "b")), "changed")
    )
    found = opened.select((F.col("_word") * WORD + bit).alias("ordinal"), "_no", kind.alias("change_kind")).where("change_kind IS NOT NULL")
    return (
        found.join(deliveries, "_no")
        .join(numbers, "ordinal")
        .select(F.col("_key").alias(key), F.col("_snapshot").alias(snapshot), "change_kind")
    )
