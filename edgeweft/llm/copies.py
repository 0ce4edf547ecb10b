"""Records that differ only in notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

#: As many keys with the most copies are hot. All others have at most a 1000th of the records each, so one task can hold them.
HOT_KEYS = 1_000


def copy_groups(records: DataFrame, key: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, keep_id, copies) of every record ``(id, key)``.

    Records with equal ``key`` are copies of one; ``keep_id`` is the smallest id of them and
    ``copies`` their number, the kept one included. Records with a null key are left out.
    ``key`` is compared exactly; its hash only tells where a record is worked on.

    Partial counts by the hash of the key give the ``hot_keys`` hashes with the most records, of those with two or more,
    at every size of the input. The list has a fixed length, so it is broadcast. Records with a hot hash
    are salted by id and aggregated on two levels, first by key and salt, then by key. What the salts found is joined back
    by key and salt, so no task holds more than its salts. All other records take one shuffle by key, where no
    group has more than the records over ``hot_keys``. Extra columns are ignored.
    """
    rows = records.where(F.col(key).isNotNull()).select("id", F.col(key).alias("key")).withColumn("h", F.xxhash64("key"))
    rows = materialize(rows, "rows")  # keys are costly to make; the counts then read hashes only
    counts = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(2, total // hot_keys)
    # a thousand rows at most, sorted out by the executors
    hot = counts.where("n > 1").orderBy(F.col("n").desc(), "h").limit(hot_keys).select("h", F.ceil(F.col("n") / bound).cast("int").alias("salts"))
    hot = F.broadcast(materialize(hot, "hot"))
    tagged = rows.join(hot, "h", "left")
    by_key = Window.partitionBy("h", "key")
    light = tagged.where("salts is null").select("id", F.min("id").over(by_key).alias("keep_id"), F.count(F.lit(1)).over(by_key).alias("copies"))
    salted = rows.join(hot, "h").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("salts")).cast("int"))
    parts = salted.groupBy("h", "key", "salt").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c"))
    kept = parts.groupBy("h", "key").agg(F.min("m").alias("keep_id"), F.sum("c").alias("copies"), F.collect_list("salt").alias("salts"))
    to_salts = kept.select("h", "key", "keep_id", "copies", F.explode("salts").alias("salt"))
    return light.unionByName(salted.join(to_salts, ["h", "salt", "key"]).select("id", "keep_id", "copies"))
