"""Problem 5: pair each record with the record of the same entity nearest in time.

The times of each entity are kept as x-fast tries: for every prefix of their bits that
more than one time shares, and for the first prefix that a time has to itself, one row of
a hash table, with the smallest and the greatest time below it. An entity's axis is cut
into blocks of 2^BITS microseconds, each its own trie, so that no entity, however
frequent, makes one large group. A query looks for the length of the longest prefix it
shares with a trie by binary search over the prefix length, one equi-join a step; the node
found there gives its predecessor or successor, and the neighbours in order give the
other side.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.session import table

BITS = 30  # a block holds 2^30 microseconds, about 18 minutes
_ENDS = {side: {"us": "us", "id": "id", "beside_us": f"{side}.us", "beside_id": f"{side}.id"} for side in ("previous", "next")}
STEPS = 5  # 2^5 = 32 possible outcomes: no block, or a prefix of 0 to 30 bits


def _prefix(us: Column, length: Column) -> Column:
    """The block and the first bits of the time within it."""
    return F.call_function("shiftright", us, F.lit(BITS) - length)


def _first_difference(a: Column, b: Column) -> Column:
    """How many leading bits two times of one block share (0 to BITS); -1 without b or in another block."""
    x = a.bitwiseXOR(b)
    digits = F.when(x == 0, 0).otherwise(F.length(F.bin(x)))
    return F.when(b.isNull() | (digits > BITS), F.lit(-1)).otherwise(F.lit(BITS) - digits).cast("int")


def trie_tables(leaves: DataFrame) -> DataFrame:
    """Trie nodes of leaves (entity, block, us, id; one row for each entity and us).

    entity, length, prefix and the least and greatest leaf below the node (us, id) with
    the neighbour in the entity's order before the least and behind the greatest (beside_us, beside_id).
    """
    # The order is cut into windows a block wide; the neighbours of a block's first and
    # last leaf lie in other blocks and are looked for there by the query itself.
    w = Window.partitionBy("entity", "block").orderBy("us")
    leaf = F.struct("us", "id")
    rows = (
        leaves.withColumn("previous", F.lag(leaf).over(w))
        .withColumn("next", F.lead(leaf).over(w))
    )
    left = _first_difference(F.col("us"), F.col("previous.us"))
    right = _first_difference(F.col("us"), F.col("next.us"))
    rows = rows.withColumn("left", left).withColumn("right", right)
    deepest = F.least(F.greatest("left", "right") + 1, F.lit(BITS))
    # A leaf is the least of the nodes longer than what it shares with the previous one, and
    # the greatest of those longer than what it shares with the next one.
    rows = rows.withColumn("length", F.explode(F.sequence(F.least("left", "right") + 1, deepest)))
    at = F.col("length")
    return (
        rows.withColumn("prefix", _prefix(F.col("us"), at))
        .groupBy("entity", "length", "prefix")
        .agg(
            # one leaf each, so that max only picks it; plain numbers keep the aggregation hashed
            *[F.max(F.when(at > F.col("left"), F.col(c))).alias(f"least_{n}") for n, c in _ENDS["previous"].items()],
            *[F.max(F.when(at > F.col("right"), F.col(c))).alias(f"greatest_{n}") for n, c in _ENDS["next"].items()],
        )
    )


def nearest_in_time(queries: DataFrame, leaves: DataFrame, tolerance_us: int) -> DataFrame:
    """(query_id, id, gap_us): for each query the record of its entity nearest in time.

    queries: query_id, entity, us. leaves: id, entity, us. Of records at the same time, or
    equally near before and after, the smallest id counts. Queries without a record at most
    tolerance_us away do not come out. Null times, entities and ids match nothing; repeated
    rows on either side count once. tolerance_us must be less than a block (2^30).
    """
    if tolerance_us >= 1 << BITS:
        raise ValueError("the tolerance must be smaller than a block")
    spark = leaves.sparkSession
    clean = leaves.where(F.col("id").isNotNull() & F.col("entity").isNotNull() & F.col("us").isNotNull())
    single = clean.groupBy("entity", "us").agg(F.min("id").alias("id")).withColumn("block", _prefix(F.col("us"), F.lit(0)))

    asked = queries.select("query_id", "entity", "us").dropna().distinct()
    # Near the edge of a block the neighbouring block's trie is asked too.
    blocks = [_prefix(F.col("us") + d, F.lit(0)) for d in (-tolerance_us, 0, tolerance_us)]
    asked = asked.withColumn("block", F.explode(F.array_distinct(F.array(*blocks))))
    # Only blocks that some query asks become tries.
    single = single.join(asked.select("entity", "block").distinct(), ["entity", "block"], "left_semi")
    nodes = trie_tables(single).persist(StorageLevel.MEMORY_AND_DISK)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    place = ["entity", "length", "prefix"]
    keys = nodes.select(*place, F.lit(True).alias("there")).repartition(n, *place).persist(StorageLevel.MEMORY_AND_DISK)
    # In another block the time itself is replaced by that block's nearest end.
    start = F.call_function("shiftleft", F.col("block"), F.lit(BITS))
    asked = asked.withColumn("at", F.greatest(F.least("us", start + (1 << BITS) - 1), start))
    # found: longest prefix known to be in the trie (-1: none); STEPS halvings settle it.
    asked = asked.withColumn("found", F.lit(-1))
    for step in reversed(range(STEPS)):
        length = F.col("found") + (1 << step)
        asked = asked.withColumn("length", length).withColumn("prefix", F.when(length <= BITS, _prefix(F.col("at"), length)))
        asked = asked.join(keys, place, "left").withColumn(
            "found", F.when(F.col("there"), F.col("length")).otherwise(F.col("found"))
        )
        asked = asked.drop("there", "prefix", "length")
    asked = asked.where(F.col("found") >= 0).withColumnRenamed("found", "length")
    asked = asked.withColumn("prefix", _prefix(F.col("at"), F.col("length")))
    hit = asked.join(nodes, ["entity", "length", "prefix"])
    # Below the node there is nothing on the query's side of the next bit: either the node's
    # least leaf follows the query or its greatest precedes it (or it is the query's time).
    after = F.col("least_us") >= F.col("at")

    def ends(name: str) -> Column:
        pair = lambda us, i: F.struct(F.col(f"{name}_{us}").alias("us"), F.col(f"{name}_{i}").alias("id"))
        return F.array(pair("us", "id"), pair("beside_us", "beside_id"))

    candidates = F.when(after, ends("least")).otherwise(ends("greatest"))
    hit = hit.select("query_id", F.col("us").alias("_us"), F.explode(candidates).alias("c"))
    gap = F.abs(F.col("c.us") - F.col("_us"))
    near = hit.where(F.col("c.us").isNotNull()).select("query_id", F.struct(gap.alias("gap_us"), F.col("c.id").alias("id")).alias("n"))
    near = near.where(F.col("n.gap_us") <= tolerance_us)
    best = near.groupBy("query_id").agg(F.min("n").alias("n"))
    return best.select("query_id", "n.id", "n.gap_us")


def _entity(code: Column, phase: Column) -> Column:
    """NET.STA without case, spaces and location code, and the phase's first letter."""
    station = F.upper(F.regexp_extract(F.regexp_replace(code, r"\s+", ""), r"^([^.]+\.[^.]+)", 1))
    letter = F.upper(F.substring(F.trim(phase), 1, 1))
    return F.when((station != "") & (letter != ""), F.concat_ws("|", station, letter))


def pick_times(picks: DataFrame, events: DataFrame) -> DataFrame:
    """(id, entity, us) of phase picks: arrival_ts, else event_dt + tt_s, to the microsecond."""
    slim = picks.select(
        "pick_id",
        "event_uid",
        _entity(F.col("code"), F.col("phase")).alias("entity"),
        F.unix_micros("arrival_ts").alias("arrival"),
        F.round(F.when(~F.isnan("tt_s"), F.col("tt_s")) * 1_000_000).cast("bigint").alias("travel"),
    )
    timed = slim.where(F.col("arrival").isNotNull()).select(F.col("pick_id").alias("id"), "entity", F.col("arrival").alias("us"))
    origin = events.select("event_uid", F.unix_micros("event_dt").alias("origin")).where(F.col("origin").isNotNull()).distinct()
    relative = slim.where(F.col("arrival").isNull() & F.col("travel").isNotNull()).join(origin, "event_uid")
    relative = relative.select(F.col("pick_id").alias("id"), "entity", (F.col("origin") + F.col("travel")).alias("us"))
    return timed.unionByName(relative)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = pick_times(
        table(spark, sf_dir, "phase_pick").select("pick_id", "event_uid", "code", "phase", "arrival_ts", "tt_s"),
        table(spark, sf_dir, "catalog_event").select("event_uid", "event_dt"),
    )
    temporary = table(spark, sf_dir, "temp_pick").select(
        F.col("temp_id").alias("query_id"),
        _entity(F.col("code"), F.col("phase")).alias("entity"),
        F.unix_micros("arrival_ts").alias("us"),
    )
    near = nearest_in_time(temporary, picks, 1_500_000)
    return near.select(F.col("query_id").alias("temp_id"), F.col("id").alias("pick_id"))
