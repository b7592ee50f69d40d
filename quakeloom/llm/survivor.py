"""Problem 7: the best representative of each group of duplicates, field by field.

Records are compared on completeness (how many fields are usable, how many distinct picks),
recency and trust; one dominates another if it is no worse in any and better in one. The
undominated ones are the first layer, the undominated ones of the rest the second, and so
on. The survivor is the first layer's first by policy (trust, recency, least id); what it
lacks is filled from its layer, then from the next ones. A more complete, more recent and
more trusted record may lack a field that a dominated one has: such fields come from
deeper layers. A report that a later one of equal trust with the same usable fields and
as many picks supersedes is no candidate, which bounds every group before it is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import table

# Places of the fields among the 17 header tokens, and whether a negative value is usable.
FIELDS = {"dep": (8, True), "mag": (9, True), "erh": (13, False), "erv": (14, False), "az_gap": (15, False), "rms": (16, False)}
SENTINEL = -999.0
WORST_TRUST = 1_000_000


def usable_value(token: Column, negative: bool) -> Column:
    """The first usable number among a token's slots (a:b:c); null if there is none."""
    number = lambda x: x.try_cast("double")
    slots = F.transform(F.split(token, ":"), number)
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v != SENTINEL) & (F.lit(negative) | (v >= 0))
    return F.try_element_at(F.filter(slots, good), F.lit(1))


def header_values(header: Column) -> dict[str, Column]:
    """The usable values of a header line; all null if it has not 17 tokens."""
    tokens = F.split(F.regexp_replace(header, r"^\s*#?\s*|\s+$", ""), r"\s+")
    token = {f: F.when(F.size(tokens) == 17, F.get(tokens, F.lit(i))) for f, (i, _) in FIELDS.items()}
    return {f: usable_value(token[f], negative) for f, (_, negative) in FIELDS.items()}


def distinct_picks(picks: Column) -> Column:
    """How many distinct (code, phase regardless of case) pick lines have; 0 for null."""
    line = lambda p: F.concat_ws("|", F.trim(F.substring(p, 1, 9)), F.upper(F.trim(F.substring(p, 23, 6))))
    named = lambda p: p.isNotNull() & (F.trim(F.substring(p, 1, 9)) != "") & (F.trim(F.substring(p, 23, 6)) != "")
    return F.coalesce(F.size(F.array_distinct(F.transform(F.filter(picks, named), line))), F.lit(0))


def _layers(candidates: Column) -> Column:
    """Adds the dominance layer (1 = undominated) to each candidate of a group.

    The candidates are sorted by trust, recency, picks and number of fields, so that every
    dominator comes before what it dominates, and one fold settles the layers.
    """
    sides = ("trust", "age", "fewer", "order")

    def dominates(d: Column, r: Column) -> Column:
        no_worse, same = F.lit(True), F.lit(True)
        for c in sides:
            no_worse, same = no_worse & (d[c] <= r[c]), same & (d[c] == r[c])
        return no_worse & ~same

    def add(done: Column, r: Column) -> Column:
        above = F.filter(done, lambda d: dominates(d, r))
        layer = F.coalesce(F.array_max(F.transform(above, lambda d: d["layer"])), F.lit(0)) + 1
        named = [r[c].alias(c) for c in (*sides, "fields", "id")]
        return F.concat(done, F.array(F.struct(layer.alias("layer"), *named)))

    empty = F.lit([]).cast("array<struct<layer:int,trust:int,age:bigint,fewer:int,order:int,fields:int,id:bigint>>")
    return F.aggregate(candidates, empty, add)


def layered_reports(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(public_id, c): for each public id with two or more reports its candidates with their layers.

    Of reports alike in usable fields, number of picks and trust only the latest is a candidate.
    """
    values = header_values(F.col("header_line"))
    bits = sum((F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(values.values())), F.lit(0))
    rank = sources.select(F.col("source").alias("_source"), F.col("trust_rank").alias("_rank")).dropDuplicates(["_source"])
    known = reports.where(F.col("public_id").isNotNull() & F.col("report_uid").isNotNull())
    rows = known.select(
        "public_id",
        F.col("source").alias("_source"),
        F.col("report_uid").alias("id"),
        (-F.coalesce(F.unix_micros("revised_ts"), F.lit(-(1 << 62)))).alias("age"),
        (-distinct_picks(F.col("picks"))).alias("fewer"),
        bits.cast("int").alias("fields"),
    )
    rows = rows.join(rank, "_source", "left").withColumn("trust", F.coalesce("_rank", F.lit(WORST_TRUST)))
    latest = rows.groupBy("public_id", "trust", "fewer", "fields").agg(
        F.min(F.struct("age", "id")).alias("b"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    candidate = F.struct(
        F.col("trust").cast("int").alias("trust"),
        F.col("b.age").alias("age"),
        F.col("fewer").cast("int").alias("fewer"),
        (-F.bit_count("fields")).cast("int").alias("order"),
        F.col("b.id").alias("id"),
        F.col("fields").alias("fields"),
    )
    groups = latest.groupBy("public_id").agg(
        F.sort_array(F.collect_list(candidate)).alias("candidates"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return groups.where(F.col("low") < F.col("high")).select("public_id", _layers(F.col("candidates")).alias("c"))


def _has(i: int | None):  # noqa: ANN202
    """Whether a candidate has field number i; None for picks."""
    if i is None:
        return lambda c: c["fewer"] < 0
    return lambda c: c["fields"].bitwiseAND(F.lit(1 << i)) != 0


def _policy(i: int | None):  # noqa: ANN202
    """What the policy compares, the best first: trust, recency, id, and for picks their number before."""
    return lambda c: F.struct(
        (c["fewer"] if i is None else F.lit(0)).alias("f"), c["trust"].alias("t"), c["age"].alias("a"), c["id"].alias("id"), c["layer"].alias("l")
    )


def _filled(i: int | None, exact: bool) -> Column:
    """The best candidate for a field by the policy, from the first layer on; null if none has it.

    exact: on through the layers until no deeper one can hold a better one by the policy.
    What is in a layer is dominated by something in the layer before, so that no deeper
    candidate is better than the best of a layer. Without it, from the first layer that has the field.
    """
    order, has = _policy(i), _has(i)
    depth = F.sequence(F.lit(1), F.array_max(F.transform("c", lambda c: c["layer"])))
    layer = lambda k: F.filter("c", lambda c: c["layer"] == k)
    start = F.lit(None).cast("struct<f:int,t:int,a:bigint,id:bigint,l:int>")

    def walk(best: Column, k: Column) -> Column:
        here = F.array_min(F.transform(F.filter(layer(k), has), order))
        if not exact:
            return F.coalesce(best, here)
        # ends once the best so far is no worse than everything in this layer, and so in all deeper ones
        bound = F.array_min(F.transform(layer(k), order))
        return F.when(best <= bound, best).when(best.isNull() | (here < best), here).otherwise(best)

    return F.aggregate(depth, start, walk)


def surviving_fields(reports: DataFrame, sources: DataFrame, exact: bool = True) -> DataFrame:
    """(public_id, field_name, report_uid, layer): which report supplies each field of a public id, and its dominance layer.

    reports: report_uid, public_id, source, header_line, picks, revised_ts. Only public ids
    with two or more reports come out. For dep, mag, erh, erv, az_gap and rms the report must
    have a usable value, and the best trust_rank wins, then the latest revised_ts, then the
    smallest report_uid; for picks the most distinct (code, phase), at least one, goes before.
    With exact=False a field comes from the first layer that has it, and the policy decides only within the layer.
    A source without rank is trusted least, a null revised_ts is the oldest. Fields that no
    report has do not come out; null public ids and repeated rows are left out.
    """
    names = {f: i for i, f in enumerate(FIELDS)} | {"picks": None}
    chosen = [F.struct(F.lit(f).alias("field_name"), _filled(i, exact).alias("b")) for f, i in names.items()]
    out = layered_reports(reports, sources).select("public_id", F.explode(F.array(*chosen)).alias("f")).where("f.b IS NOT NULL")
    return out.select("public_id", "f.field_name", F.col("f.b.id").alias("report_uid"), F.col("f.b.l").alias("layer"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_report").select("report_uid", "public_id", "source", "header_line", "picks", "revised_ts")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surviving_fields(_reports(spark, sf_dir), table(spark, sf_dir, "source_info"))
    return found.select("public_id", "field_name", "report_uid")


def p7_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the first layer that has a field before the policy, and that layer."""
    return surviving_fields(_reports(spark, sf_dir), table(spark, sf_dir, "source_info"), exact=False)
