"""Problem 9: a mix of sources near target shares of all tokens.

The largest mix with exact shares gives every document of a source the same expected
number of copies; the whole part is fixed, the fraction is rounded by the pivotal method:
two documents exchange probability, weighted by their tokens, until one of them is
settled, which keeps every expectation and, but for one last document, the source's
tokens. Blocks settle their own documents and pass on at most one unsettled each; these
meet in the next level of a reduction tree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.tokens import VOCABULARY, token_counts
from quakeloom.session import staged, table

BLOCK_ITEMS = 10_000
TINY = 1e-9


def pivotal(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds p to 0 and 1 with sum(p * weight) kept, until at most one entry is fractional."""
    p = p.astype(float).copy()
    held = -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        if p[i] <= TINY or p[i] >= 1 - TINY:
            p[i] = round(p[i])
            continue
        if weight[i] <= 0:
            p[i] = float(draws[i] < p[i])
            continue
        if held < 0:
            held = i
            continue
        ratio = weight[i] / weight[held]
        up = min(1 - p[held], p[i] * ratio)  # what held can take from i
        down = min(p[held], (1 - p[i]) * ratio)  # what held can give to i
        step = up if draws[i] * (up + down) < down else -down
        p[held] += step
        p[i] -= step / ratio
        for k in (held, i):
            if p[k] <= TINY or p[k] >= 1 - TINY:
                p[k] = round(p[k])
        loose = [k for k in (held, i) if 0 < p[k] < 1]
        held = loose[0] if loose else -1
    return p


def _settle(level: int, seed: int):  # noqa: ANN202
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        key = f"{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}|{level}" + (f"|{seed}" if seed else "")
        rng = np.random.default_rng(zlib.crc32(key.encode()))
        # the longest first, so that the document left over is a short one
        pdf = pdf.iloc[np.lexsort((rng.random(len(pdf)), -pdf["tokens"].to_numpy()))]
        p = pivotal(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(dtype=float), rng)
        return pdf.assign(p=p).drop(columns="block")

    return settle


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document of the mix is used (1 or more).

    sizes: doc_id, source, tokens. targets: source, target_share, max_repeats. The mix is as
    large as the shares and max_repeats allow; the shares are relative to the sources
    that have tokens. Documents of other sources, and with null ids, sources or sizes, are
    not used; repeated rows count once; no document is used over max_repeats times. Another seed gives another
    mix of the same shares. There is one row of targets a source, and the mix's plan is joined by its measured size.
    """
    known = sizes.where(F.col("doc_id").isNotNull() & (F.col("tokens") >= 0)).select("doc_id", "source", "tokens").distinct()
    wanted = targets.select("source", "target_share", "max_repeats").where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).dropDuplicates(["source"])
    held = known.groupBy("source").agg(F.sum("tokens").alias("held")).where(F.col("held") > 0)
    plan = wanted.join(held, "source").select("source", "target_share", "max_repeats", "held")
    limit = plan.agg(F.min(F.col("held") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    plan = plan.join(limit).select(  # one row with the mix's size
        "source", F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("held")).alias("expected")
    )
    fixed = F.floor(F.col("expected") + TINY)
    rows = known.join(staged(plan, "plan"), "source").select(
        "doc_id", "source", "tokens", fixed.alias("fixed"), F.greatest(F.lit(0.0), F.col("expected") - fixed).alias("p")
    )
    rows = staged(rows, "expected")
    schema = "doc_id bigint, source string, tokens int, fixed bigint, p double"
    settled = rows.where(F.col("p") <= TINY)
    loose = rows.where(F.col("p") > TINY)
    level = 0
    while True:
        most = loose.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if level and most <= 1:
            break
        blocks = max(1, -(-most // BLOCK_ITEMS))
        dealt = loose.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(blocks)))
        step = staged(dealt.groupBy("source", "block").applyInPandas(_settle(level, seed), schema), "settled")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        settled = settled.unionByName(step.where(whole))
        loose = step.where(~whole)
        level += 1
    chance = F.pmod(F.xxhash64("doc_id", "source", *[F.lit(seed)] * bool(seed)), F.lit(1_000_003)) / 1_000_003.0
    last = loose.withColumn("p", F.when(chance < F.col("p"), 1.0).otherwise(0.0))
    copies = (F.col("fixed") + F.when(F.col("p") >= 0.5, 1).otherwise(0)).cast("int")
    done = settled.unionByName(last).select("doc_id", "source", "tokens", copies.alias("copies"))
    return done.where(F.col("copies") > 0)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, mix_tokens, documents, most_copies) for each target, also those without documents."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"),
        F.count("*").alias("documents"),
        F.max("copies").alias("most_copies"),
    )
    total = used.agg(F.sum("mix_tokens").alias("total"))
    rows = targets.select("source", "target_share").join(used, "source", "left").join(total)
    return rows.select(
        "source",
        "target_share",
        (F.coalesce("mix_tokens", F.lit(0)) / F.col("total")).alias("actual_share"),
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def _sizes(spark: SparkSession, sf_dir: str, vocabulary: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return staged(token_counts(documents, vocabulary), "sizes")


def p9_mix(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return mix(_sizes(spark, sf_dir, vocabulary), table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    targets = table(spark, sf_dir, "mix_target")
    return shares(mix(_sizes(spark, sf_dir, vocabulary), targets), targets)


def p9_rules(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(targets, strangers, over_used, repeated, off_target): what the mix must keep to; all but the first are 0.

    strangers counts documents of sources without a target, over_used those used more often
    than their source allows, repeated those that come twice, off_target the sources whose tokens are further from
    their share of the whole mix than one of their documents.
    """
    targets = table(spark, sf_dir, "mix_target")
    sizes = _sizes(spark, sf_dir, vocabulary)
    used = staged(mix(sizes, targets), "mix").join(targets, "source", "left")
    count = lambda c: F.count(F.when(c, 1))
    kept = used.agg(
        count(F.col("max_repeats").isNull()).alias("strangers"),
        count(F.col("copies") > F.col("max_repeats")).alias("over_used"),
        (F.count("*") - F.count_distinct("doc_id")).alias("repeated"),
    )
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("held"), F.max("tokens").alias("longest"))
    plan = targets.join(held, "source").withColumn("limit", F.col("held") * F.col("max_repeats") / F.col("target_share"))
    total = plan.agg(F.min("limit").alias("total"))
    taken = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
    gap = F.abs(F.coalesce("taken", F.lit(0)) - F.col("target_share") * F.col("total"))
    off = plan.join(taken, "source", "left").join(total).agg(count(gap > F.col("longest") + 1).alias("off_target"))
    return targets.agg(F.count("*").alias("targets")).join(kept).join(off)  # one row each
