"""Problem 8: documents into containers of fixed capacity with little unused space.

Documents are dealt at random into blocks of bounded size. Each block is filled first-fit,
in the order in which documents arrive, and then improved by local search: from the fullest
container down, a document of an emptier one is moved in, or exchanged for one or for two
documents, by whatever leaves least space. Every such step raises the sum of squared fills;
the search goes on until no step is left, and the emptiest containers run dry. What then
lies in containers with unused space is dealt anew, container by container, into fewer
blocks and searched again, so that the remainders of different blocks meet, until they all
lie in one block or hardly a container is filled any more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm.tokens import VOCABULARY, token_counts
from quakeloom.session import cut, staged, table

BLOCK_ITEMS = 3000  # documents that are packed together in one Python task
LEAST_PROGRESS = 0.01  # a round after one that took a smaller share of the documents off the loose ones is the last


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, in the given order: the first one that has room."""
    where = np.empty(len(sizes), dtype=np.int64)
    room = np.full(len(sizes) + 1, capacity, dtype=np.int64)
    count = 0
    for i, s in enumerate(sizes.tolist()):
        at = int(np.argmax(room[: count + 1] >= s))
        where[i] = at
        room[at] -= s
        count = max(count, at + 1)
    return where


class _Pool:
    """The documents of the containers that may give some up, by size."""

    def __init__(self, sizes: np.ndarray, items: np.ndarray) -> None:
        self.known = np.unique(sizes[items])
        self.place = dict(zip(items.tolist(), np.searchsorted(self.known, sizes[items]).tolist(), strict=True))
        self.items: list[set[int]] = [set() for _ in self.known]
        self._last = None
        for i in items.tolist():
            self.add(i)

    def add(self, i: int) -> None:
        held = self.items[self.place[i]]
        if not held:
            self._last = None
        held.add(i)

    def take(self, i: int) -> None:
        held = self.items[self.place[i]]
        held.discard(i)
        if not held:
            self._last = None

    def largest(self, most: np.ndarray) -> np.ndarray:
        """For each bound the place of the largest size held that is not above it; -1 if there is none."""
        if self._last is None:
            there = np.fromiter(map(bool, self.items), dtype=bool, count=len(self.items))
            self._last = np.concatenate([[-1], np.maximum.accumulate(np.where(there, np.arange(len(there)), -1))])
        return self._last[np.searchsorted(self.known, most, side="right")]


def local_search(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Moves and exchanges that raise the sum of squared fills until none is left.

    A step takes a document x of an emptier container a into a fuller one b, for none, one or
    two documents of b of less size in all, if b has room for the difference: of all such steps
    into b the one that leaves least room. Documents of one size are interchangeable, so each
    size of b, and each pair of sizes, is tried once; all are tried.
    Of steps that leave the same room the one with the largest x counts: small documents, which
    fit in many places, stay in the emptier containers.
    """
    where = where.copy()
    fill = np.bincount(where, weights=sizes).astype(np.int64)
    members: list[set[int]] = [set() for _ in fill]
    for i, b in enumerate(where.tolist()):
        if sizes[i] > 0:
            members[b].add(i)

    def put(i: int, b: int) -> None:
        a = int(where[i])
        members[a].discard(i)
        members[b].add(i)
        where[i] = b
        fill[a] -= sizes[i]
        fill[b] += sizes[i]

    changed = True
    while changed:
        changed = False
        order = [b for b in np.argsort(-fill, kind="stable").tolist() if 0 < fill[b] < capacity]
        open_items = np.array([i for b in order for i in members[b]], dtype=np.int64)
        if len(order) < 2:
            break
        pool = _Pool(sizes, open_items)
        for b in order:
            for i in members[b]:  # what is left in the pool lies in containers that are no fuller
                pool.take(i)
            while 0 < fill[b] < capacity:
                room = capacity - int(fill[b])
                own: dict[int, int] = {}
                again: dict[int, int] = {}
                for i in members[b]:
                    s = int(sizes[i])
                    if s in own:
                        again[s] = i
                    else:
                        own[s] = i
                each = np.array(sorted(own), dtype=np.int64)
                first, second = np.triu_indices(len(each))
                twice = np.array([int(s) in again for s in each], dtype=bool)
                real = (first != second) | twice[first]
                first, second = first[real], second[real]
                given = np.concatenate([[0], each, each[first] + each[second]])
                at = pool.largest(given + room)
                gain = np.where(at >= 0, pool.known[at] - given, 0)
                best = int(np.argmax(gain * (capacity + 1) + np.where(gain > 0, pool.known[at], 0)))
                if gain[best] <= 0:
                    break
                x = min(pool.items[at[best]], key=lambda i: (fill[where[i]], i))
                if best == 0:
                    out = []
                elif best <= len(each):
                    out = [own[int(each[best - 1])]]
                else:
                    p, q = int(each[first[best - 1 - len(each)]]), int(each[second[best - 1 - len(each)]])
                    out = [own[p], again[q] if p == q else own[q]]
                a = int(where[x])
                pool.take(x)
                put(x, b)
                for y in out:
                    put(y, a)
                    pool.add(y)
                changed = True
    loose = np.flatnonzero(sizes == 0)
    if len(loose):  # documents without tokens lie anywhere
        where[loose] = int(np.argmax(fill))
    return where


def _block_packer(tag: str, search: bool):  # noqa: ANN202
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dealt", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        sizes = pdf["tokens"].to_numpy(dtype=np.int64)
        capacity = int(pdf["capacity"].iloc[0])
        # the containers of the round before, or in the first round a first fit
        held = pdf["bin_id"].notna().all()
        filled = pd.factorize(pdf["bin_id"])[0] if held else first_fit(sizes, capacity)
        where = local_search(sizes, filled, capacity) if search else filled
        fill = np.bincount(where, weights=sizes).astype(np.int64)
        name = f"{tag}-{pdf['block'].iloc[0]}-"
        out = pdf.assign(bin_id=[name + str(b) for b in where], bin_tokens=fill[where], emptied=0)
        out.loc[0, "emptied"] = len(np.unique(filled)) - len(np.unique(where))
        return out.drop(columns=["block", "blocks", "dealt"])

    return pack


_COLUMNS = ["pack_name", "capacity", "doc_id", "piece", "tokens", "bin_id"]


def _packed(items: DataFrame, tag: str, search: bool) -> DataFrame:
    """Each pack's items dealt into blocks of about BLOCK_ITEMS, whole containers together, and packed there.

    Adds bin_tokens, and on one row of a block how many containers the search emptied.
    """
    counts = items.groupBy("pack_name").agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("blocks"))
    deal = F.when(F.col("bin_id").isNull(), F.xxhash64("doc_id", "piece", F.lit(tag))).otherwise(F.xxhash64("bin_id", F.lit(tag)))
    dealt = items.select(*_COLUMNS).join(counts, "pack_name").withColumn("dealt", deal).withColumn("block", F.pmod(deal, F.col("blocks")))
    schema = "pack_name string, capacity int, doc_id bigint, piece int, tokens int, bin_id string, bin_tokens bigint, emptied bigint"
    return dealt.groupBy("pack_name", "block").applyInPandas(_block_packer(tag, search), schema)


def pack(sizes: DataFrame, packs: DataFrame, search: bool = True) -> DataFrame:
    """(pack_name, bin_id, doc_id, piece, tokens): every document in a container, for each size of packs.

    sizes: doc_id, tokens. packs: pack_name, capacity_tokens. A document longer than the capacity is cut into pieces of the capacity,
    each filling a container, and a rest that is packed like a document; no other is split.
    Documents of 0 tokens lie in some container. Nulls in ids, sizes and settings and
    capacities below 1 are left out; of repeated documents and settings each counts once.
    search=False leaves out the local search, to see what it does.
    """
    return packed_rounds(sizes, packs, search)[0]


def packed_rounds(sizes: DataFrame, packs: DataFrame, search: bool = True) -> tuple[DataFrame, DataFrame]:
    """The containers (see pack), and (pack_name, step, items, emptied): how many containers the search emptied in each round."""
    choices = packs.where(F.col("pack_name").isNotNull() & (F.col("capacity_tokens") > 0))
    choices = choices.select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    known = sizes.where(F.col("doc_id").isNotNull() & (F.col("tokens") >= 0)).select("doc_id", "tokens").distinct()
    # every document in every pack: the settings as one row, so that no pair of tables is crossed
    settings = choices.agg(F.collect_set(F.struct("pack_name", "capacity")).alias("_c"))
    each = known.join(settings).select("doc_id", F.col("tokens").alias("size"), F.explode("_c").alias("c")).select("doc_id", "size", "c.*")
    whole = F.floor(F.col("size") / F.col("capacity")).cast("int")
    # piece k of the capacity, and the rest as the last piece
    last = F.when((F.col("size") % F.col("capacity") > 0) | (F.col("size") == 0), whole).otherwise(whole - 1)
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    tokens = F.when(F.col("piece") < whole, F.col("capacity")).otherwise(F.col("size") % F.col("capacity"))
    pieces = staged(pieces.select("pack_name", "capacity", "doc_id", "piece", tokens.cast("int").alias("tokens")), "pieces")
    full = pieces.where(F.col("tokens") == F.col("capacity")).select(
        "pack_name", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", "tokens"
    )
    done = full
    loose = pieces.where(F.col("tokens") < F.col("capacity")).withColumn("bin_id", F.lit(None).cast("string"))
    rounds: DataFrame | None = None
    step, before = 0, None
    while True:
        packed = staged(_packed(loose, f"r{step}", search), "packed")
        counts = packed.groupBy("pack_name").agg(F.count("*").alias("items"), F.sum("emptied").alias("emptied")).withColumn("step", F.lit(step))
        counts = cut(counts)
        rounds = counts if rounds is None else rounds.unionByName(counts)
        told = counts.agg(F.max("items").alias("items"), F.sum("items").alias("total")).first()
        few = before is not None and (told["total"] or 0) > (1 - LEAST_PROGRESS) * before
        if (told["items"] or 0) <= BLOCK_ITEMS or few:
            return done.unionByName(packed.select(done.columns)), rounds
        before = told["total"]
        closed = F.col("bin_tokens") == F.col("capacity")
        done = done.unionByName(packed.where(closed).select(done.columns))
        loose = packed.where(~closed)
        step += 1


def _sizes(spark: SparkSession, sf_dir: str, vocabulary: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return staged(token_counts(documents, vocabulary), "sizes")


def p8_pack(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(_sizes(spark, sf_dir, vocabulary), table(spark, sf_dir, "pack_size"))


def p8_rounds(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the local search did: containers it emptied in each round, of each size of packs."""
    return packed_rounds(_sizes(spark, sf_dir, vocabulary), table(spark, sf_dir, "pack_size"))[1]


def p8_rules(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack_name, documents, over_full, split, repeated): what the containers must keep to; the last three are 0.

    over_full counts containers beyond the capacity, split documents in several containers that
    are not longer than one, repeated documents of which a piece is packed twice.
    """
    packs = table(spark, sf_dir, "pack_size").select("pack_name", "capacity_tokens")
    packed = staged(p8_pack(spark, sf_dir, vocabulary), "packs")
    full = packed.groupBy("pack_name", "bin_id").agg(F.sum("tokens").alias("fill")).join(packs, "pack_name")
    over = full.groupBy("pack_name").agg(F.count(F.when(F.col("fill") > F.col("capacity_tokens"), 1)).alias("over_full"))
    each = packed.groupBy("pack_name", "doc_id").agg(
        F.sum("tokens").alias("size"), F.count("*").alias("n"), F.count_distinct("piece").alias("pieces")
    ).join(packs, "pack_name")
    kept = each.groupBy("pack_name").agg(
        F.count("*").alias("documents"),
        F.count(F.when((F.col("n") > 1) & (F.col("size") <= F.col("capacity_tokens")), 1)).alias("split"),
        F.count(F.when(F.col("n") > F.col("pieces"), 1)).alias("repeated"),
    )
    return kept.join(over, "pack_name").select("pack_name", "documents", "over_full", "split", "repeated")
