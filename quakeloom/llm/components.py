"""Problem 6: one group identifier for all records linked directly or over others.

Vertices are hashed into blocks, and every pair of blocks is one cell of a grid of edge
partitions, which holds the edges within the two blocks and between them, so that the edges
of a much-linked vertex lie in all cells of its row and column. A round runs union-find
inside every cell, exchanges the representatives along rows and columns (the first one of
each vertex in a mixed order wins) and keeps as new edges only the disagreements between
representatives. It ends when none is left: then every vertex has one parent in all cells.
The grid has at least LEAST_BLOCKS blocks a side, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import cut, staged, table

CELL_EDGES = 50_000  # edges that a cell holds on average
LEAST_BLOCKS = 4  # of vertices, in every round


def _priority(vertices: np.ndarray, seed: int) -> np.ndarray:
    """A mixed order of the vertices, another for each round, so that chains in the order of their ids shrink too."""
    with np.errstate(over="ignore"):
        x = vertices.astype(np.uint64) + np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _union_find(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Each vertex of one cell with the vertex of least priority in its component within the cell."""
    names, ends = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    order = _priority(names, seed)
    by_priority = np.lexsort((names, order))
    rank = np.empty(len(names), dtype=np.int64)
    rank[by_priority] = np.arange(len(names))
    parent = list(range(len(names)))
    ends = rank[ends].tolist()
    half = len(pdf)
    for a, b in zip(ends[:half], ends[half:], strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    for i, p in enumerate(parent):  # parents come first, so they are final when reached
        parent[i] = parent[p]
    root = by_priority[np.array(parent, dtype=np.int64)]
    return pd.DataFrame({"v": names[by_priority], "order": order[root], "rep": names[root]})


def _cells(edges: DataFrame, blocks: int, seed: int, cell_edges: int) -> DataFrame:
    """Edges with the cells (row < col) that they lie in; a cell with far more than its share is split by edges."""
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    i, j = F.least("_i", "_j"), F.greatest("_i", "_j")
    cell = lambda a, b: F.struct(F.least(a, b).alias("row"), F.greatest(a, b).alias("col"))
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: k != F.col("_i"))
    cells = F.when(i == j, F.transform(others, lambda k: cell(F.col("_i"), k))).otherwise(F.array(cell(F.col("_i"), F.col("_j"))))
    grid = edges.select("u", "v", block("u").alias("_i"), block("v").alias("_j")).select("u", "v", F.explode(cells).alias("c")).select("u", "v", "c.*")
    if blocks == LEAST_BLOCKS:  # then there are too few edges for such a cell
        return grid.withColumn("part", F.lit(0))
    shares = grid.groupBy("row", "col").agg(F.ceil(F.count("*") / (4 * cell_edges)).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1))).cast("int")
    return grid.join(shares, ["row", "col"], "left").select("u", "v", "row", "col", part.alias("part"))


def _exchanged(edges: DataFrame, blocks: int, seed: int, cell_edges: int) -> DataFrame:
    """(v, parent, reps): union-find in each cell, then of each vertex the first of its representatives, and all of them."""
    schema = "v bigint, order bigint, rep bigint"
    grid = _cells(edges, blocks, seed, cell_edges)
    reps = grid.groupBy("row", "col", "part").applyInPandas(lambda pdf: _union_find(pdf, seed), schema)
    best = reps.groupBy("v").agg(F.min(F.struct("order", "rep")).alias("b"), F.collect_set("rep").alias("reps"))
    return best.select("v", F.col("b.rep").alias("parent"), "reps")


def connected_groups(edges: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(v, group) for every vertex of edges (u, v bigint): group is the least vertex it is linked with.

    Edges with a null end are ignored, an edge from a vertex to itself only names the vertex;
    repeated edges and both directions count once. No edges give no rows.
    """
    ends = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    ends = ends.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    ends = ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = staged(ends, "edges")
    count = ends.count()
    steps: list[DataFrame] = []
    while count or not steps:  # parents are stable once no vertex has two representatives
        blocks = max(LEAST_BLOCKS, int(np.ceil(np.sqrt(4 * count / cell_edges))))
        step = staged(_exchanged(ends, blocks, len(steps), cell_edges), "parents")
        steps.append(step.select("v", "parent"))
        # a vertex with several representatives links their components
        apart = step.where(F.size("reps") > 1).select("parent", F.explode("reps").alias("rep")).where(F.col("rep") != F.col("parent"))
        ends = staged(apart.select(F.least("parent", "rep").alias("u"), F.greatest("parent", "rep").alias("v")).distinct(), "edges")
        count = ends.count()
    roots = steps[-1]
    for k, step in enumerate(reversed(steps[:-1]), 1):
        later = roots.select(F.col("v").alias("parent"), F.col("parent").alias("root"))
        roots = step.join(later, "parent", "left").select("v", F.coalesce("root", "parent").alias("parent"))
        if k % 4 == 0:
            roots = cut(roots)
    roots = staged(roots, "roots")
    least = roots.groupBy("parent").agg(F.min("v").alias("group"))
    return roots.join(least, "parent").select("v", "group")


def normal_ref(ref: Column) -> Column:
    """A public id or header line without case, spacing and leading zeros; null if nothing is left."""
    s = F.upper(F.regexp_replace(F.trim(F.regexp_replace(ref, r"\s+", " ")), r"^# ?", "# "))
    s = F.regexp_replace(s, r"(?<![0-9.])0+(?=[0-9])", "")
    return F.when(F.trim(s).isin("", "#"), None).otherwise(F.trim(s))


def report_edges(reports: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (u, v) between reports: a star for each public id and each name used in a k link, and the links.

    reports: report_uid, public_id, header_line. links: ref_a, ref_b, decision.
    """
    ids = reports.where(F.col("report_uid").isNotNull()).select("report_uid", normal_ref(F.col("public_id")).alias("name"))
    headers = reports.where(F.col("report_uid").isNotNull()).select("report_uid", normal_ref(F.col("header_line")).alias("name"))
    kept = links.where(F.trim("decision") == "k").select(
        normal_ref(F.col("ref_a")).alias("a"), normal_ref(F.col("ref_b")).alias("b")
    )
    kept = kept.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    # a ref that names no report makes its link void
    every = ids.select("name").unionByName(headers.select("name")).distinct()
    for side in ("a", "b"):
        kept = kept.join(every.withColumnRenamed("name", side), side, "left_semi")
    used = kept.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    named = ids.where(F.col("name").isNotNull()).unionByName(headers.join(used, "name", "left_semi"))
    named = staged(named.distinct(), "names")
    first = named.groupBy("name").agg(F.min("report_uid").alias("first"))
    stars = named.join(first, "name").select(F.col("report_uid").alias("u"), F.col("first").alias("v"))
    ends = kept.join(first.select(F.col("name").alias("a"), F.col("first").alias("u")), "a")
    ends = ends.join(first.select(F.col("name").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    return stars.unionByName(ends)


def report_groups(reports: DataFrame, links: DataFrame) -> DataFrame:
    """(report_uid, group_uid) of reports in groups of two or more; group_uid is the group's least report_uid.

    Reports belong together if they share a public id or a link with decision k names both,
    directly or over others. Refs that name no report, links with another decision, null ids
    and null refs link nothing. Repeated rows count once.
    """
    groups = connected_groups(report_edges(reports, links))
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return groups.join(sizes, "group").select(F.col("v").alias("report_uid"), F.col("group").alias("group_uid"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "event_report").select("report_uid", "public_id", "header_line")
    links = table(spark, sf_dir, "report_link").select("ref_a", "ref_b", "decision")
    return report_groups(reports, links)
