"""Links inside families of rows, without all pairs of a large family in one task.

A family is a set of rows that no link leaves. Small families are one block each. A large one is
cut into blocks; every block is joined with itself, then blocks of what these joins left as
representatives, level by level, then, if the family still has several components, all pairs
of blocks that can hold different components. A block never joins rows of one known component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.components import connected
from pitpanel.session import cut_lineage

#: Rows, and the sum of ``n``, that a block holds at most, about.
BLOCK_ROWS, BLOCK_SIZE = 1500, 4_000_000

def relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with each label replaced by the smallest label linked with it."""
    roots = connected(links, "a", "b").select(F.col("node").alias("label"), "root")
    return cut_lineage(members.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root"))


def with_cells(members: DataFrame, by: list[str]) -> DataFrame:
    """``members`` cut into blocks by hash within each group: adds ``blocks`` and ``cell``."""
    sizes = members.groupBy(*by).agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SIZE), F.lit(1)).cast("bigint").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return members.join(sizes, by).withColumn("cell", F.concat_ws("/", *by, block))


def family_links(members: DataFrame, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``members`` (family, node, n, further columns) with the smallest node of the component as ``label``.

    Members may have a ``label`` already: nodes known to be in one component. A node may be in several
    families. ``join`` gets rows with ``cell`` and ``label`` and gives the pairs (a, b) of labels that some
    two rows of one cell link. Eager.
    """
    if "label" not in members.columns:
        members = members.withColumn("label", F.col("node"))
    first = cut_lineage(with_cells(members, ["family"]))
    members = relabel(first.drop("blocks", "cell"), join(first))
    wide = first.filter("blocks > 1").select("family").distinct()
    if first.filter("blocks > 1").isEmpty():
        return members
    wide = cut_lineage(wide)
    left, before = members.join(wide, "family"), -1
    while True:  # representatives: the smallest node of each component, block by block
        heads = left.filter(F.col("node") == F.col("label"))
        cells = cut_lineage(with_cells(heads, ["family"]))
        n = cells.count()
        if n == before:
            break
        before = n
        links = cut_lineage(join(cells))
        members = relabel(members, links)
        left = members.join(wide, "family")
        if cells.filter("blocks > 1").isEmpty():
            break
    parts = left.groupBy("family").agg(F.count_distinct("label").alias("parts")).filter("parts > 1").select("family")
    rest = cut_lineage(left.join(parts, "family"))
    if rest.isEmpty():
        return members
    # Blocks of one component alone, where it fills them, and of several components; all pairs that can differ.
    kind = rest.groupBy("family", "label").agg(F.count(F.lit(1)).alias("m"))
    pure = F.when(F.col("m") > BLOCK_ROWS, F.col("label").cast("string")).otherwise("")
    rest = cut_lineage(with_cells(rest.join(kind, ["family", "label"]).withColumn("pure", pure), ["family", "pure"]))
    cells = rest.select("family", "pure", "cell").distinct()
    other = cells.select("family", F.col("pure").alias("pure_b"), F.col("cell").alias("cell_b"))
    pairs = cut_lineage(cells.join(other, "family").filter(
        (F.col("cell") <= F.col("cell_b")) & ((F.col("pure") == "") | (F.col("pure") != F.col("pure_b")))))
    meet = F.concat_ws("|", "cell", "cell_b").alias("meet")
    routes = pairs.select("cell", meet).unionByName(pairs.select(F.col("cell_b").alias("cell"), meet)).distinct()
    rows = rest.join(routes, "cell").withColumn("cell", F.col("meet")).drop("meet")
    return relabel(members, join(rows))


def families(pairs: DataFrame, node: str) -> DataFrame:
    """(node, family) of all nodes of ``pairs`` (a, b), directly or through others. Eager."""
    return connected(pairs, "a", "b").select(F.col("node").alias(node), F.col("root").alias("family"))
