"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.session import written

#: So many links are one task's work: shuffles would cost more than the steps, in files and in time.
FEW_LINKS = 1 << 16


def _stars(links: DataFrame, larger: bool, few: bool = False) -> DataFrame:
    """One star step: every neighbour on one side of a node is linked to the least node around.

    The least neighbour is a partial aggregate, so a node with very many links costs one row per
    task before the shuffle; the join back is a plain equi-join that Spark may split. ``few`` links stay in one partition.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = dealt(both)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(F.broadcast(least) if few else least, "a")
    if larger:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return dealt(out.where(F.col("a") != F.col("b"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, comparable): the least node reachable.

    Alternates star steps until nothing changes; every round is written to the shared folder, so a
    lost executor costs no more than a round. Links with a null end or between equal nodes are left out;
    repeated links do no harm; no links give no rows.
    """
    clean = links.select("a", "b").where(F.col("a") != F.col("b"))
    state, mark = written(_stars(clean.distinct(), larger=True), "links"), None
    few = state.count() <= FEW_LINKS  # and never more: no step gives more links than it gets
    while True:
        state = written(_stars(_stars(state, larger=False, few=few), larger=True, few=few), "links")
        # equal sets of links have equal sums
        now = state.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))
        ).first()
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
