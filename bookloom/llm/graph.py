"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each id in links (a, b) is connected with.

    Every round takes the smallest label among the neighbours, hangs whole trees together (the old label follows
    the new one) and halves the way to the root, so rounds grow with the logarithm of the longest path. Sums and minima
    are combined before the shuffle; a vertex with very many links is split by the join. Only a count reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    label = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        # what a vertex hears also goes to the root it pointed to
        heard = label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("m"))
        told = heard.select("id", "m").union(heard.where("m < old").select(F.col("old").alias("id"), "m")) \
            .groupBy("id").agg(F.min("m").alias("comp"))
        up = told.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = cut_lineage(told.join(up, "comp", "left").select("id", F.least("comp", F.coalesce("top", "comp")).alias("comp")))
        changed = new.join(label.select("id", F.col("comp").alias("was")), "id").where("comp <> was").limit(1).count()
        label = new
        if not changed:
            return label
