"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialized


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable), for every id in a link.

    Each round takes the smallest label among the neighbours and then the label of that
    label, so chains shorten by half; rounds stop when nothing changes. Each round's labels
    are written to the shared folder, and no link reaches the driver. Links with a null end
    don't count.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = materialized(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialized(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), "label")
        up = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        new = materialized(new.join(up, "next", "left").select(
            "id", F.least("next", F.coalesce("above", "next")).alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
