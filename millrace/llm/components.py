"""Connected components of a link table, distributed: smallest reachable id of every linked id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, discard


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label's own label (pointer
    jumping), so long chains take logarithmically many rounds.  Every round is a written table.
    Null ends and self links are ignored; no links give no rows.
    """
    spark = links.sparkSession
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        near = labels.join(heard.withColumnRenamed("u", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("near"))
        # the least label heard also goes to the old label, so that whole trees hook at once
        hooks = near.groupBy("old").agg(F.min("near").alias("hook")).select(F.col("old").alias("near"), "hook")
        jumped = cut(near.join(hooks, "near", "left").select("id", "old", F.least("near", F.coalesce("hook", "near")).alias("component")), "labels")
        changed = jumped.where("component <> old").limit(1).count()
        discard(spark, labels)
        labels = jumped
        if not changed:
            discard(spark, edges)
            return labels.select("id", "component")
