"""Connected components as a distributed loop: least labels along links, then label of label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, store


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component) of every end of ``links`` (u, v); component is the least id reachable.

    Each round takes the least label among a node's neighbours (aggregated before the shuffle) and
    then follows it one step, so that the number of rounds grows with the logarithm of the longest
    path. Labels and links live in tables in the shared folder; the driver sees one count a round.
    """
    links = links.where("u <> v")
    both = store(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = store(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).withColumnRenamed("u", "id"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("component").alias("near")).withColumnRenamed("u", "id")
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        beyond = labels.select(F.col("id").alias("step"), F.col("component").alias("jump"))
        new = store(least.join(beyond, "step", "left").select("id", "old", F.least("step", F.coalesce("jump", "step")).alias("component")), "labels")
        moved = new.where("component <> old").limit(1).count()
        drop(labels)
        labels = new.select("id", "component")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    drop(both)
    return labels
