"""Connected components of a table of links, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import durable, hot_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has a link; the component is its smallest node.

    Each turn takes the smallest label of a node's neighbours, then the label of that label. Labels
    of a turn are kept in the shared folder; nothing but a count reaches the driver. A node with very
    many links is only ever the key of a minimum, which is combined before the shuffle, or of a join
    that sends the labels of such nodes to the links. Null ends and loops make no link.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = durable(both.union(both.select("other", "node")).distinct())
    labels = durable(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"), F.count("*").alias("degree")))
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"), "degree")
        near = hot_join(both, theirs, ["other"], "degree").groupBy("node").agg(F.min("theirs").alias("theirs"))
        stepped = durable(
            labels.join(near, "node").select("node", "degree", F.least("label", "theirs").alias("label"), F.col("label").alias("was"))
        )
        # a component may hold a third of all nodes under one label
        sizes = stepped.groupBy(F.col("label").alias("at")).agg(F.count("*").alias("m"))
        jump = sizes.join(stepped.select(F.col("node").alias("at"), F.col("label").alias("further")), "at")
        jumped = hot_join(stepped.withColumn("at", F.col("label")), durable(jump), ["at"], "m")
        labels = durable(jumped.select("node", "degree", F.least("label", "further").alias("label"), "was"))
        if labels.where("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("was")
