"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hot_keys import join_by_key
from plumbline.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``: the smallest node that it is connected with.

    Each round takes the least label among a node's neighbours and then the label of that label, so
    labels travel twice as far each round. A node with many links, and the label of a large component,
    are hot keys, joined by ``join_by_key``; nothing of a component comes together but by a partial
    minimum. Every round is written to the shared folder.

    Defined results: a link given twice or both ways counts once; a node linked with itself alone is its
    own component; links with a null end are left out; no links give no rows.
    """
    links = links.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    n_links = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("degree")).select("node", F.least("node", "least").alias("label"), "degree"), "labels")
    while True:
        near = join_by_key(both, labels.withColumnRenamed("node", "b"), ["b"], "degree", total=n_links).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label")), "lower")
        sizes = lower.groupBy("label").agg(F.count("*").alias("size"))
        up = written(sizes.join(lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label"), "up")
        jumped = join_by_key(lower, up, ["label"], "size").select("node", "degree", "old", F.least("label", "next").alias("label"))
        jumped = written(jumped, "labels")
        changed = jumped.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = jumped.select("node", "label", "degree")
        if not changed:
            return labels.select("node", "label")
