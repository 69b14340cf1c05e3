"""Connected components: union-find within tasks, then rounds of hooking and jumping between them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import map_rows, staged

TASK_LINKS = 500_000  # links whose union-find one task holds


def _stars(links: DataFrame, tasks: int) -> DataFrame:
    """`node`, `label`: every node with the smallest one that its task's links join it to."""
    nodes = dict(links.dtypes)["a"]

    def rows(batches) -> Iterator[tuple]:
        above: dict = {}

        def root(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = root(a), root(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
            if len(above) > 2 * TASK_LINKS:
                yield from ((x, root(x)) for x in list(above))
                above.clear()
        yield from ((x, root(x)) for x in list(above))

    links = links.select("a", "b")
    # one task must hold them all if one is enough: a count that comes with a key may be raised by the cluster
    dealt = links.repartition(tasks, "a") if tasks > 1 else links.repartition(1)
    return map_rows(dealt, rows, f"node {nodes}, label {nodes}")


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` (smallest node of its component) for every node of `links` (a, b).

    Tasks turn their links into stars first; if one task holds all links, that is the
    answer.  Else labels fall in rounds: a round takes the smallest label of all neighbours
    (combined before the shuffle, so a node with very many links is no hot spot) and then
    the label of its label, which halves the length of chains; each round is a staged table.
    """
    tasks = -(-links.count() // TASK_LINKS)
    stars = staged(_stars(links, max(tasks, 1)), "stars")
    if tasks <= 1:
        return stars
    links = stars.select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = staged(links.union(links.select("b", "a")), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        )
        hooked = labels.join(heard, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label")
        )
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = staged(
            hooked.join(target, "label", "left")
            .select("node", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("old")).alias("moved")),
            "labels",
        )
        labels = jumped.drop("moved")
        if jumped.where("moved").limit(1).isEmpty():
            return labels
