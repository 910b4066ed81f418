"""Connected parts of large graphs by local forests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import stored
from kartograf.operators.graph import connected_components

EDGES = 500_000  # edges of one local forest


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(src, dst): each node of a partition's edges with the smallest node that they connect it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["src"].tolist(), batch["dst"].tolist()):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pd.DataFrame({"src": some, "dst": [find(x) for x in some]})


def components(edges: DataFrame) -> DataFrame:
    """(key, label): every node of the edges (src, dst) with the smallest node of its connected part.

    Each partition of up to ``EDGES`` edges finds its own forest; a node takes the smallest root it
    has anywhere, and its roots are the edges of the next, smaller level.  Should a level hardly
    shrink, as that of a long chain would, labels jump along pointers instead.  Self-loops and
    repeated edges change nothing; no edges give no rows.
    """
    level, layers = stored(edges.select("src", "dst"), "edges"), []
    while True:
        count = level.count()
        parts = max(1, -(-count // EDGES))
        forest = stored(level.coalesce(parts).mapInPandas(_forest, "src bigint, dst bigint"), "forest")
        layers.append(stored(forest.groupBy("src").agg(F.min("dst").alias("dst")), "layer") if parts > 1 else forest)
        if parts == 1:
            break
        least = layers[-1].select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
        roots = forest.join(least, F.col("src") == F.col("_src")).filter("dst <> _dst").select(F.col("dst").alias("src"), F.col("_dst").alias("dst")).distinct()
        level = stored(roots, "edges")
        if 2 * level.count() > count:
            nodes = level.select(F.col("src").alias("id")).union(level.select("dst")).distinct()
            layers.append(connected_components(nodes, level).select(F.col("id").alias("src"), F.col("component").alias("dst")))
            break
    labels = layers[-1]
    for layer in reversed(layers[:-1]):
        above = labels.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
        labels = stored(layer.join(above, F.col("dst") == F.col("_src"), "left").select("src", F.coalesce("_dst", "dst").alias("dst")), "layer")
    return labels.select(F.col("src").alias("key"), F.col("dst").alias("label"))
