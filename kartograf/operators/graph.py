"""Neighbour graphs: components, geodesic distances, shortest-path trees and paths.

A graph is an edge table (``src``, ``dst``, ``w``) over BIGINT nodes, used without direction.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.operators.geodesics import Geodesics
from kartograf.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; of parallel edges the lightest."""
    extra = [c for c in edges.columns if c not in ("src", "dst", "w")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", *extra)
    both = edges.select("src", "dst", "w", *extra).union(back)
    best = F.min(F.struct("w", *extra))
    return both.groupBy("src", "dst").agg(best.alias("_e")).select("src", "dst", "_e.*")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's component: (``id``, ``component``).

    Every round takes the smallest label among the neighbours (min is combined before the shuffle,
    so a hub is no burden) and then follows labels one jump ahead, so the number of rounds grows
    with the logarithm of the longest chain of labels rather than with its length.
    """
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(nodes.select(F.col("id"), F.col("id").alias("component")))
    while True:
        offered = both.join(labels, both["src"] == labels["id"]).groupBy("dst").agg(F.min("component").alias("_best"))
        near = labels.join(offered, labels["id"] == offered["dst"], "left").select(
            "id", "component", F.least("component", F.coalesce("_best", "component")).alias("_new"))
        ahead = near.select(F.col("id").alias("_at"), F.col("_new").alias("_next"))
        after = near.join(ahead, near["_new"] == ahead["_at"]).select(
            "id", F.col("_next").alias("component"), (F.col("_next") != F.col("component")).alias("_moved"))
        after = cut(after)
        labels = after.select("id", "component")
        if after.filter("_moved").limit(1).count() == 0:
            return labels


def geodesics_from(edges: DataFrame, sources: DataFrame, keep_upper: bool = False, unreached: bool = False) -> DataFrame:
    """Distances from every source to every node it reaches: (``src``, ``dst``, ``d``).

    With all nodes as sources and ``keep_upper`` this is the condensed geodesic file (src < dst);
    ``unreached`` adds the pairs that no path connects, at a distance of infinity.
    """
    return Geodesics(cut(undirected(edges).select("src", "dst", "w"))).distances(sources, keep_upper, unreached)


def geodesic_summary(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the number of nodes reached, the mean and the largest geodesic distance."""
    return Geodesics(cut(undirected(edges).select("src", "dst", "w"))).summary(sources)


def geodesics_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Geodesic distance ``d`` of each given pair (``i``, ``j``); NULL where not connected.

    This is what pair training reads: the distances of the pairs it drew, not all of them.
    """
    return Geodesics(cut(undirected(edges).select("src", "dst", "w"))).between(pairs)


def shortest_path_trees(edges: DataFrame, targets: DataFrame, together: bool = False) -> DataFrame:
    """Predecessor of every node on its way to each target: (``target``, ``node``, ``pred``, ``d``, ``hops``).

    ``pred`` is -1 at the target itself.  Of equally short ways the one with fewest hops is taken,
    then the smallest predecessor.  Nodes that cannot reach the target have no row.  Where ``together`` is asked for, the rows of
    a tree follow each other in one partition; over a graph of one block they do so anyway and nothing is shuffled.
    """
    found = Geodesics(cut(undirected(edges).select("src", "dst", "w")))
    trees = found.trees(targets)
    return trees if found.whole or not together else trees.repartition("target").sortWithinPartitions("target")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes on the way from ``source`` to ``target`` for each requested pair: adds ``nodes``.

    ``pairs`` has (``path_id``, ``source``, ``target``).  Unreachable pairs give no row.
    """
    wanted = pairs.select("path_id", "source", "target")
    paths = Geodesics(cut(undirected(edges).select("src", "dst", "w"))).paths(wanted)
    return wanted.join(paths, "path_id").select("path_id", "source", "target", "nodes")


def geodesic_rows(edges: DataFrame, sources: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Distances from every source as pieces of rows, (``src``, ``first``, ``d`` ARRAY<DOUBLE>), and how many nodes a piece holds.

    Nodes are in the order of their ids; a piece begins at node ``first``, infinity stands where no path leads.
    """
    return Geodesics(cut(undirected(edges).select("src", "dst", "w"))).rows(sources, width)


def longest_path_hops(trees: DataFrame) -> int:
    """Largest number of nodes on any way to a root.

    Trees that carry ``hops``, the length of each node's way, are only read; in others the predecessor jump is doubled.
    """
    if "hops" in trees.columns:
        return int(trees.agg(F.max("hops")).first()[0] or 0) + 1
    jumps = cut(trees.select("target", "node", F.col("pred").alias("to"), F.when(
        F.col("pred") == -1, 0).otherwise(1).alias("steps")))
    while True:
        ahead = jumps.select(F.col("target").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_to"),
                             F.col("steps").alias("_s"))
        moved = jumps.join(ahead, (F.col("target") == F.col("_t")) & (F.col("to") == F.col("_n")), "left")
        jumps = cut(moved.select("target", "node", F.coalesce("_to", "to").alias("to"),
                                 (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps")))
        if jumps.filter("to <> -1").limit(1).count() == 0:
            return (jumps.agg(F.max("steps")).first()[0] or 0) + 1


def contract_trees(trees: DataFrame, contractable: int, together: bool = False) -> DataFrame:
    """Skip nodes between two hops of the contractable kind.

    ``trees`` has (``target``, ``node``, ``pred``, ``choice``), choice being the kind of the hop from
    node to pred.  Pointer jumping: in each round every node whose own hop and whose predecessor's
    hop are of that kind takes its predecessor's predecessor, unless that is the root's marker.  The
    jumps of a tree stay in the tree, so trees are dealt out once, each with one number per node and field.  Trees whose rows
    follow each other in one partition (``together``) are contracted where they are.
    """
    trees = trees.select("target", "node", "pred", "choice")

    def jumped(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("node")
        node, pred = tree["node"].to_numpy(), tree["pred"].to_numpy().copy()
        ours = (tree["choice"] == contractable).to_numpy()
        going = np.flatnonzero(ours)
        while len(going):
            at = np.minimum(np.searchsorted(node, pred[going]), len(node) - 1)
            going = going[(node[at] == pred[going]) & ours[at] & (pred[at] != -1)]
            at = np.searchsorted(node, pred[going])
            pred[going] = pred[at]
        return tree.assign(pred=pred)

    def in_place(batches):
        held = []
        for rows in batches:
            target = rows["target"].to_numpy()
            ends = [*(np.flatnonzero(target[1:] != target[:-1]) + 1), len(rows)] if len(rows) else []
            for a, b in zip([0, *ends], ends):
                if held and held[0]["target"].iloc[0] != target[a]:
                    yield jumped(pd.concat(held))
                    held = []
                held.append(rows.iloc[a:b])
        if held:
            yield jumped(pd.concat(held))

    if together:
        return trees.mapInPandas(in_place, trees.schema)
    return trees.groupBy("target").applyInPandas(jumped, trees.schema)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
