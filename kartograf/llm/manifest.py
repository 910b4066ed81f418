"""Merkle manifest of a dataset: one root over all rows, and for each row the proof that it belongs.

Every source is a tree over its rows in order of their ids, and the roots of the sources are the leaves of one more tree.
Nodes are numbered, and each aligned block of ``WIDTH ** DEPTH`` of them is one row that keeps every level as one string
of hex digests.  Fixed-width substrings of a level hash to the next one, and what flanks a node in its run is a segment
of its proof.  Block roots are the nodes of the next round, so a tree of n nodes takes about log n / (DEPTH log WIDTH)
rounds.  On the way back, blocks hand the segments above them down to their nodes, one join per round.

All is SQL expressions; no block is larger than its fixed number of nodes, whatever a source holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import stored

WIDTH = 3  # nodes of a run
DEPTH = 5  # levels of a block
HEX = 64  # characters of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def numbered(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """``nodes`` with ``_at``, their number within their tree: in the order of the columns, NULLs first.

    Rows are range-partitioned; a partition's rows know their place in it, and each (partition, tree)
    has one row that says where it starts.
    """
    sorted_rows = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    rows = stored(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "sorted")
    starts = rows.groupBy(F.col("_part").alias("_p"), F.col(tree).alias("_t")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = starts.selectExpr("_p", "_t", "_first", "sum(_n) OVER (PARTITION BY _t ORDER BY _p) - _n AS _before")
    at = F.col("_before") + F.col("_row") - F.col("_first")
    return rows.join(stored(starts, "starts"), (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t"))).select(*nodes.columns, at.alias("_at"))


def _cut(level: Column, at: Column, count: Column) -> Column:
    """Digests ``at`` to ``at + count`` of a level; levels are bytes, where a substring does not count characters."""
    return F.substring(level, (at * HEX + 1).cast("int"), (count * HEX).cast("int"))


def _parents(level: Column) -> Column:
    """The next level: every run of ``WIDTH`` digests becomes theirs."""
    runs = F.ceil(F.octet_length(level) / (WIDTH * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(_cut(level, i * WIDTH, F.lit(WIDTH)))), "").cast("binary")


def _levels(blocks: DataFrame) -> DataFrame:
    """``blocks`` (_tree, _block, _last, l0) with the levels above; a tree's only block ends at its root."""
    for k in range(DEPTH):
        below = F.col(f"l{k}")
        more = (F.col("_last") > 0) | (F.octet_length(below) > HEX)
        blocks = blocks.withColumn(f"l{k + 1}", F.when(below.isNotNull() & more, _parents(below)))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(DEPTH, -1, -1)])
    return blocks.withColumn("node", top.cast("string"))


def _segments(place: Column) -> Column:
    """What flanks the node at ``place`` on each level of its block."""
    parts = []
    for k in range(DEPTH):
        level, at = F.col(f"l{k}"), F.floor(place / WIDTH**k)
        run = at - at % WIDTH
        left, right = _cut(level, run, at - run), F.substring(level, ((at + 1) * HEX + 1).cast("int"), ((run + WIDTH - 1 - at) * HEX).cast("int"))
        parts.append(F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))))
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def _grow(nodes: DataFrame, tree: str, carried: list[str]) -> list[DataFrame]:
    """Rounds of blocks over numbered ``nodes`` (tree, _at, node, carried...), the last with one block per tree.

    Each is (_tree, _block, _last, items, l0 ..., node); ``items`` holds what is carried of each node, in order.
    """
    size, rounds = WIDTH**DEPTH, []
    last = nodes.groupBy(F.col(tree).alias("_t")).agg(F.max("_at").alias("_most"))
    level = nodes.select(F.col(tree).alias("_tree"), "_at", "node", *carried)
    lasts = stored(last, "trees")
    while True:
        block = F.floor(F.col("_at") / size).cast("bigint")
        items = F.array_sort(F.collect_list(F.struct("_at", "node", *carried)))
        blocks = level.groupBy("_tree", block.alias("_block")).agg(items.alias("items"))
        ends = lasts.select("_t", F.floor(F.col("_most") / size**(len(rounds) + 1)).cast("bigint").alias("_last"))
        blocks = blocks.join(ends, F.col("_tree").eqNullSafe(F.col("_t"))).drop("_t")
        l0 = F.array_join(F.col("items.node"), "").cast("binary")
        rounds.append(stored(_levels(blocks.withColumn("l0", l0)), "blocks"))
        level = rounds[-1].filter("_last > 0").select("_tree", F.col("_block").alias("_at"), "node")
        carried = []
        if level.isEmpty():
            return rounds


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``above``, the segments from their root up; ``above`` (_t, above) is for whole trees."""
    paths = None
    for blocks in reversed(rounds):
        tops = blocks.filter("_last = 0").join(above, F.col("_tree").eqNullSafe(F.col("_t")), "left").drop("_t")
        lower = blocks.filter("_last > 0")
        both = tops if paths is None else tops.unionByName(lower.join(
            paths, F.col("_tree").eqNullSafe(F.col("_pt")) & (F.col("_block") == F.col("_pb"))).drop("_pt", "_pb"))
        if blocks is rounds[0]:
            return both
        size = WIDTH**DEPTH
        own = F.transform("items", lambda i: F.struct(i["_at"].alias("_pb"), F.concat(_segments(i["_at"] % size), F.col("above")).alias("above")))
        paths = stored(both.select(F.col("_tree").alias("_pt"), F.inline(own)), "paths")
    raise ValueError("no rounds")


def folded(leaf: Column, segments: Column) -> Column:
    return F.aggregate(segments, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", columns: tuple[str, ...] = COLUMNS,
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, proof, proof_sha256, folded_root, verified), one row per input row.

    ``columns`` make up a leaf; rows of one ``tree_col`` (NULLs are one tree) ascend by ``id_col``, NULL
    first, equal ids by their leaves, so that repeated rows change nothing but take places of their own.
    ``proof`` lists what flanks the row's nodes level by level.  ``tampered`` gives the columns of a row
    as they are found later: ``folded_root`` is the root that this row and the stored proof lead to,
    ``verified`` whether it is the same.  Empty and very long texts are hashed whole; an empty table
    gives no rows.  Other columns are not read.
    """
    found = [(tampered or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(tree_col).cast("string").alias("_source"), leaf_digest([F.col(c) for c in columns]).alias("node"),
                       leaf_digest(found).alias("_found"))
    # written first: finding the ranges would read and hash all texts a second time
    rows = stored(rows.withColumn("_found", F.when(F.col("_found") != F.col("node"), F.col("_found"))), "leaves")
    placed = numbered(rows, "_source", "_id", "node", "_found")
    rounds = _grow(placed, "_source", ["_id", "_found"])
    subroots = None
    for blocks in rounds:
        tops = blocks.filter("_last = 0").select(F.col("_tree").alias("_source"), "node")
        subroots = tops if subroots is None else subroots.unionByName(tops)
    tops = numbered(subroots.withColumn("_all", F.lit(0)), "_all", "_source")
    upper = _grow(tops, "_all", ["_source"])
    top_root = upper[-1].filter("_last = 0").select("node")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    start = tops.groupBy(F.col("_all").alias("_t")).agg(F.first(nothing).alias("above"))
    size = WIDTH**DEPTH
    over = _descend(upper, start).select(F.inline(F.transform("items", lambda i: F.struct(
        i["_source"].alias("_t"), i["node"].alias("subroot"), F.concat(_segments(i["_at"] % size), F.col("above")).alias("above")))))
    over = stored(over.withColumn("root", top_root.scalar()), "subroots")
    blocks = _descend(rounds, over.select("_t", "above"))
    own = F.transform("items", lambda i: F.struct(i["_id"].alias(id_col), i["node"].alias("leaf"), i["_found"].alias("_found"),
                                                  F.concat(_segments(i["_at"] % size), F.col("above")).alias("_path")))
    out = blocks.join(over.select("_t", "subroot", "root"), F.col("_tree").eqNullSafe(F.col("_t"))).select("subroot", "root", F.inline(own))
    proof = F.filter(F.flatten(F.transform("_path", lambda s: F.array(s["left"], s["right"]))), lambda p: p != "")
    out = out.withColumn("proof", proof).withColumn("folded_root", folded(F.coalesce("_found", "leaf"), F.col("_path")))
    return out.select(id_col, "leaf", "subroot", "root", "proof", digest(F.array_join("proof", "")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
