"""Near copies among vectors by a forest of random-projection trees.

1. Equal vectors are one class, so that a group of copies costs one comparison.
2. Hot clouds go first, exactly.  Vectors within half the angle of the threshold of one centre all
   link, and need only be counted.  Centres are those of which a bounded sample holds ``CROWD``
   vectors or more; every other vector that could reach a member visits the whole cloud, in blocks.
3. The rest goes down ``trees`` trees: each node projects on a random direction and splits at a random
   quantile near the middle, and vectors near the split go both ways.  Trees are fitted on a bounded
   sample; leaves that come out too large are sampled and split again, so that depth follows the data.
   A node whose sample mostly links is not split but compared in blocks.
4. Leaves are compared whole.  A linked pair counts in the smallest leaf both are in, so tasks return
   sums and local forests, linear in the vectors, and no list of pairs.

Links found are verified in double precision.  Only the third step can miss any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored
from kartograf.llm.connect import components

THRESHOLD = 0.9
TREES = 16
LEAF = 1_000  # vectors of a leaf that is not split further
SPILL = 0.05  # share of a node that goes both ways, on either side of the split
SAMPLE = 16_384  # vectors that trees are fitted on
SAMPLE_BYTES = 32 << 20  # of that sample, should vectors be very long
NODE_SAMPLE = 4_096  # vectors of a node that its further splits are fitted on
LEAST = 32  # sampled vectors of a node that may be split
CROWD_SAMPLE = 4_096  # vectors in which clouds are looked for
CROWD = 16  # of them within reach of a centre: a cloud
BLOCK = 2_000  # vectors of a block where a leaf or a cloud is compared in blocks
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def child(node: int, side: int) -> int:
    """The id of a node's child: the tree in the highest byte, a hash of the way below it."""
    z = (node * 2 + side + 1) * _MIX[0] & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 30)) * _MIX[1] & 0xFFFFFFFFFFFFFFFF
    z = (z ^ (z >> 27)) * _MIX[2] & 0xFFFFFFFFFFFFFFFF
    return (node >> 55 << 55) | ((z ^ (z >> 31)) & ((1 << 55) - 1))


def direction(node: int, dim: int) -> np.ndarray:
    return np.random.default_rng(node).standard_normal(dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pd.Series, kind: str) -> np.ndarray:
    """Unit vectors of a column of packed ones of one length."""
    return unit(np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def fit(root: int, sample: np.ndarray, rows: float, leaf: int, threshold: float) -> dict[int, tuple[float, float]]:
    """Splits of a tree: node to (from here right, up to here left).  ``rows`` is what the sample stands for."""
    splits, todo = {}, [(root, np.arange(len(sample)))]
    while todo:
        node, own = todo.pop()
        if len(own) < LEAST or rows * len(own) / len(sample) <= leaf:
            continue
        some = sample[own[:256]]
        if ((some @ some.T >= threshold).mean()) > 0.5:
            continue
        p = sample[own] @ direction(node, sample.shape[1])
        at = 0.4 + 0.2 * np.random.default_rng(node ^ 1).random()
        low, high = np.quantile(p, [at - SPILL, at + SPILL])
        left, right = own[p < high], own[p >= low]
        if max(len(left), len(right)) > 0.9 * len(own):  # equal projections
            continue
        splits[node] = (float(low), float(high))
        todo += [(child(node, 0), left), (child(node, 1), right)]
    return splits


def route(root: int, splits: dict[int, tuple[float, float]], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, numbers of the rows in it)"""
    todo = [(root, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if node not in splits:
            yield node, own
        elif len(own):
            low, high = splits[node]
            p = rows[own] @ direction(node, rows.shape[1])
            todo += [(child(node, 0), own[p < high]), (child(node, 1), own[p >= low])]


def clouds(sample: np.ndarray, reach: float) -> np.ndarray:
    """Centres of clouds, the fullest first; ``reach`` is the least cosine with a centre."""
    left, centres = np.arange(len(sample)), []
    near = sample @ sample.T >= reach
    while len(left):
        counts = near[np.ix_(left, left)].sum(axis=1) if not centres else counts
        best = int(counts.argmax())
        if counts[best] < CROWD:
            break
        centre = sample[left[near[left[best], left]]].sum(axis=0)
        centres.append(centre / np.linalg.norm(centre))
        gone = (sample[left] @ centres[-1] >= reach) | near[left[best], left]
        counts = counts[~gone] - near[np.ix_(left[~gone], left[gone])].sum(axis=1)
        left = left[~gone]
    return np.array(centres).reshape(-1, sample.shape[1])


def _grouped(numbers: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest number that each row is connected with by the links (r, c)."""
    label = numbers.copy()
    while len(r):
        least = np.minimum(label[r], label[c])
        before = label.copy()
        np.minimum.at(label, r, least)
        np.minimum.at(label, c, least)
        if (label == before).all():
            break
    return label


def _links(x: np.ndarray, y: np.ndarray, threshold: float, above: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs, a tile at a time; ``above``: x is y, and only pairs above the diagonal count."""
    for a in range(0, len(x), BLOCK):
        for b in range(a if above else 0, len(y), BLOCK):
            hit = x[a : a + BLOCK] @ y[b : b + BLOCK].T >= threshold
            r, c = np.nonzero(np.triu(hit, 1) if above and a == b else hit)
            for k in range(0, len(r), 1 << 18):
                yield r[k : k + (1 << 18)] + a, c[k : k + (1 << 18)] + b


def _by_tree(leaves: list, own: int) -> list[np.ndarray]:
    """Per tree up to that of leaf ``own``: a padded table of each row's leaves before ``own``; padding equals nothing."""
    sizes = [len(x) for x in leaves]
    flat = np.concatenate(leaves).astype(np.int64)
    row = np.repeat(np.arange(len(leaves)), sizes)
    keep = flat < own
    flat, row = flat[keep], row[keep]
    tree, tables = flat >> 55, []
    for t in np.unique(tree).tolist():
        ids, at = flat[tree == t], row[tree == t]
        start = np.searchsorted(at, np.arange(len(leaves)))
        place = np.arange(len(at)) - start[at]
        table = np.full((len(leaves), int(place.max()) + 1), -1, dtype=np.int64)
        table[at, place] = ids
        tables.append(table)
    return tables


def _first_here(tables: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share no earlier leaf."""
    for table in tables:
        if not len(r):
            break
        a, b, shared = table[r], table[c], np.zeros(len(r), dtype=bool)
        for i in range(a.shape[1]):
            shared |= ((a[:, i, None] == b) & (a[:, i, None] >= 0)).any(axis=1)
        r, c = r[~shared], c[~shared]
    return r, c


_FOUND = "key bigint, links bigint, root bigint"


def _answer(keys: np.ndarray, links: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    some = np.flatnonzero(links)
    return pd.DataFrame({"key": keys[some], "links": links[some], "root": label[some]})


def _in_leaf(threshold: float, kind: str):
    """Links of a leaf, or of a pair of its blocks, that no smaller leaf has."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaf = int(group[0])
        low, high = int(group[1]) >> 31, int(group[1]) & ((1 << 31) - 1)
        rows = rows.sort_values("key", kind="stable")
        keys, m, tables = rows["key"].to_numpy(), rows["m"].to_numpy(), _by_tree(list(rows["leaves"]), leaf)
        x, part = matrix(rows["v"], kind), rows["part"].to_numpy()
        a, b = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links, edges = np.zeros(len(keys), dtype=np.int64), []
        for r, c in _links(x[a], x[b], threshold, low == high):
            r, c = _first_here(tables, a[r], b[c])
            np.add.at(links, r, m[c])
            np.add.at(links, c, m[r])
            edges.append((r, c))
        r, c = (np.concatenate(e) for e in zip(*edges)) if edges else (np.empty(0, dtype=np.int64),) * 2
        return _answer(keys, links, _grouped(keys, r, c))

    return run


def _in_cloud(threshold: float, kind: str):
    """Links between a block of a cloud and a block of its visitors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["guest", "key"], kind="stable")
        keys, m, guest = rows["key"].to_numpy(), rows["m"].to_numpy(), rows["guest"].to_numpy()
        x, first = matrix(rows["v"], kind), int((~guest).sum())
        links, label, edges = np.zeros(len(keys), dtype=np.int64), keys.copy(), []
        for r, c in _links(x[:first], x[first:], threshold, False):
            c = c + first
            np.add.at(links, r, m[c])
            np.add.at(links, c, m[r])
            edges.append((r, c))
        if edges:
            r, c = (np.concatenate(e) for e in zip(*edges))
            label = _grouped(keys, r, c)
        return _answer(keys, links, label)

    return run


def _home_and_leaves(centres: np.ndarray, models: list[dict], threshold: float, kind: str):
    """Each class with its cloud, the clouds it must visit, or else its leaf in each tree (several where it spills)."""
    theta = math.acos(threshold)
    member, visit = math.cos(theta / 2) + 1e-12, math.cos(min(1.5 * theta, math.pi)) - 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"], kind)
            home = np.full(len(x), -1, dtype=np.int32)
            visits: list[list[int]] = [[] for _ in range(len(x))]
            leaves: list[list[int]] = [[] for _ in range(len(x))]
            if len(x) and len(centres):
                cos = x @ centres.T
                home = np.where(cos.max(axis=1) >= member, cos.argmax(axis=1), -1).astype(np.int32)
                # of two clouds the lower one's members visit
                for r, c in np.argwhere((cos >= visit) & (np.arange(len(centres))[None] > home[:, None])).tolist():
                    visits[r].append(c)
            free = np.flatnonzero(home < 0)
            for tree, splits in enumerate(models) if len(free) else []:
                for leaf, own in route(tree << 55, splits, x[free]):
                    for r in free[own].tolist():
                        leaves[r].append(leaf)
            yield batch[["key", "m", "v"]].assign(home=home, visits=visits, leaves=[sorted(v) for v in leaves])

    return run


_ROUTED = "key bigint, m bigint, v binary, home int, visits array<int>, leaves array<bigint>"


def _fit_node(leaf: int, threshold: float, kind: str):
    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        splits = fit(int(group[0]), matrix(rows["v"], kind), float(rows["size"].iloc[0]), leaf, threshold)
        model = np.array([(k, a, b) for k, (a, b) in splits.items()], dtype=[("node", "<i8"), ("low", "<f8"), ("high", "<f8")])
        return pd.DataFrame({"_node": [int(group[0])], "model": [model.tobytes()]})

    return run


def _down(kind: str):
    """Each visit of a node goes on to that node's leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, rows in batch.groupby("leaf"):
                model = np.frombuffer(rows["model"].iloc[0], dtype=[("node", "<i8"), ("low", "<f8"), ("high", "<f8")])
                splits = {int(k): (a, b) for k, a, b in model.tolist()}
                for leaf, own in route(int(node), splits, matrix(rows["v"], kind)):
                    yield rows.iloc[own][["key", "v"]].assign(leaf=leaf, final=leaf == node)

    return run


def _split_again(routed: DataFrame, leaf: int, threshold: float, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """Leaves above twice ``leaf`` are sampled and split until there is nothing more to split: ``routed`` with its
    last leaves, and the (leaf, size) of those that stay large."""
    visits, settled = routed.select("key", "v", F.explode("leaves").alias("leaf"), F.lit(False).alias("final")), []
    while True:
        sizes = stored(visits.groupBy("leaf", "final").agg(F.count("*").alias("size")).filter(F.col("size") > 2 * leaf), "sizes")
        large = sizes.filter("NOT final").select(F.col("leaf").alias("_node"), "size")
        if large.isEmpty():
            break
        open_ = visits.join(large, F.col("leaf") == F.col("_node"))
        chosen = open_.filter(F.pmod(F.xxhash64("key", "leaf"), F.col("size")) < NODE_SAMPLE)
        models = stored(chosen.groupBy("leaf").applyInPandas(_fit_node(leaf, threshold, kind), "_node bigint, model binary"), "splits")
        settled.append(visits.join(large, F.col("leaf") == F.col("_node"), "left_anti").select("key", "leaf"))
        visits = stored(visits.join(models, F.col("leaf") == F.col("_node")).mapInPandas(_down(kind), "key bigint, v binary, leaf bigint, final boolean"), "visits")
    if not settled:
        return routed, None
    for part in [visits.select("key", "leaf")]:
        settled.append(part)
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    lists = every.groupBy("key").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")).withColumnRenamed("key", "_key")
    routed = stored(routed.drop("leaves").join(lists, F.col("key") == F.col("_key"), "left").drop("_key"), "routed")
    return routed, sizes.select(F.col("leaf").alias("_node"), "size")


def _blocks(rows: DataFrame, size, name: str) -> DataFrame:
    """``rows`` with a block of about ``BLOCK`` of the ``size`` rows that they are among."""
    return rows.withColumn("_many", F.ceil(size / BLOCK).cast("int")).withColumn(name, F.pmod(F.xxhash64("key"), F.col("_many")).cast("int"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES,
                 leaf: int = LEAF) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    ``n_links`` counts the other rows found with a cosine of ``threshold`` (above 0) or more, copies included;
    ``component_id`` is the smallest id reachable by links.  Vectors that are NULL, empty, zero or
    hold NULL or non-finite components link with nothing, nor do vectors of different lengths.
    Repeated rows are vectors like others; a NULL id counts as the smallest.  An empty table gives no
    rows.  Other columns are not read.

    Every row is indexed.  What is fitted on samples (at most ``SAMPLE`` vectors a tree, ``NODE_SAMPLE`` a node,
    ``CROWD_SAMPLE`` for clouds) is where trees split; each further round of splits is one pass.
    """
    kind, packed_as = ("<f8", "double") if dict(vectors.dtypes)[vec_col] != "array<float>" else ("<f4", "float")
    v = F.col("v")
    wrong = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = v.isNotNull() & (F.size(v) > 0) & ~wrong & F.exists(v, lambda c: c != 0)
    rows = vectors.select(solid(id_col).alias("id"), F.col(vec_col).cast(f"array<{packed_as}>").alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), v))
    classes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("m"))
    # keys rise with the smallest id of a class, so the smallest key of a component is that of its smallest id
    classes = stored(classes.repartitionByRange("first_id", F.xxhash64("v")).sortWithinPartitions("first_id", F.xxhash64("v")), "classes")
    classes = stored(_numbered(classes, kind), "numbered")
    answers = []
    for dim in [r["n"] for r in classes.select(F.size("a").alias("n")).distinct().sort("n").collect()]:
        answers += _of_length(classes.filter(F.size("a") == dim).select("key", "m", "v"), dim, threshold, trees, leaf, kind)
    found = None
    for part in answers:
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(hollow().alias(id_col), F.lit(0).cast("bigint").alias("n_links"), hollow().alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links")).withColumnRenamed("key", "_key")
    parts = components(found.filter("key <> root").select(F.col("key").alias("src"), F.col("root").alias("dst")))
    names = classes.select(F.col("key").alias("_label"), F.col("first_id").alias("_least"))
    parts = parts.join(names, F.col("label") == F.col("_label")).select(F.col("key").alias("_part"), "_least")
    told = classes.select("key", F.col("a").alias("_v"), F.col("first_id"), "m").join(links, F.col("key") == F.col("_key"), "left") \
        .join(parts, F.col("key") == F.col("_part"), "left")
    told = stored(told.select("_v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("_least", "first_id").alias("_component")), "told")
    out = rows.join(told, F.col("v") == F.col("_v"), "left")
    component = F.coalesce("_component", "id")
    return out.select(hollow().alias(id_col), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.nullif(component, F.lit(-(1 << 63))).alias("component_id"), (F.col("id") == component).alias("kept"))


def _numbered(classes: DataFrame, kind: str) -> DataFrame:
    """(key, first_id, m, a, v): classes under rising numbers, their vectors as arrays and packed."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(v=[np.asarray(a, dtype=kind).tobytes() for a in batch["a"]])

    rows = classes.select(F.monotonically_increasing_id().alias("key"), "first_id", "m", F.col("v").alias("a"))
    return rows.mapInPandas(pack, f"key bigint, first_id bigint, m bigint, a {classes.schema['v'].dataType.simpleString()}, v binary")


def _of_length(classes: DataFrame, dim: int, threshold: float, trees: int, leaf: int, kind: str) -> list[DataFrame]:
    """Tables (key, links, root) of the links among classes (key, m, v) of one length."""
    spark, n = classes.sparkSession, classes.count()
    most = max(CROWD, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = matrix(classes.orderBy(F.xxhash64("key"), "key").limit(most).select("v").toPandas()["v"], kind)
    reach = math.cos(math.acos(threshold) / 2)
    centres = clouds(sample[:CROWD_SAMPLE], reach)
    free = sample[(sample @ centres.T).max(axis=1) < reach] if len(centres) else sample
    models = [fit(t << 55, free, n * len(free) / len(sample), leaf, threshold) if len(free) else {} for t in range(trees)]
    routed = stored(classes.mapInPandas(_home_and_leaves(centres, models, threshold, kind), _ROUTED), "routed")
    answers = []
    if len(centres):
        inside = routed.filter("home >= 0")
        total = inside.groupBy("home").agg(F.sum("m").alias("_sum"), F.min("key").alias("_rep"), F.count("*").alias("_size"))
        total = stored(total.withColumnRenamed("home", "_home"), "clouds")  # a row per cloud
        own = inside.join(F.broadcast(total), F.col("home") == F.col("_home"))
        answers.append(own.select("key", (F.col("_sum") - F.col("m")).alias("links"), F.col("_rep").alias("root")))
        guests = routed.select("key", "m", "v", F.explode("visits").alias("cloud"))
        calls = stored(guests.groupBy("cloud").agg(F.count("*").alias("_calls")).withColumnRenamed("cloud", "_cloud"), "calls")
        both = F.broadcast(stored(total.join(calls, F.col("_home") == F.col("_cloud")).select("_home", "_size", "_calls"), "visited"))
        left = _blocks(inside.join(both, F.col("home") == F.col("_home")), F.col("_size"), "_block").withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_calls") / BLOCK).cast("int") - 1)))
        right = _blocks(guests.join(both, F.col("cloud") == F.col("_home")), F.col("_calls"), "_other").withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_size") / BLOCK).cast("int") - 1)))
        meet = left.select("key", "m", "v", F.lit(False).alias("guest"), F.col("home").alias("cloud"), "_block", "_other").unionByName(
            right.select("key", "m", "v", F.lit(True).alias("guest"), "cloud", "_block", "_other"))
        answers.append(meet.groupBy("cloud", "_block", "_other").applyInPandas(_in_cloud(threshold, kind), _FOUND))
    rest, large = _split_again(routed.filter("home < 0"), leaf, threshold, kind)
    visits = rest.select("key", "m", "v", "leaves", F.explode("leaves").alias("leaf"))
    if large is None:
        cells = visits.withColumn("part", F.lit(0)).withColumn("cell", F.lit(0).cast("bigint"))
    else:
        cells = _blocks(visits.join(large, F.col("leaf") == F.col("_node"), "left"), F.coalesce("size", F.lit(1)), "part")
        cells = cells.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_many") - 1))).withColumn(
            "cell", F.least("part", "_other").cast("bigint") * F.lit(1 << 31) + F.greatest("part", "_other"))
    answers.append(cells.select("key", "m", "v", "leaves", "leaf", "part", "cell").groupBy("leaf", "cell").applyInPandas(_in_leaf(threshold, kind), _FOUND))
    return answers
