"""Similarity join of documents on word n-grams: prefix filters and a prefix tree.

1. A document is the set of 64-bit hashes of its word n-grams; equal sets are one node from then on.
2. Two linked sets share elements among the first of each set, in any global order.  In the order of
   hashes that is a cheap filter: a set goes on only if enough of its first elements occur in others.
3. Of these sets all elements are counted.  Elements that only one set has cannot be shared; the
   others, rarest first, are the global order, in which first elements are few and seldom common.
4. Sets that share a first element are connected; each connected part is joined by itself in a prefix
   tree, and what comes back are links that connect it, not all pairs.

All steps are exact: nothing that may link is left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored, typed
from kartograf.llm.connect import components

WORDS, PERCENT = 5, 80
BLOCK_ROWS, BLOCK_TOKENS = 65_000, 2_000_000  # rows and elements of a block in a task
CELL = 1_500  # sets of one prefix tree
#: A table of ids of up to this many rows is sent to all executors; a larger one is joined.
MOST_BROADCAST_IDS = 1_000_000
_A = 0x9E3779B97F4A7C15
_CACHED = 500_000


class _Words(dict):
    """Hashes of words, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, cache: _Words, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text in UTF-8; A-Z count as a-z.

    ``bytes.split`` cuts at the blank and U+0009 to U+000D.  Fewer words than ``size`` are one n-gram.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(w))
    total = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(_A) + w[k : len(w) - width + 1 + k]
    return np.unique(_mixed(total))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Elements that a set of ``n`` shares at least with any set it links to."""
    return -(-percent * n // 100)


def pair_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Elements that two linked sets of these sizes share at least."""
    return -(-percent * (n + m) // (100 + percent))


def spare(n: int) -> int:
    """Further first elements that the filter by hash looks at, and of which as many must be shared."""
    return max(1, n // 20)


def _key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _shards(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted hashes by shard, and where each shard begins in it."""
    shard = ((hashes * np.uint64(_A)) >> np.uint64(40)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


# --- step 2 -----------------------------------------------------------------------------------------------

_FIRST = "kind string, id bigint, h bigint, n bigint, key bigint, place bigint, c bigint, shard int, block bigint, data binary"
_FIRST_COLUMNS = [f.split()[0] for f in _FIRST.split(", ")]


def _first_pass(size: int, percent: int, shards: int):
    """Documents, and per block the first elements of its sets: 48 bits of hash and 16 of the set's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, pid, number = _Words(), TaskContext.get().partitionId(), 0
        docs, seen, heads, total = [], {}, [], 0

        def flush():
            block = (pid << 24) + number
            local = np.zeros(len(heads), dtype=np.int64)
            rows = []
            if heads:
                hashes = np.concatenate(heads) >> np.uint64(16)
                of = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
                order = np.argsort(hashes, kind="stable")
                hashes, of = hashes[order], of[order]
                starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                counts = np.diff(np.append(starts, len(hashes)))
                shared = np.repeat(counts > 1, counts)
                local = np.bincount(of[shared], minlength=len(heads))
                # an element of several sets here is known to be shared; one entry tells the other blocks
                entry = (hashes[starts] << np.uint64(16)) | np.where(counts > 1, 0xFFFF, of[starts]).astype(np.uint64)
                order, at = _shards(hashes[starts], shards)
                for s in np.flatnonzero(np.diff(at)).tolist():
                    rows.append(("heads", None, None, None, None, None, None, s, block, entry[order[at[s] : at[s + 1]]].tobytes()))
            first = set()
            for doc, h, n, key in docs:
                k = seen.get(key, -1)
                new = k >= 0 and k not in first
                first.add(k)
                rows.append(("doc", doc, h, n, key, (block << 16) + k if new else None, int(local[k]) if new else None, None, None, None))
            return typed(rows, _FIRST_COLUMNS, {"id", "h", "n", "key", "place", "c", "shard", "block"})

        for batch in batches:
            for doc, h, text in zip(batch["id"], batch["h"], batch["text"]):
                own = shingles(bytes(text), cache, size)
                n, key = len(own), _key(own)
                docs.append((doc, h, n, key))
                if n and key not in seen:
                    seen[key] = len(heads)
                    heads.append(own[: n - least_overlap(n, percent) + spare(n)])
                    total += len(heads[-1])
                if len(heads) >= BLOCK_ROWS or len(docs) >= 4 * BLOCK_ROWS or total >= BLOCK_TOKENS:
                    yield flush()
                    docs, seen, heads, total, number = [], {}, [], 0, number + 1
        if docs:
            yield flush()

    return run


def _shared_heads(frame: pd.DataFrame) -> pd.DataFrame:
    """Per set: how many of a shard's elements occur in other blocks, too."""
    entries = [np.frombuffer(d, dtype=np.uint64) for d in frame["data"]]
    block = np.repeat(frame["block"].to_numpy(dtype=np.int64), [len(e) for e in entries])
    entries = np.concatenate(entries)
    _, inverse, counts = np.unique(entries >> np.uint64(16), return_inverse=True, return_counts=True)
    of = (entries & np.uint64(0xFFFF)).astype(np.int64)
    hit = (counts[inverse] > 1) & (of != 0xFFFF)
    place, c = np.unique((block[hit] << 16) + of[hit], return_counts=True)
    return pd.DataFrame({"place": place, "c": c})


# --- step 3 -----------------------------------------------------------------------------------------------


def _set_blocks(size: int):
    """Sets of the documents that go on, many to a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, pid, number = _Words(), TaskContext.get().partitionId(), 0
        keys, sets, total = [], [], 0

        def frame():
            return pd.DataFrame({"block": [(pid << 24) + number], "keys": [np.array(keys, dtype=np.int64).tobytes()],
                                 "sizes": [np.array([len(s) for s in sets], dtype=np.int64).tobytes()], "data": [np.concatenate(sets).tobytes()]})

        for batch in batches:
            for text, key in zip(batch["text"], batch["key"]):
                own = shingles(bytes(text), cache, size)
                if _key(own) == key:  # rows may share an id
                    keys.append(key)
                    sets.append(own)
                    total += len(own)
                if total >= BLOCK_TOKENS:
                    yield frame()
                    keys, sets, total, number = [], [], 0, number + 1
        if keys:
            yield frame()

    return run


def _counted(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"]):
                hashes, counts = np.unique(np.frombuffer(data, dtype=np.uint64), return_counts=True)
                order, at = _shards(hashes, shards)
                used = np.flatnonzero(np.diff(at)).tolist()
                yield pd.DataFrame({"shard": used, "block": block, "data": [hashes[order[at[s] : at[s + 1]]].tobytes() for s in used],
                                    "counts": [counts[order[at[s] : at[s + 1]]].astype(np.uint32).tobytes() for s in used]})

    return run


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(d, dtype=np.uint64) for d in frame["data"]]
    counts = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in frame["counts"]])
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "df": [t.tobytes() for t in np.split(total, ends[:-1])]})


def _ordered(shards: int, percent: int):
    """Sets in the global order (rarest first), without what no other set has; sets that cannot link go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, sizes, data, numbers, dfs in zip(batch["keys"], batch["sizes"], batch["data"], batch["shards"], batch["dfs"]):
                hashes = np.frombuffer(data, dtype=np.uint64)
                unique, inverse = np.unique(hashes, return_inverse=True)
                order, at = _shards(unique, shards)
                df = np.empty(len(unique), dtype=np.int64)
                for s, d in zip(numbers, dfs):
                    df[order[at[s] : at[s + 1]]] = np.frombuffer(d, dtype=np.int64)
                df, start, rows = df[inverse], 0, []
                for key, n in zip(np.frombuffer(keys, dtype=np.int64).tolist(), np.frombuffer(sizes, dtype=np.int64).tolist()):
                    own, f = hashes[start : start + n], df[start : start + n]
                    start += n
                    first = n - least_overlap(n, percent) + 1 - int((f == 1).sum())
                    if first > 0:
                        common = own[f > 1][np.argsort(f[f > 1], kind="stable")]
                        rows.append((key, n, common[:first].view(np.int64), common.tobytes()))
                yield pd.DataFrame(rows, columns=["key", "n", "first", "tokens"])

    return run


# --- step 4 -----------------------------------------------------------------------------------------------


class _Node:
    """A run of elements that the sets below share."""

    __slots__ = ("run", "kids", "ends", "one", "low", "high", "deep")

    def __init__(self, run, ends, one, low, high, deep):
        self.run, self.kids, self.ends, self.one, self.low, self.high, self.deep = run, {}, ends, one, low, high, deep


class PrefixTree:
    """Sets in one order as a tree; ``join`` links a set to those in the tree and then adds it.

    Overlaps of shared beginnings are counted once.  A subtree is left out where its sizes cannot
    fit, where the elements left on either side cannot reach the least overlap, or where all its sets
    are already connected to the set that is looked up.
    """

    def __init__(self, percent: int = PERCENT):
        self.root, self.percent = _Node([], [], None, 1 << 60, 0, 0), percent
        self.parent: list[int] = []
        self.sizes: list[int] = []
        self.visited = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def unite(self, a: int, b: int):
        self.parent[self.find(a)] = self.find(b)

    def add(self, size: int) -> int:
        self.parent.append(len(self.parent))
        self.sizes.append(size)
        return len(self.parent) - 1

    def links(self, me: int, ranks: list[int]) -> list[int]:
        """One set of the tree for each connected part that ``me`` links to; they are connected now."""
        n, own, found = self.sizes[me], set(ranks), []
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if 100 * node.high < self.percent * n or 100 * n < self.percent * node.low:
                continue
            if node.one is not None and self.find(node.one) == self.find(me):
                continue
            self.visited += 1
            rest = len(ranks) - bisect_right(ranks, node.run[0] - 1) if node.run else len(ranks)
            if overlap + min(rest, node.deep) < pair_overlap(n, max(node.low, least_overlap(n, self.percent)), self.percent):
                continue
            overlap += len(own.intersection(node.run))
            for other in node.ends:
                if overlap >= pair_overlap(n, self.sizes[other], self.percent) and self.find(other) != self.find(me):
                    self.unite(other, me)
                    found.append(other)
            near = []
            for token, kid in node.kids.items():
                (near if token in own else stack).append((kid, overlap))
            stack += near
        return found

    def insert(self, me: int, ranks: list[int]):
        n, node, at = self.sizes[me], self.root, 0
        while True:
            if node.one is None:
                if node is self.root and not node.kids and not node.ends:
                    node.one = me
            elif self.find(node.one) != self.find(me):
                node.one = None
            node.low, node.high = min(node.low, n), max(node.high, n)
            node.deep = max(node.deep, len(ranks) - at)
            run, k = node.run, 0
            while k < len(run) and at + k < len(ranks) and run[k] == ranks[at + k]:
                k += 1
            if k < len(run):  # the set leaves within the run: what follows becomes a kid
                kid = _Node(run[k:], node.ends, None, node.low, node.high, node.deep - k)
                kid.kids = node.kids
                kid.one = self._below(kid)
                node.run, node.kids, node.ends = run[:k], {run[k]: kid}, []
            at += k
            if at == len(ranks):
                node.ends.append(me)
                return
            kid = node.kids.get(ranks[at])
            if kid is None:
                node.kids[ranks[at]] = _Node(ranks[at:], [me], me, n, n, len(ranks) - at)
                return
            node = kid

    def _below(self, node) -> int | None:
        """A set below if all sets below are known to be connected."""
        marks = [*node.ends, *[kid.one for kid in node.kids.values()]]
        if any(m is None for m in marks) or not marks:
            return None
        return marks[0] if len({self.find(m) for m in marks}) == 1 else None


def tree_links(keys: list[int], sizes: list[int], labels: list[int], sides: list[int], tokens: list[np.ndarray],
               percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what linked sets connect.  Sets of side 0 are in the tree, of side 1 are looked up, of side 2 both.

    Sets of one label count as connected from the start.  The most common elements come first in the
    tree, so that like sets share long runs.
    """
    if not keys:
        return []
    unique, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rank = np.empty(len(unique), dtype=np.int64)
    rank[np.lexsort((unique, -counts))] = np.arange(len(unique))
    ranks, at = rank[inverse], 0
    tree, rows, by_label, out = PrefixTree(percent), [], {}, []
    for size, label, side, own in zip(sizes, labels, sides, tokens):
        me = tree.add(int(size))
        tree.unite(me, by_label.setdefault(label, me))
        rows.append((me, side, np.sort(ranks[at : at + len(own)]).tolist()))
        at += len(own)
    rows.sort(key=lambda r: (r[1], r[2]))  # side 0 first; like sets follow each other
    for me, side, own in rows:
        if side:
            out += [(keys[me], keys[other]) for other in tree.links(me, own)]
        if side != 1:
            tree.insert(me, own)
    return out


def _joined(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("cell", sort=False):
            out += tree_links(part["key"].tolist(), part["n"].tolist(), part["label"].tolist(), part["side"].tolist(),
                              [np.frombuffer(t, dtype=np.uint64) for t in part["tokens"]], percent)
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return run


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """Links within each cell; rows are (bin, cell, side, key, label, n, tokens), and a bin is a task's share of small cells."""
    return stored(rows.groupBy("bin").applyInPandas(_joined(percent), "src bigint, dst bigint"), "links")


def set_links(sets: DataFrame, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """(src, dst): links that connect exactly the sets (key, n, first, tokens) that linked sets connect.

    Sets that share a first element form parts.  A part of up to ``cell`` sets is one prefix tree.  A
    larger one is joined in blocks in three rounds: each block by itself; one set for each of the
    connected groups found, in blocks; then whatever is not in the largest group against all blocks,
    so that sets of one group, a flood of near copies say, never meet again.
    """
    tokens = stored(sets.select("key", F.explode("first").alias("h")), "first")
    hubs = stored(tokens.groupBy("h").agg(F.min("key").alias("hub"), F.count("*").alias("m")).filter("m > 1").select(F.col("h").alias("_h"), "hub"), "hubs")
    edges = stored(tokens.join(hubs, F.col("h") == F.col("_h")).filter("key <> hub").select(F.col("key").alias("src"), F.col("hub").alias("dst")).distinct(), "edges")
    parts = components(edges).select(F.col("key").alias("_key"), F.col("label").alias("part"))
    sizes = stored(parts.groupBy("part").agg(F.count("*").alias("m")).withColumnRenamed("part", "_part"), "parts")
    rows = sets.dropDuplicates(["key"]).join(parts, F.col("key") == F.col("_key")).join(sizes, F.col("part") == F.col("_part"))
    rows = stored(rows.select("key", "n", "tokens", "part", "m"), "sets")
    bins = max(1, sizes.agg(F.sum("m")).first()[0] or 0) // cell + 1
    small = rows.filter(F.col("m") <= cell).select(F.pmod(F.xxhash64("part"), F.lit(bins)).cast("string").alias("bin"), F.col("part").cast("string").alias("cell"),
                                                   F.lit(2).alias("side"), "key", F.col("key").alias("label"), "n", "tokens")
    large = rows.filter(F.col("m") > cell)
    blocks = F.ceil(F.col("m") / cell).cast("int")

    def alone(df: DataFrame, of, label) -> DataFrame:
        name = F.concat_ws("-", F.lit("large"), F.col("part").cast("string"), F.pmod(F.xxhash64("key"), of).cast("string"))
        return df.select(name.alias("bin"), name.alias("cell"), F.lit(2).alias("side"), "key", label.alias("label"), "n", "tokens")

    links = _cells(small.unionByName(alone(large, blocks, F.col("key"))), percent)
    if large.isEmpty():
        return links
    keys = large.select("key")
    own = links.join(keys.withColumnRenamed("key", "src"), "src", "left_semi")

    def labelled() -> DataFrame:
        found = components(own).select(F.col("key").alias("_key"), F.col("label").alias("_label"))
        joined = large.join(found, F.col("key") == F.col("_key"), "left")
        return stored(joined.select(*large.columns, F.coalesce("_label", "key").alias("label")), "marked")

    marked = labelled()
    heads = marked.filter("key = label")
    count = heads.groupBy("part").agg(F.count("*").alias("heads")).withColumnRenamed("part", "_part")
    heads = heads.join(count, F.col("part") == F.col("_part"))
    own = stored(own.union(_cells(alone(heads, F.ceil(F.col("heads") / cell).cast("int"), F.col("label")), percent)), "links")
    marked = labelled()
    groups = marked.groupBy("part", "label").agg(F.count("*").alias("g"))
    main = groups.groupBy("part").agg(F.max(F.struct("g", "label")).alias("top"), F.sum("g").alias("all")).select(
        F.col("part").alias("_part"), F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.g")) / cell).cast("int").alias("others"))
    met = marked.join(main, F.col("part") == F.col("_part")).filter("others > 0")
    spot = lambda of: F.pmod(F.xxhash64("key"), of)
    every = F.sequence(F.lit(0), F.col("others") - 1)
    index = met.select("part", spot(blocks).cast("int").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), "key", "label", "n", "tokens")
    asked = met.filter("label <> main").select("part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), spot(F.col("others")).cast("int").alias("j"),
                                               F.lit(1).alias("side"), "key", "label", "n", "tokens")
    name = F.concat_ws("-", F.lit("cross"), *[F.col(c).cast("string") for c in ("part", "i", "j")])
    cross = index.unionByName(asked).select(name.alias("bin"), name.alias("cell"), "side", "key", "label", "n", "tokens")
    return links.union(own).union(_cells(cross, percent))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
                    cell: int = CELL) -> DataFrame:
    """(id_col, n_shingles, component_id, text_hash), one row per input row.

    Two documents link when their sets of distinct ``words``-word n-grams have a Jaccard similarity
    of ``percent`` or more; a document of fewer words is one n-gram.  ``component_id`` is the
    smallest id that links reach.  Documents without words (NULL, empty, blank) link to nothing and
    have no n-grams; repeated rows link to each other; NULL ids are passed over when the smallest is
    taken.  Further columns are not read.  n-grams are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    first = stored(rows.mapInPandas(_first_pass(words, percent, shards), _FIRST), "first")
    known = first.filter("kind = 'doc'").select("id", "h", "n", "key", "place", "c")
    heads = first.filter("kind = 'heads'").select("shard", "block", "data")
    elsewhere = heads.groupBy("shard").applyInPandas(_shared_heads, "place bigint, c bigint").groupBy("place").agg(F.sum("c").alias("_c")).withColumnRenamed("place", "_place")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 20))
    going = known.filter("place IS NOT NULL").join(elsewhere, F.col("place") == F.col("_place"), "left").filter(
        F.col("c") + F.coalesce("_c", F.lit(0)) >= least)
    going = stored(going.groupBy("key").agg(F.min(F.struct("id", "h")).alias("one")).select("key", F.col("one.id").alias("_id"), F.col("one.h").alias("_h")), "going")
    chosen = F.broadcast(going) if going.count() <= MOST_BROADCAST_IDS else going
    blocks = stored(rows.join(chosen, (F.col("h") == F.col("_h")) & (F.col("id") == F.col("_id"))).select("text", "key").mapInPandas(
        _set_blocks(words), "block bigint, keys binary, sizes binary, data binary"), "blocks")
    counted = blocks.select("block", "data").mapInPandas(_counted(shards), "shard int, block bigint, data binary, counts binary")
    answers = counted.groupBy("shard").applyInPandas(_summed, "block bigint, shard int, df binary").groupBy("block").agg(
        F.collect_list(F.struct("shard", "df")).alias("l"))
    answers = answers.select(F.col("block").alias("_block"), F.col("l.shard").alias("shards"), F.col("l.df").alias("dfs"))
    sets = stored(blocks.join(answers, F.col("block") == F.col("_block")).mapInPandas(
        _ordered(shards, percent), "key bigint, n bigint, first array<bigint>, tokens binary"), "ordered")
    links = set_links(sets, percent, cell)
    parts = components(links).select(F.col("key").alias("_key"), "label")
    smallest = known.filter("n > 0").groupBy("key").agg(F.min(hollow()).alias("smallest"), F.count("*").alias("m"))
    classes = stored(smallest.join(parts, F.col("key") == F.col("_key"), "left").select(
        "key", "m", "smallest", F.coalesce("label", "key").alias("label"), F.col("label").isNotNull().alias("far")), "classes")
    reached = classes.filter("far").groupBy("label").agg(F.min("smallest").alias("component")).withColumnRenamed("label", "_label")
    # classes of one document that link to nothing need no row: the document is its own component
    final = stored(classes.filter("far OR m > 1").join(reached, F.col("far") & (F.col("label") == F.col("_label")), "left").select(
        F.col("key").alias("_key"), F.coalesce("component", "smallest").alias("component")), "components")
    return known.join(final, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left").select(
        hollow().alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", hollow()).alias("component_id"), F.col("h").alias("text_hash"))
