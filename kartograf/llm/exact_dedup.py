"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored

AVERAGE, LEAST, MOST = 2048, 512, 16384  # bytes of a chunk
_MIX = np.uint64(0x9E3779B97F4A7C15)


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_ends(data: bytes, average: int = AVERAGE, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks: after an 8-byte window whose hash has log2(average) leading zeros.

    The same bytes are cut at the same places wherever they stand, up to the first and last chunk.
    """
    n, shift = len(data), np.uint64(64 - (average - 1).bit_length())
    if n <= least:
        return [n] if n else []
    found = []
    for start in range(8):
        count = (n - start) // 8
        if count > 0:
            windows = np.frombuffer(data, dtype="<u8", count=count, offset=start)
            found.append(np.flatnonzero(((windows * _MIX) >> shift) == 0) * 8 + (start + 8))
    ends, last = [], 0
    for end in [*np.sort(np.concatenate(found)).tolist(), n]:
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least or (end == n and end > last):
            ends.append(end)
            last = end
    return ends


def _cut(key: Callable[[bytes], bytes], chunks: bool):
    """Rows of documents to recipes, or to their chunks with keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, shas, recipes, sizes = [], [], [], []
            keys, data, of, places = [], [], [], []
            for doc, text in zip(batch["id"], batch["text"]):
                low = bytes(text).lower()  # bytes.lower touches A-Z only
                ends = chunk_ends(low)
                parts = [low[a:b] for a, b in zip([0, *ends], ends)]
                own = [key(part) for part in parts]
                sha = hashlib.sha256(low).hexdigest()
                if chunks:
                    keys += own
                    data += parts
                    of += [(doc, sha)] * len(own)
                    places += range(len(own))
                ids.append(doc)
                shas.append(sha)
                recipes.append(b"".join(own))
                sizes.append(len(low))
            if chunks:
                yield pd.DataFrame({"id": [x for x, _ in of], "sha256": [x for _, x in of], "place": places,
                                    "key": keys, "chunk": data})
            else:
                yield pd.DataFrame({"id": ids, "sha256": shas, "recipe": recipes, "n_bytes": sizes})

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[bytes], bytes] = digest) -> DataFrame:
    """(id, sha256, recipe, ranks, n_bytes): a document as its list of verified chunk identifiers.

    Chunks travel once, combined before the shuffle, and only to see that one key never stands for
    different bytes.  A key that does is split by the rank of its bytes, and the documents that hold
    it get these ranks beside the keys; so lists are equal exactly when texts are.
    """
    rows = docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    plain = stored(rows.mapInPandas(_cut(key, False), "id bigint, sha256 string, recipe binary, n_bytes bigint"), "recipes")
    chunks = rows.mapInPandas(_cut(key, True), "id bigint, sha256 string, place int, key binary, chunk binary")
    pairs = chunks.select("key", "chunk").distinct()
    clashes = stored(pairs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "clashes")
    if clashes.isEmpty():
        return plain.withColumn("ranks", F.lit(b""))
    ranked = pairs.join(clashes, "key", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("chunk")))
    shared = chunks.join(clashes, "key", "left_semi").join(ranked, ["key", "chunk"])
    ranks = shared.select("id", "sha256", "place", "rank").distinct().groupBy("id", "sha256").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "rank"))), lambda x: F.concat_ws(":", x["place"], x["rank"])), ",")
        .cast("binary").alias("ranks"))
    ranks = ranks.withColumnRenamed("id", "_id").withColumnRenamed("sha256", "_sha")
    return stored(plain.join(ranks, (F.col("id") == F.col("_id")) & (F.col("sha256") == F.col("_sha")), "left")
                  .select(*plain.columns, F.coalesce("ranks", F.lit(b"")).alias("ranks")), "recipes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[bytes], bytes] = digest) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256, n_bytes), one row per input row.

    Texts are equal when their bytes are, after lower-casing A-Z; the row with the largest id of each
    group is kept.  NULL texts count as empty, all empty texts are one group; a repeated row is a
    member like any other, and all rows with the kept id are kept; NULL ids sort below all others.
    Other columns are not read.  Groups of copies are counted before the shuffle, and the result is
    joined back on lists that are read from files, so that Spark can split the list of a hot group.
    """
    rows = recipes(docs, id_col, text_col, key)
    groups = rows.groupBy("recipe", "ranks").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = stored(groups.withColumnsRenamed({"recipe": "_recipe", "ranks": "_ranks"}), "copies")
    joined = rows.join(groups, (F.col("recipe") == F.col("_recipe")) & (F.col("ranks") == F.col("_ranks")), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.withColumn("keep", keep).select(hollow().alias(id_col), hollow("keep").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                         (F.col("id") == F.col("keep")).alias("kept"), F.col("sha256").alias("text_sha256"), "n_bytes")
