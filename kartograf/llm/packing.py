"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000  # pieces that are packed together in one task


def words(text_col: str = "text") -> Column:
    """Words between white space."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def cost(capacity: int) -> float:
    """Relative cost of a sequence: linear layers, and attention that grows with the square."""
    return capacity + capacity * capacity / 65536


def pack_lengths(lengths: list[int], capacities=CAPACITIES, price=cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each piece, and the capacity of each bin.

    Pieces come from the longest to the shortest and go to the bin they fill best.  Where none has
    room, the permitted length is opened whose price per token is least, given what later pieces can
    still fill it with; its room then counts for all later pieces.  At the end every bin shrinks to
    the cheapest length that holds its contents.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    waiting, shortest = sum(lengths), min(lengths, default=0)

    def content(capacity: int, first: int, later: int) -> float:
        """Tokens that a new bin will hold: the rest stays empty where nothing is short enough for it."""
        return first if capacity - first < shortest else min(capacity - shortest / 2, first + later)

    bins, places, used, room = [0] * len(lengths), [0] * len(lengths), [], []
    free: dict[int, list[int]] = {}
    mask = 0  # bit r is set while a bin with room r is open
    for i in order:
        n = lengths[i]
        waiting -= n
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            at = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            at = len(used)
            size = min((c for c in capacities if c >= n), key=lambda c: (price(c) / content(c, n, waiting), c))
            used.append(0)
            room.append(size)
        bins[i], places[i] = at, used[at]
        used[at] += n
        r = room[at] - used[at]
        if r > 0:
            room_now = free.setdefault(r, [])
            if not room_now:
                mask |= 1 << r
            room_now.append(at)
    final = [min((c for c in capacities if c >= u), key=lambda c: (price(c), c)) for u in used]
    return bins, places, final


def _pack(capacities):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, places, final = pack_lengths(frame["length"].tolist(), capacities)
        shard = int(frame["shard"].iloc[0]) if len(frame) else 0
        return pd.DataFrame({"id": frame["id"], "piece": frame["piece"], "start": frame["start"], "length": frame["length"],
                             "bin_id": [f"{shard}-{b}" for b in bins], "capacity": [final[b] for b in bins], "place": places})

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
                   capacities=CAPACITIES) -> DataFrame:
    """(id_col, piece, start, length, bin_id, capacity, place): where each piece of each document goes.

    ``length`` counts a row's tokens (default: its words).  A document longer than the largest
    permitted length is cut into full sequences and a rest; full ones are bins of their own and the
    rests are packed in shards of about ``SHARD_PIECES`` by a hash of the whole row and its number, so
    no task sees more than a shard.  The number (partition and place in it) is written once with the
    length and tells repeated rows apart; which rows share a shard depends on how the input is split.
    Empty documents and NULL texts have one piece of length 0 without bin and
    with capacity 0.  Repeated rows are packed like any others; ties go by id, NULL first.  Columns
    besides id and text are not read unless ``length`` reads them.
    """
    largest = max(capacities)
    counted = docs.select(solid(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("number"),
                          (words(text_col) if length is None else length).cast("bigint").alias("n"))
    counted = stored(counted, "lengths")
    shards = max(1, -(-counted.filter("n > 0").count() // SHARD_PIECES))
    full, rest = F.floor(F.col("n") / largest).cast("bigint"), F.col("n") % largest
    whole = counted.filter(F.col("n") >= largest).select("id", "h", "number", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece")).select(
        "id", "piece", (F.col("piece") * largest).alias("start"), F.lit(largest).cast("bigint").alias("length"),
        F.concat_ws("-", F.lit("full"), F.coalesce(hollow().cast("string"), F.lit("")), F.hex("h"), F.hex("number"), F.col("piece")).alias("bin_id"),
        F.lit(largest).cast("int").alias("capacity"), F.lit(0).cast("bigint").alias("place"))
    parts = counted.filter(rest > 0).select("id", full.alias("piece"), (full * largest).alias("start"), rest.alias("length"),
                                            F.pmod(F.xxhash64("h", "number"), F.lit(shards)).alias("shard"))
    packed = parts.groupBy("shard").applyInPandas(
        _pack(tuple(capacities)), "id bigint, piece bigint, start bigint, length bigint, bin_id string, capacity int, place bigint")
    nothing = counted.filter("n = 0").select("id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"),
                                             F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("string").alias("bin_id"),
                                             F.lit(0).cast("int").alias("capacity"), F.lit(0).cast("bigint").alias("place"))
    out = packed.unionByName(whole).unionByName(nothing)
    return out.select(hollow().alias(id_col), *out.columns[1:])
