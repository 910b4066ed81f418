"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` keeps sums of ``(code + 1) * base**place`` modulo two primes, so the hash of any span
is a difference of two of them.  Spans are compared in constant time and common extensions are found
by binary search.  A fingerprint is the hash of the whole text and the smallest mixed hashes of its
8-character spans, so that fingerprints of like texts are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartograf.llm.base import hollow, solid, stored, typed

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353 % 2147483629)
SPAN, KEPT = 8, 64  # characters of a span, span hashes of a fingerprint
BLOCK = 1 << 20  # code points that are hashed at once: memory does not follow the text


class _Powers:
    """Powers of a base and of its inverse, extended by doubling."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime, self.inverse = base, prime, pow(base, -1, prime)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int):
        while len(self.up) < n:
            m, p = len(self.up), np.uint64(self.prime)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, self.prime)) % p])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, self.prime)) % p])


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHashes:
    """Prefix sums of a text of up to ``BLOCK`` + ``SPAN`` code points."""

    def __init__(self, points: np.ndarray):
        self.n, self.sums = len(points), []
        value = points.astype(np.uint64) + np.uint64(1)
        for powers in _POWERS:
            powers.reach(self.n + 1)
            p = np.uint64(powers.prime)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(value * powers.up[: self.n] % p, out=sums[1:])
            self.sums.append(sums % p)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of a span, the same wherever its characters stand."""
        return tuple((int(s[end]) - int(s[start])) % w.prime * int(w.down[start]) % w.prime for s, w in zip(self.sums, _POWERS))

    def windows(self, size: int) -> np.ndarray:
        """62-bit hashes of all spans of ``size`` characters."""
        out = []
        for s, w in zip(self.sums, _POWERS):
            p, count = np.uint64(w.prime), self.n - size + 1
            out.append((s[size:] + p - s[:count]) % p * w.down[:count] % p)
        return (out[0] << np.uint64(31)) | out[1]


def span_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Longest length at which the texts agree from ``i`` and ``j`` on, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if span_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two texts, a block at a time."""
    done = 0
    while done < min(len(a), len(b)):
        x, y = PrefixHashes(a[done : done + BLOCK]), PrefixHashes(b[done : done + BLOCK])
        found = common_extension(x, 0, y, 0)
        done += found
        if found < BLOCK:
            break
    return done


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(24)


def _smallest(values: np.ndarray, kept: int) -> np.ndarray:
    """The ``kept`` smallest distinct values, in order."""
    if len(values) > 4 * kept:
        few = np.unique(np.partition(values, 4 * kept)[: 4 * kept])
        if len(few) >= kept:
            return few[:kept]
    return np.unique(values)[:kept]


def fingerprint(points: np.ndarray) -> str:
    """``length.hash.span hashes`` in hexadecimal; texts shorter than a span are one span."""
    n, totals, best = len(points), [0, 0], np.empty(0, dtype=np.uint64)
    for start in range(0, n, BLOCK):
        sums = PrefixHashes(points[start : start + BLOCK + SPAN - 1])
        size = min(SPAN, n)
        if sums.n >= size:
            best = _smallest(np.concatenate([best, _smallest(_mixed(sums.windows(size)), KEPT)]), KEPT)
        own = sums.span(0, min(BLOCK, sums.n))
        totals = [(t + h * pow(w.base, start, w.prime)) % w.prime for t, h, w in zip(totals, own, _POWERS)]
    return f"{n:x}.{totals[0]:08x}{totals[1]:08x}." + "".join(f"{v:010x}" for v in best.tolist())


def likeness(a: str, b: str) -> float:
    """Share of equal span hashes among the smallest of both texts: 1 for equal texts, 0 to 1 else."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 10] for i in range(0, len(s), 10)} for s in (a.rpartition(".")[2], b.rpartition(".")[2]))
    union = sorted(x | y)[:KEPT]
    return sum(v in x and v in y for v in union) / len(union) if union else 0.0


def _row(text: str, after: str, after_mark: str, mark: str) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    points = codes(edited)
    other = fingerprint(points)
    return (n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, other, likeness(mark, other),
            likeness(mark, after_mark), common_prefix(codes(text), points))


_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
_TYPES = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one sorted partition; its first and last text go along for the neighbouring partitions."""
    pid, last = TaskContext.get().partitionId(), None
    columns = ["kind", "pid", "id", "text", *_COLUMNS]
    frame = lambda rows: typed(rows, columns, {"n_chars", "common_prefix"})
    none = (None,) * len(_COLUMNS)
    for batch in batches:
        rows = []
        for doc, text in zip(batch["id"], batch["text"]):
            mark = fingerprint(codes(text))
            if last is None:
                rows.append(("head", pid, doc, text, *none))
            else:
                rows.append(("row", pid, last[0], None, *_row(last[1], text, mark, last[2])))
            last = (doc, text, mark)
        yield frame(rows)
    if last is not None:
        yield frame([("tail", pid, last[0], last[1], *none)])


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, after in zip(batch["id"], batch["text"], batch["after"]):
            mark, other = fingerprint(codes(text)), fingerprint(codes(after))
            rows.append((doc, *_row(text, after, other, mark)))
        yield pd.DataFrame(rows, columns=["id", *_COLUMNS])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, and of each text with its later half replaced by the next document's beginning.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_prefix), one row per input row.  The next document is the next by id (rows of one id: by a hash of their text); after
    the last comes the first, and a single document follows itself.  NULL ids sort first, NULL texts
    are empty, repeated rows follow each other.  Empty texts are like empty texts only.  Texts travel
    once, into ranges of ids; the ends of ranges are joined through two rows per partition.  Other
    columns are not read.
    """
    rows = docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # bounds of ranges are drawn from ids and hashes, so no text reaches the driver
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    done = stored(ordered.select("id", "text").mapInPandas(_in_order, f"kind string, pid int, id bigint, text string, {_TYPES}"), "fingerprints")
    # one head and one tail per partition: their numbers, without texts, meet in one task
    numbered = done.filter("kind = 'head'").select("pid").withColumn("n", F.row_number().over(W.orderBy("pid")))
    count = numbered.count()
    tails = done.filter("kind = 'tail'").select("pid", "id", "text").join(numbered, "pid").withColumn("next", F.col("n") % F.lit(max(count, 1)) + 1)
    heads = done.filter("kind = 'head'").select("pid", F.col("text").alias("after")).join(numbered, "pid").select(F.col("n").alias("next"), "after")
    ends = tails.join(heads, "next").select("id", "text", "after").mapInPandas(_across, f"id bigint, {_TYPES}")
    inner = done.filter("kind = 'row'").select("id", *_COLUMNS)
    return inner.unionByName(ends).select(hollow().alias(id_col), *_COLUMNS)
