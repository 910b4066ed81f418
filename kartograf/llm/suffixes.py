"""Repeated passages by suffix sorting: bytes under a string that also starts in an earlier document go.

A collection's Burrows-Wheeler transform cannot be built column by column over the whole corpus: the
longest document sets the number of rounds, and each round reads all that is there.  So it is built
where it can tell something, and in bounded parts:

0. Of equal texts only those of the smallest id are searched; the others repeat it whole.
1. Every string of ``LEAST`` bytes has an anchor, the 18-byte gram in it with the smallest hash, and
   equal strings have the same anchor at the same place.  Grams are counted over all documents;
   strings whose anchor no other document has are done with.
2. Consecutive strings of one anchor are one piece, 82 bytes at most.  Pieces are merged per block of
   documents and dealt out by anchor.  An anchor of very many different pieces is dealt out by its strings
   instead, so that what surrounds a common passage does not gather in one task; fewer, but more than
   a part, are met string by string in their task.
3. In each part the transform of all pieces is built column-wise: every round inserts one symbol of
   each piece and updates the transform and the common prefixes.  Runs of common prefixes of
   ``LEAST`` or more are equal strings; each gets the smallest document id that has it.  A piece
   whose anchor no other piece has, or none of whose strings has a hash that another piece has, is
   alone with its strings and needs no sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.llm.base import bucketed, dropped, hollow, solid, stored, typed

LEAST = 50  # bytes of a string
GRAM = 18  # bytes of an anchor
SPREAD = LEAST - GRAM + 1  # grams of a string
CHUNK = 60_000  # string starts of a chunk of a document: their places take 16 bits
BLOCK = 8_000_000  # bytes of a block
HOT = 64_000  # pieces (5 MB at most) from which on an anchor's strings are dealt out by themselves
PART = 4_000  # pieces whose transform is built together
SALTS = 32  # tasks that share the copies of a text, where they are joined
#: A table of ids of up to this many rows is sent to all executors; a larger one is joined.
MOST_BROADCAST_IDS = 1_000_000
_A, _B, _C, _D = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of up to ``CHUNK`` string starts: 48-bit hash of the anchor, first and last string start, 16 bits of what the piece says.

    Of equal grams the leftmost is the anchor, so it depends on the string alone.
    """
    n = len(data)
    if n < LEAST:
        none, at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        return none, at, at, none
    words = np.empty(n - 7, dtype=np.uint64)
    for k in range(8):
        words[k::8] = np.frombuffer(data, dtype="<u8", count=(n - k) // 8, offset=k)
    h = words[: n - 17] * _A + words[8 : n - 9] * _B + words[10:] * _C
    h = (h ^ (h >> np.uint64(29))) * _D
    v = ((h ^ (h >> np.uint64(32))) & ~np.uint64(0xFFFF)) | np.arange(n - 17, dtype=np.uint64)
    best, width = v, 1
    while width < SPREAD - 1:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: n - LEAST + 1], v[SPREAD - 1 :])
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], len(best)) - 1
    sums = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(h * _B))
    says = ((sums[last + SPREAD] - sums[first]) * _C) >> np.uint64(48)  # of all grams of the piece
    return best[first] >> np.uint64(16), first, last, says


# --- the transform ----------------------------------------------------------------------------------------


def collection_bwt(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transform (0 ends a piece, else byte + 1), common prefixes, and piece and length of all suffixes in order.

    Column-wise: round j inserts the suffixes of length j of all pieces at once.  The place of a new
    suffix is that of its first symbol among all symbols of the transform; its common prefix with a
    neighbour is one more than the least of those between the two symbols.
    """
    m = len(pieces)
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    symbol = np.uint8 if data.max(initial=0) < 255 else np.uint16  # of UTF-8, one byte: it is sorted in one pass
    data = data.astype(symbol) + symbol(1)
    ends = np.cumsum(lens)
    bwt = np.where(lens > 0, data[np.maximum(ends - 1, 0)], 0).astype(symbol) if len(data) else np.zeros(m, dtype=symbol)
    lcp, piece, size, place = np.zeros(m, dtype=np.uint8), np.arange(m, dtype=np.int32), np.zeros(m, dtype=np.uint8), np.arange(m)
    for j in range(1, int(lens.max(initial=0)) + 1):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        done = int((bwt == 0).sum())
        active = np.flatnonzero(lens >= j)
        active = active[np.argsort(place[active])]
        q = place[active]
        r = rank[q]
        new = np.zeros(n, dtype=bool)
        new[q] = True
        at = m - done + r
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
        has_before = (r > 0) & (bwt[before] == bwt[q])
        has_after = (r + 1 < n) & (bwt[after] == bwt[q]) & ~new[after]
        padded = np.append(lcp, 0).astype(np.uint8)
        common = np.zeros(len(active), dtype=np.uint8)
        if has_before.any():
            spans = np.stack([before[has_before] + 1, q[has_before] + 1], axis=1).ravel()
            common[has_before] = np.minimum.reduceat(padded, spans)[::2] + 1
        grown = n + len(active)
        old = np.ones(grown, dtype=bool)
        old[at] = False

        def extended(values, fresh):
            out = np.empty(grown, dtype=values.dtype)
            out[old] = values
            out[at] = fresh
            return out

        left = np.where(lens[active] > j, data[np.maximum(ends[active] - 1 - j, 0)], 0)
        fresh_lcp = extended(lcp, common)
        if has_after.any():
            spans = np.stack([q[has_after] + 1, after[has_after] + 1], axis=1).ravel()
            fresh_lcp[at[has_after] + 1] = np.minimum.reduceat(padded, spans)[::2] + 1
        bwt, lcp, piece, size = extended(bwt, left), fresh_lcp, extended(piece, active), extended(size, j)
        place[active] = at
    return bwt, lcp, piece, size


def earliest(pieces: list[bytes], docs: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Per piece and string of ``least`` bytes in it: the smallest document of any piece that has the string."""
    _, lcp, piece, size = collection_bwt(pieces)
    group = np.cumsum(lcp < least)
    long = size >= least
    piece, size, group = piece[long], size[long].astype(np.int64), group[long]
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    counts = np.maximum(lens - least + 1, 0)
    base = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    if len(group):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        smallest = np.minimum.reduceat(docs[piece], starts)
        out[base[piece] + lens[piece] - size] = np.repeat(smallest, np.diff(np.append(starts, len(group))))
    return np.split(out, np.cumsum(counts)[:-1])


# --- Spark ------------------------------------------------------------------------------------------------

_DOC = "kind string, uid bigint, id bigint, n_bytes bigint, sha string, n_chunks int, block bigint, blob binary, uids array<bigint>, ids array<bigint>, chunks array<int>, chunk_counts array<int>, lens array<int>"
_DOC_COLUMNS = [f.split()[0] for f in _DOC.split(", ")]


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _blocks(chunk: int, block: int):
    """Documents, and compressed blocks of their chunks; both carry the block's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, number, count = TaskContext.get().partitionId(), 0, 0
        parts, meta, docs, size = [], [], [], 0

        def flush():
            lists = [[m[i] for m in meta] for i in range(5)]
            at = (pid << 24) + number
            rows = [*((*d, at, *(None,) * 6) for d in docs), ("block", None, None, None, None, None, at, _packed(b"".join(parts)), *lists)]
            return typed(rows, _DOC_COLUMNS, {"uid", "id", "n_bytes", "n_chunks", "block"})

        for batch in batches:
            for doc, text, sha, n in zip(batch["id"].tolist(), batch["text"], batch["sha"], batch["n"].tolist()):
                copy = text is None  # of an earlier document
                data = b"" if copy else bytes(text)
                uid, count = (pid << 36) + count, count + 1
                chunks = 0 if copy else max(1, -(-max(0, len(data) - LEAST + 1) // chunk))
                docs.append(("doc", uid, doc, n, sha, chunks))
                for c in range(chunks if len(data) >= LEAST else 0):
                    part = data[c * chunk : (c + 1) * chunk + LEAST - 1]
                    parts.append(part)
                    meta.append((uid, doc, c, chunks, len(part)))
                    size += len(part)
                    if size >= block:
                        yield flush()
                        parts, meta, docs, size, number = [], [], [], 0, number + 1
                if len(docs) >= 100_000:
                    yield flush()
                    parts, meta, docs, size, number = [], [], [], 0, number + 1
        if docs or parts:
            yield flush()

    return run


def _parts(blob: bytes, lens) -> Iterator[bytes]:
    data, at = _unpacked(blob), 0
    for n in lens:
        yield data[at : at + n]
        at += n


def _sharded(values: np.ndarray, hashes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = ((hashes * _A) >> np.uint64(40)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(at)).tolist():
        yield s, values[order[at[s] : at[s + 1]]]


def _six(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each, byte by byte: first all lowest bytes, last all highest."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def _counted(shards: int):
    """(shard, block, data, counts): each anchor of a block, and the numbers of its documents and of its different pieces that have it.

    Documents count up to 255, pieces up to 65,535; of pieces the low bytes come first, then the high ones.
    """

    def run(batches):
        for batch in batches:
            for block, blob, lens in zip(batch["block"], batch["blob"], batch["lens"]):
                none, found = np.empty(0, np.uint64), [anchors(p) for p in _parts(blob, lens)]
                hashes, counts = np.unique(np.concatenate([*(np.unique(f[0]) for f in found), none]), return_counts=True)
                pieces = np.unique(np.concatenate([*((f[0] << np.uint64(16)) | f[3] for f in found), none])) >> np.uint64(16)
                pieces = np.minimum(np.unique(pieces, return_counts=True)[1], 65_535)
                counts = np.stack([np.minimum(counts, 255), pieces & 255, pieces >> 8]).astype(np.uint8)
                rows = [(s, block, _six(hashes[at]), counts[:, at].tobytes()) for s, at in _sharded(np.arange(len(hashes)), hashes, shards)]
                yield pd.DataFrame(rows, columns=["shard", "block", "data", "counts"])

    return run


def _shared(hot: int):
    """Per block: its anchors that more than one document has; the lowest bit marks the hot ones.

    A passage that is the same in all documents is one piece in each block and merges; what makes an
    anchor hot is different pieces in a block (more than ``hot`` besides the first of each), or that
    more than ``hot`` blocks have it.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entries = [_from_six(d) for d in frame["data"]]
        whole = np.concatenate(entries)
        _, inverse = np.unique(whole, return_inverse=True)
        counts = np.concatenate([np.frombuffer(c, dtype=np.uint8).reshape(3, -1) for c in frame["counts"]], axis=1).astype(np.float64)
        summed = lambda values: np.bincount(inverse, weights=values)[inverse]
        total, others, blocks = summed(counts[0]), summed(counts[1] + 256 * counts[2] - 1), summed(np.ones(len(whole)))
        marked = (whole << np.uint64(1)) | ((others > hot) | (blocks > hot)).astype(np.uint64)
        ends = np.cumsum([len(e) for e in entries])[:-1]
        found = [v[t > 1].tobytes() for v, t in zip(np.split(marked, ends), np.split(total, ends))]
        return pd.DataFrame({"block": frame["block"], "data": found})

    return run


#: Pieces of a block that one shard gets, and where they occur; numbers and bodies are packed.
_CUT = "shard int, block bigint, keys binary, meta binary, data binary, occurs binary"
_CUT_COLUMNS = [f.split()[0] for f in _CUT.split(", ")]
_WHOLE = {1: "<u1", 4: "<i4", 8: "<i8"}


def _planes(*columns: tuple[np.ndarray, int]) -> bytes:
    """Whole numbers of 1, 4 or 8 bytes, packed byte by byte: of each column first all lowest bytes, last all highest."""
    flat = [np.ascontiguousarray(v.astype(_WHOLE[width])).view(np.uint8).reshape(-1, width).T.tobytes() for v, width in columns]
    return _packed(b"".join(flat))


def _from_planes(packed: bytes, *widths: int) -> list[np.ndarray]:
    data, at, out = np.frombuffer(_unpacked(packed), dtype=np.uint8), 0, []
    n = len(data) // sum(widths)
    for width in widths:
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(_WHOLE[width]).ravel())
        at += n * width
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small where values ascend; their running sum is the values."""
    return np.diff(values, prepend=0)


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their shard, and where each shard begins."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _pieces(shards: int):
    """Distinct pieces of each block by shard, and where they occur: number of the piece in the row, of the chunk in its block, first string start."""

    def run(batches):
        for batch in batches:
            for block, blob, ids, lens, known in zip(*(batch[c] for c in ("block", "blob", "ids", "lens", "known"))):
                marked = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in known] + [np.empty(0, np.uint64)])
                marked.sort()
                shared, hot = marked >> np.uint64(1), (marked & np.uint64(1)).astype(bool)
                seen: dict[bytes, int] = {}
                keys, docs, numbers, places, starts, rows = [], [], [], [], [], []
                for k, part in enumerate(_parts(blob, lens)):
                    h, first, last, _ = anchors(part)
                    at = np.searchsorted(shared, h) if len(shared) else np.zeros(len(h), dtype=np.int64)
                    hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == h) if len(shared) else np.zeros(len(h), dtype=bool)
                    doc, hit = int(ids[k]), np.flatnonzero(hit)
                    for a, b, key, strings in zip(first[hit].tolist(), last[hit].tolist(), h[hit].tolist(), hot[at[hit]].tolist()):
                        for s, e in [(s, s + LEAST) for s in range(a, b + 1)] if strings else [(a, b + LEAST)]:
                            body = part[s:e]
                            number = seen.get(body)
                            if number is None:
                                number = seen[body] = len(docs)
                                keys.append(int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little") if strings else key)
                                docs.append(doc)
                            elif doc < docs[number]:
                                docs[number] = doc
                            numbers.append(number)
                            places.append(k)
                            starts.append(s)
                if docs:
                    bodies, keys, docs = list(seen), np.array(keys, dtype=np.uint64), np.array(docs, dtype=np.int64)
                    numbers, places, starts = (np.array(v, dtype=np.int64) for v in (numbers, places, starts))
                    shard = (((keys * _A) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
                    order, begins = _dealt(shard, shards)
                    within = np.empty(len(order), dtype=np.int64)
                    within[order] = np.arange(len(order)) - begins[shard[order]]
                    found, founds = _dealt(shard[numbers], shards)
                    for s in np.flatnonzero(np.diff(begins)).tolist():
                        own, at = order[begins[s] : begins[s + 1]], found[founds[s] : founds[s + 1]]
                        cut = [bodies[i] for i in own.tolist()]
                        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
                        rows.append((s, block, keys[own].astype(np.uint32).tobytes(), _planes((_steps(docs[own]), 8), (sizes, 1)), _packed(b"".join(cut)),
                                     _planes((_steps(within[numbers[at]]), 4), (_steps(places[at]), 4), (starts[at], 4))))
                yield pd.DataFrame(rows, columns=_CUT_COLUMNS)

    return run


def _meeting(bodies: list[bytes]) -> np.ndarray:
    """Whether a piece has a string that another piece of the list has, by 64-bit hashes: all such pieces, and hardly any other."""
    lens = np.array([len(b) for b in bodies], dtype=np.int64)
    counts, data = lens - LEAST + 1, b"".join(bodies)
    piece = np.repeat(np.arange(len(bodies)), counts)
    starts = np.arange(len(piece)) + np.repeat(np.cumsum(lens) - lens - np.cumsum(counts) + counts, counts)
    words = np.empty(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        words[k::8] = np.frombuffer(data, dtype="<u8", count=(len(data) - k) // 8, offset=k)
    h = np.zeros(len(starts), dtype=np.uint64)
    for k in (*range(0, LEAST - 8, 8), LEAST - 8):
        h = (h ^ words[starts + k]) * _A
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    h, piece, out = h[order], piece[order], np.zeros(len(bodies), dtype=bool)
    met = (h[1:] == h[:-1]) & (piece[1:] != piece[:-1])  # pieces ascend among equal hashes
    out[piece[1:][met]] = out[piece[:-1][met]] = True
    return out


def _by_strings(pieces: list[bytes], docs: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """What ``earliest`` gives, string by string: its time grows with the strings only, however many pieces share an anchor."""
    seen: dict[bytes, int] = {}
    own = [[seen.setdefault(p[s : s + least], len(seen)) for s in range(len(p) - least + 1)] for p in pieces]
    counts = [len(o) for o in own]
    every = np.array([k for o in own for k in o], dtype=np.int64)
    smallest = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(smallest, every, np.repeat(docs, counts))
    return np.split(smallest[every], np.cumsum(counts)[:-1])


def _sorted_strings(part: int):
    """A shard's pieces, equal ones merged, in parts of whole anchors; back come runs of strings with their earliest document, and the places.

    Only pieces that can share a string with another piece are sorted: strings of the others have one document.
    Where more than ``part`` such pieces have one anchor, their strings are met one by one.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        of, metas = [], []
        for data, meta in zip(frame["data"], frame["meta"]):
            steps, sizes = _from_planes(meta, 8, 1)
            body, ends = _unpacked(data), np.cumsum(sizes, dtype=np.int64)
            of.append(np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip((ends - sizes).tolist(), ends.tolist())], dtype=np.int64))
            metas.append(np.cumsum(steps))
        bodies, every = list(seen), np.concatenate(of)
        docs = np.full(len(bodies), np.iinfo(np.int64).max)
        np.minimum.at(docs, every, np.concatenate(metas))
        keys = np.empty(len(bodies), dtype=np.uint32)
        keys[every] = np.concatenate([np.frombuffer(k, dtype=np.uint32) for k in frame["keys"]])
        order = np.argsort(keys, kind="stable")
        lone = np.ones(len(order), dtype=bool)
        lone[1:] &= keys[order[1:]] != keys[order[:-1]]
        lone[:-1] &= keys[order[1:]] != keys[order[:-1]]
        order = order[~lone]  # no other piece has the anchor of the others, so none has a string of them
        if len(order):
            order = order[_meeting([bodies[k] for k in order.tolist()])]
        # one run a piece, but for those that are sorted
        plain = np.ones(len(bodies), dtype=bool)
        plain[order] = False
        plain = np.flatnonzero(plain)
        lens = np.array([len(b) for b in bodies], dtype=np.int64)
        found = [(plain, np.zeros(len(plain), dtype=np.int64), lens[plain] - LEAST, docs[plain])]
        own_keys, start = keys[order], 0
        while start < len(order):
            end = min(start + part, len(order))
            while end < len(order) and own_keys[end] == own_keys[end - 1]:
                end += 1
            own = order[start:end]
            cut = [bodies[k] for k in own.tolist()]
            values = earliest(cut, docs[own]) if len(own) <= part else _by_strings(cut, docs[own])
            counts = lens[own] - LEAST + 1
            piece, at, values = np.repeat(own, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts), np.concatenate(values)
            first = np.flatnonzero((at == 0) | np.concatenate([[True], values[1:] != values[:-1]]))
            found.append((piece[first], at[first], at[np.append(first[1:], len(at)) - 1], values[first]))
            start = end
        piece, first, last, doc = (np.concatenate(v) for v in zip(*found))
        by = np.argsort(piece, kind="stable")
        first, last, doc = first[by], last[by], doc[by]
        begins = np.searchsorted(piece[by], np.arange(len(bodies) + 1))
        answers = []
        for own, places in zip(of, frame["occurs"]):
            number, at = _spread(begins[own], begins[own + 1])
            runs = _planes((_steps(number), 4), (first[at], 1), (last[at], 1), (_steps(doc[at]), 8))
            answers.append(len(runs).to_bytes(4, "little") + runs + places)
        return pd.DataFrame({"block": frame["block"], "answer": answers})

    return run


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of each range from low to high, and which range each is of."""
    count = high - low
    return np.repeat(np.arange(len(low)), count), np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)


def _removed(chunk: int):
    """Byte ranges that an earlier document has, from the answers to a block: documents of one chunk are finished, others give each chunk's
    text (all will be needed if one loses anything) and spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob, uids, ids, chunks, many, lens, answers in zip(*(batch[c] for c in ("blob", "uids", "ids", "chunks", "chunk_counts", "lens", "answers"))):
                ids, chunks, lens = (np.asarray(v, dtype=np.int64) for v in (ids, chunks, lens))
                parts, ranges = [np.empty(0, dtype=np.int64)], [np.empty((0, 2), dtype=np.int64)]
                for answer in answers if answers is not None else ():
                    at = 4 + int.from_bytes(answer[:4], "little")
                    number, first, last, doc = _from_planes(answer[4:at], 4, 1, 1, 8)
                    of, place, start = _from_planes(answer[at:], 4, 4, 4)
                    number, doc, of, place = (np.cumsum(v, dtype=np.int64) for v in (number, doc, of, place))
                    which, run = _spread(np.searchsorted(number, of), np.searchsorted(number, of, side="right"))
                    part = place[which]
                    gone = doc[run] < ids[part]
                    part, run, start = part[gone], run[gone], start[which][gone].astype(np.int64)
                    start += chunks[part] * chunk
                    parts.append(part)
                    ranges.append(np.stack([start + first[run], start + last[run] + LEAST], axis=1))
                part, spans = np.concatenate(parts), np.concatenate(ranges)
                order = np.argsort(part, kind="stable")
                part, spans = part[order], spans[order]
                begins = np.searchsorted(part, np.arange(len(ids) + 1))
                body, ends, rows = _unpacked(blob), np.cumsum(lens), []
                for k, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                    if many[k] > 1:
                        end = ends[k] if chunks[k] == many[k] - 1 else ends[k] - LEAST + 1
                        rows.append((int(uids[k]), int(chunks[k]), spans[a:b].tobytes() if b > a else None, _packed(body[ends[k] - lens[k] : end]), None, None, None, None))
                    elif b > a:
                        rows.append((int(uids[k]), None, None, None, *_cut_out(body[ends[k] - lens[k] : ends[k]], spans[a:b])))
                yield typed(rows, ["uid", "chunk", "spans", "text", "n_removed", "n_spans", "sha", "removed"], {"chunk", "n_removed", "n_spans"})

    return run


def _cut_out(data: bytes, spans: np.ndarray) -> tuple[int, int, str, list[int]]:
    """Bytes removed, runs, digest of the rest, and the runs."""
    gone, digest, last = merged(spans), hashlib.sha256(), 0
    for a, b in gone.tolist():
        digest.update(data[last:a])
        last = b
    digest.update(data[last:])
    return int((gone[:, 1] - gone[:, 0]).sum()), len(gone), digest.hexdigest(), gone.ravel().tolist()


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching ranges, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uid, texts, spans in zip(batch["uid"], batch["texts"], batch["spans"]):
            data = b"".join(_unpacked(t) for t in texts)
            rows.append((uid, *_cut_out(data, np.concatenate([np.frombuffer(s, dtype=np.int64).reshape(-1, 2) for s in spans]))))
        yield pd.DataFrame(rows, columns=["uid", "n_removed", "n_spans", "sha", "removed"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK, hot: int = HOT,
                      part: int = PART) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, removed), one row per input row.

    A byte of a text goes if a string of ``LEAST`` bytes over it also starts in a document with a
    smaller id; ``removed`` lists starts and ends of the maximal runs.  Texts are UTF-8 bytes as they
    are given, NULL is empty; repeated rows have one id and take nothing from each other; a NULL id
    counts as the smallest.  Texts shorter than a string stay whole.  Other columns are not read.
    """
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(solid(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("sha", F.sha2("text", 256))
    # of equal texts only those of the smallest id are searched: the others lose all their strings to it
    digests = stored(rows.select("id", "sha"), "digests")
    copied = stored(digests.groupBy("sha").agg(F.min("id").alias("_first"), F.count("*").alias("m")).filter("m > 1").select(
        F.col("sha").alias("_sha"), "_first"), "copies")
    same = (F.col("sha") == F.col("_sha")) & (F.col("id") > F.col("_first"))
    if copied.count() <= MOST_BROADCAST_IDS:
        found = digests.join(F.broadcast(copied), same)
    else:  # a text of very many copies meets its row in several tasks
        salt = F.pmod(F.col("id"), F.lit(SALTS))
        found = digests.withColumn("_salt", salt).join(
            copied.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_at")))
    later = stored(found.select(F.col("id").alias("_id"), F.col("sha").alias("_sha")).distinct(), "later")
    dropped(digests, copied)
    marked = F.broadcast(later) if later.count() <= MOST_BROADCAST_IDS else later
    rows = rows.join(marked, (F.col("id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select(
        "id", F.when(F.col("_id").isNull(), F.col("text")).alias("text"), "sha", F.length("text").cast("bigint").alias("n"))
    # blocks lie in buckets of their number: what is found for them goes to them
    first = bucketed(rows.mapInPandas(_blocks(chunk, block), _DOC), "block", "blocks")
    dropped(later)
    known = first.filter("kind = 'doc'").select("uid", "id", "n_bytes", "sha", (F.col("n_chunks") == 0).alias("copy"))
    blocks = first.filter("kind = 'block'").select("block", "blob", "uids", "ids", "chunks", "chunk_counts", "lens")
    counted = blocks.select("block", "blob", "lens").mapInPandas(_counted(shards), "shard int, block bigint, data binary, counts binary")
    answers = counted.groupBy("shard").applyInPandas(_shared(hot), "block bigint, data binary").groupBy("block").agg(F.collect_list("data").alias("known"))
    answers = answers.withColumnRenamed("block", "_block")
    cut = blocks.hint("merge").join(answers, F.col("block") == F.col("_block")).select("block", "blob", "ids", "lens", "known").mapInPandas(_pieces(shards), _CUT)
    runs = cut.groupBy("shard").applyInPandas(_sorted_strings(part), "block bigint, answer binary")
    runs = runs.groupBy("block").agg(F.collect_list("answer").alias("answers")).withColumnRenamed("block", "_block")
    result = "uid bigint, n_removed bigint, n_spans bigint, sha string, removed array<bigint>"
    # blocks without an answer as well: a chunk that loses nothing may be of a text that does
    found = blocks.hint("merge").join(runs, F.col("block") == F.col("_block"), "left").drop("block", "_block").mapInPandas(
        _removed(chunk), result.replace("uid bigint,", "uid bigint, chunk int, spans binary, text binary,"))
    found = stored(found, "spans")
    texts = found.filter("text IS NOT NULL").groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("t"), F.collect_list("spans").alias("spans"))
    long = texts.filter(F.size("spans") > 0).select("uid", F.col("t.text").alias("texts"), "spans").mapInPandas(_kept, result)
    changed = found.filter("text IS NULL").drop("chunk", "spans", "text").unionByName(long).select(
        F.col("uid").alias("_uid"), "n_removed", "n_spans", F.col("sha").alias("_sha"), "removed")
    gone = F.col("copy") & (F.col("n_bytes") >= LEAST)
    return known.join(changed, F.col("uid") == F.col("_uid"), "left").select(
        hollow().alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
        F.when(gone, F.array(F.lit(0).cast("bigint"), F.col("n_bytes"))).otherwise(F.col("removed")).alias("removed"))
