"""Exact copies, near copies and repeated passages against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from kartograf.llm import connect, exact_dedup, jaccard, suffixes
from tests.llm.conftest import odd_rows, ordered


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    out = []
    for d, t in rows:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return ordered(out)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_chunks_are_bounded_and_follow_contents():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    ends = exact_dedup.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact_dedup.MOST and sizes[:-1].min() >= exact_dedup.LEAST
    moved = exact_dedup.chunk_ends(b"new beginning" + data)
    assert len({e - 13 for e in moved} & set(ends)) > len(ends) // 2
    assert exact_dedup.chunk_ends(b"") == [] and exact_dedup.chunk_ends(b"x") == [1]
    assert exact_dedup.chunk_ends(bytes(50_000))[-1] == 50_000


def test_exact_copies(odd, nothing):
    got = ordered(tuple(r[c] for c in COLUMNS) for r in exact_dedup.exact_duplicates(odd).collect())
    assert got == copies(odd_rows())
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_keys_that_clash_do_not_join_texts(odd):
    weak = exact_dedup.exact_duplicates(odd, key=lambda chunk: bytes([len(chunk) % 3]))
    assert ordered(tuple(r[c] for c in COLUMNS) for r in weak.collect()) == copies(odd_rows())


def near(rows, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    holders, parent = {}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return ordered((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def joined(df, **options):
    return ordered((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(df, **options).collect())


def test_near_copies(odd, nothing):
    assert joined(odd) == near(odd_rows())
    assert jaccard.near_components(nothing).count() == 0


@pytest.mark.parametrize("cell", [1500, 4])
def test_near_copies_in_floods(ready, cell):
    """Groups larger than a cell take the rounds over blocks."""
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(40)], []
    for _ in range(10):
        core = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 14)):
            text = list(core)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
    df = ready.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df, cell=cell) == near(rows)


def test_prefix_tree_equals_all_pairs():
    rng = random.Random(4)

    def groups(n, links):
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        found = {}
        for i in range(n):
            found.setdefault(find(i), []).append(i)
        return sorted(found.values())

    for _ in range(150):
        bases = [rng.sample(range(60), rng.randint(5, 30)) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 25)):
            own = set(rng.choice(bases))
            for _ in range(rng.randint(0, 5)):
                own ^= {rng.randint(0, 70)}
            sets.append(own or {1})
        n, arrays = len(sets), [np.array(sorted(s), dtype=np.uint64) for s in sets]
        linked = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        got = jaccard.tree_links(list(range(n)), [len(s) for s in sets], list(range(n)), [2] * n, arrays)
        assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in linked} and groups(n, got) == groups(n, linked)
        half = n // 2
        got = jaccard.tree_links(list(range(n)), [len(s) for s in sets], list(range(n)), [0] * half + [1] * (n - half), arrays)
        assert groups(n, got) == groups(n, [(i, j) for i, j in linked if (i >= half) != (j >= half)])


def test_a_flood_of_near_copies_is_not_compared_pair_by_pair():
    rng, n = random.Random(5), 300
    base = list(range(200))
    arrays = [np.array(sorted(set(base) - {rng.choice(base)}), dtype=np.uint64) for _ in range(n)]
    tree = jaccard.PrefixTree()
    for a in arrays:
        me = tree.add(len(a))
        tree.links(me, a.tolist())
        tree.insert(me, a.tolist())
    assert len({tree.find(i) for i in range(n)}) == 1 and tree.visited < 20 * n


@pytest.mark.parametrize("limit", [5, 1000])
def test_connected_parts(ready, monkeypatch, limit):
    monkeypatch.setattr(connect, "EDGES", limit)
    rng = random.Random(6)
    for edges in ([(i, i + 1) for i in range(40)] + [(99, 99)], [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]):
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = connect.components(ready.createDataFrame(edges, "src bigint, dst bigint").repartition(6)).collect()
        assert {r.key: r.label for r in got} == {x: find(x) for x in parent}


def passages(rows, least=50):
    first = {}
    key = lambda d: -1 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < key(d):
                gone[i : i + least] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return ordered(out)


def cleaned(df):
    return ordered(tuple(r)[:5] for r in suffixes.repeated_passages(df).collect())


def test_repeated_passages(odd, nothing):
    assert cleaned(odd) == passages(odd_rows())
    assert suffixes.repeated_passages(nothing).count() == 0


def test_passages_of_hot_anchors_and_of_long_texts(ready):
    rng = random.Random(7)
    pieces = ["".join(rng.choice("abcdefé ") for _ in range(rng.randint(40, 120))) for _ in range(5)]
    rows = []
    for d in range(50):
        parts = [rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 7))]
        rows.append((d * 3, "".join(parts)))
    rows += [(500, "a" * 300), (501, "a" * 130), (502, "b" * 49), (503, "".join(pieces) * 3)]
    df = ready.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = passages(rows)
    assert cleaned(df) == want
    # anchors of more than two documents go by strings, documents are cut into chunks, shards into parts
    assert ordered(tuple(r)[:5] for r in suffixes.repeated_passages(df, chunk=100, block=1500, hot=2, part=7).collect()) == want


def test_transform_and_common_prefixes():
    rng = random.Random(8)
    for trial in range(80):
        pieces = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        bwt, lcp, piece, size = suffixes.collection_bwt(pieces)
        want = sorted((p[len(p) - n :], i) for i, p in enumerate(pieces) for n in range(len(p) + 1))
        assert [(pieces[i][len(pieces[i]) - n :], i) for i, n in zip(piece.tolist(), size.tolist())] == want
        left = [pieces[i][len(pieces[i]) - len(s) - 1] + 1 if len(s) < len(pieces[i]) else 0 for s, i in want]
        assert bwt.tolist() == left
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(want, want[1:])]
        assert lcp.tolist() == [0, *common]


def test_only_pieces_that_share_a_string_are_sorted(monkeypatch):
    """Pieces that share an anchor by chance, and copies of one piece, are not built into a transform."""
    anchor, rng = b"an anchor of eighteen b", random.Random(9)
    noise = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    tail = noise(40)
    bodies = [noise(20) + anchor + noise(20) for _ in range(30)] + [noise(10) + anchor + tail, noise(12) + anchor + tail]
    assert suffixes._meeting(bodies).tolist() == [False] * 30 + [True] * 2
    sorted_ones = []
    earliest = suffixes.earliest
    monkeypatch.setattr(suffixes, "earliest", lambda pieces, docs: sorted_ones.append(pieces) or earliest(pieces, docs))
    docs = np.arange(100, 100 + len(bodies))[::-1]
    row = {"shard": 0, "keys": np.full(len(bodies), 7, dtype=np.uint32).tobytes(), "data": suffixes._packed(b"".join(bodies)),
           "meta": suffixes._planes((suffixes._steps(docs), 8), (np.array([len(b) for b in bodies]), 1)), "occurs": b"places"}
    frame = pd.DataFrame([{**row, "block": b} for b in range(2)])
    for part in (4, 1):  # more than ``part`` pieces of an anchor are met string by string
        found = suffixes._sorted_strings(part)(frame)
        assert sorted_ones == [bodies[30:]]
        assert found["block"].tolist() == [0, 1] and found["answer"][0] == found["answer"][1]
        answer = found["answer"][0]
        at = 4 + int.from_bytes(answer[:4], "little")
        number, first, last, doc = suffixes._from_planes(answer[4:at], 4, 1, 1, 8)
        got = {}
        for n, a, b, d in zip(np.cumsum(number).tolist(), first.tolist(), last.tolist(), np.cumsum(doc).tolist()):
            got.update({(n, s): d for s in range(a, b + 1)})
        want = {(n, s): min(int(e) for o, e in zip(bodies, docs) if body[s : s + 50] in o) for n, body in enumerate(bodies) for s in range(len(body) - 49)}
        assert got == want and answer[at:] == b"places"


def test_pieces_are_not_written(ready, monkeypatch):
    """Pieces go from the blocks to the shards; the folder that all share gets no copy of them."""
    names, stored = [], suffixes.stored
    monkeypatch.setattr(suffixes, "stored", lambda df, name: names.append(name) or stored(df, name))
    text = "a passage of more than fifty bytes that comes in two documents, whole"
    df = ready.createDataFrame([(1, "x" + text), (2, "y" + text), (3, "z")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.repeated_passages(df).collect()} == {1: 0, 2: len(text), 3: 0}
    assert sorted(names) == ["copies", "digests", "later", "spans"]


def test_few_thousand_pieces_are_not_dealt_out_by_strings():
    """What an anchor's strings are dealt out for is room in a task: 3,000 pieces of it have that."""
    text = b"".join(b"the same words stand at the head of every line %06d\n" % n for n in range(3_000))
    blocks = [(b, suffixes._packed(part), [len(part)]) for b, part in enumerate((text, text[: len(text) // 2]))]
    counted = pd.concat(list(suffixes._counted(1)(iter([pd.DataFrame(blocks, columns=["block", "blob", "lens"])]))))
    marked = np.concatenate([np.frombuffer(d, dtype=np.uint64) for d in suffixes._shared(suffixes.HOT)(counted)["data"]])
    assert len(marked) and not (marked & np.uint64(1)).any()


def test_different_pieces_make_an_anchor_hot():
    """One template line very often in few documents is hot; a passage that is one piece in every block is not."""
    line = lambda n: b"the same words stand at the head of every line %04d and something after them\n" % n
    often = b"".join(line(n) for n in range(300))
    copied = b"".join(hashlib.sha256(b"%d" % n).hexdigest().encode() for n in range(40))
    blocks = [[often, copied], [often[: len(often) // 2], copied]]
    frame = pd.DataFrame([{"block": b, "blob": suffixes._packed(b"".join(parts)), "lens": [len(p) for p in parts]} for b, parts in enumerate(blocks)])
    counted = pd.concat(list(suffixes._counted(1)(iter([frame]))))
    marked = np.concatenate([np.frombuffer(d, dtype=np.uint64) for d in suffixes._shared(100)(counted)["data"]])
    hot = set((marked[marked & np.uint64(1) == 1] >> np.uint64(1)).tolist())
    assert hot & set(suffixes.anchors(often)[0].tolist())
    assert not hot & set(suffixes.anchors(copied)[0].tolist())
