"""Near copies, manifest and clusters against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.llm import forest, manifest, vantage
from tests.llm.conftest import CLASHES, odd_rows, ordered

VECTORS = "vec_id bigint, embedding array<float>, label int"


def clashing(df):
    return df.withColumns({c: F.lit(-1) for c in [*CLASHES, "v", "m", "q", "a", "leaf", "leaves", "home", "cluster", "distance", "first_id", "links", "size"] if c not in df.columns})


def frame(spark, rows, schema=VECTORS):
    return clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], schema).repartition(3))


def close(rng, base, cosine):
    """A vector at just this cosine from ``base``."""
    other = rng.standard_normal(len(base))
    other -= (other @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def units(rng, n, dim=64):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, threshold=0.9):
    """(id, links, component, kept) by all pairs."""
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for dim in {len(rows[k][1]) for k in fine}:
        own = [k for k in fine if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= threshold).tolist():
            if a != b:
                links[own[a]].add(own[b])
    low = lambda i: -(1 << 63) if i is None else i
    out = [None] * len(rows)
    for k in range(len(rows)):
        if out[k] is None:
            part, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - part
                part |= new
                todo += new
            least = min((rows[j][0] for j in part), key=low)
            for j in part:
                out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return out


def told(df):
    return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()]


def odd_vectors():
    rng = np.random.default_rng(5)
    base = units(rng, 6)
    rows = [(100 + i, v.tolist()) for i, v in enumerate(units(rng, 60))]
    rows += [(200 + i, (close(rng, base[0], 0.99) * (i + 1)).tolist()) for i in range(70)]  # a cloud, at any length
    rows += [(300 + i, close(rng, base[1], 0.955).tolist()) for i in range(12)]
    rows += [(400, base[2].tolist())] * 3 + [(401, base[2].tolist()), (None, close(rng, base[2], 0.95).tolist()), (None, base[2].tolist())]
    chain = [base[3]]
    for i in range(8):
        chain.append(close(rng, chain[-1], 0.92))
    rows += [(90 - i, v.tolist()) for i, v in enumerate(chain)]
    rows += [(1, None), (2, []), (3, [0.0] * 64), (4, [None] + [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [float("inf")] + [1.0] * 63), (None, None),
             (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [-1.0, -2.0]), (10, [1e30] + [1e-30] * 63), (11, [1e-38] + [0.0] * 63), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    return rows


def test_links_and_components_of_odd_vectors(ready):
    rows = odd_vectors()
    assert ordered(told(forest.near_vectors(frame(ready, rows)))) == ordered(brute(rows))
    assert forest.near_vectors(frame(ready, rows).filter("false")).count() == 0
    assert told(forest.near_vectors(frame(ready, [(1, None), (None, [])]))) and forest.near_vectors(frame(ready, [(3, None)])).first()["kept"]


def test_double_vectors(ready):
    rows = [(1, [1.0, 1e-9]), (2, [1.0, 2e-9]), (3, [0.0, 1.0])]
    assert ordered(told(forest.near_vectors(frame(ready, rows, VECTORS.replace("float", "double"))))) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    x, out = units(rng, n), []
    for v in x:
        out += [v] + [close(rng, v, c) for c in rng.uniform(0.9, 0.999, rng.integers(0, 3))]
    return [(i, v.tolist()) for i, v in enumerate(out)]


@pytest.mark.parametrize("trees, least", [(1, 0.3), (16, 0.97)])
def test_recall_by_splits_in_several_rounds(ready, monkeypatch, trees, least):
    """Small leaves and samples, so that leaves are split again and again; pairs lie at 0.9 to 0.999."""
    for name, value in (("SAMPLE", 300), ("NODE_SAMPLE", 100), ("LEAST", 8), ("CROWD", 10_000)):
        monkeypatch.setattr(forest, name, value)
    rows = clustered(3, 1_200)
    want, got = {w[0]: w for w in brute(rows)}, told(forest.near_vectors(frame(ready, rows), trees=trees, leaf=40))
    assert len(got) == len(rows) and all(g[1] <= want[g[0]][1] for g in got)
    assert sum(g[1] for g in got) >= least * sum(w[1] for w in want.values())


def test_leaves_that_do_not_split_and_clouds_are_compared_in_blocks(ready, monkeypatch):
    rng = np.random.default_rng(9)
    base = units(rng, 3)
    rows = [close(rng, base[0], 0.97) for _ in range(160)] + [close(rng, base[1], 0.999) for _ in range(150)] + [close(rng, base[1], 0.86) for _ in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate([*rows, *units(rng, 50)])]
    monkeypatch.setattr(forest, "BLOCK", 37)
    assert ordered(told(forest.near_vectors(frame(ready, rows), leaf=20))) == ordered(brute(rows))
    monkeypatch.setattr(forest, "CROWD", 10_000)  # no clouds: dense nodes stay whole
    got, want = told(forest.near_vectors(frame(ready, rows), leaf=20)), brute(rows)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def test_clouds_lie_within_reach():
    rng = np.random.default_rng(2)
    base = units(rng, 2)
    sample = np.array([close(rng, base[0], 0.99) for _ in range(40)] + [close(rng, base[1], 0.99) for _ in range(20)] + list(units(rng, 50)))
    centres = forest.clouds(sample, np.cos(np.arccos(0.9) / 2))
    assert len(centres) == 2 and centres[0] @ base[0] > 0.99 and centres[1] @ base[1] > 0.99


# --- manifest -----------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Root, and per leaf what flanks it level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            proofs[k].append((nodes[run:i], nodes[i + 1 : run + 3]))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], proofs


def plain_manifest(rows):
    trees = {}
    for r in rows:
        text = r[4] and r[4].replace("\n", "") if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        trees.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], text))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: plain_tree([x[1] for x in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s, own in trees.items()}
    root, above = plain_tree([made[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for (d, own, later), path in zip(sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), made[s][1]):
            node = later
            for left, right in path + top:
                node = sha(*left, node, *right)
            out.append((d, own, made[s][0], root, sha(*[x for left, right in path + top for x in left + right]), node, node == root))
    return ordered(out)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proved(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return ordered(tuple(r[c] for c in PROOF) for r in manifest.manifest(df, tampered={"text": text}).collect())


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_manifest_of_odd_documents(ready, monkeypatch, depth):
    monkeypatch.setattr(manifest, "DEPTH", depth)
    sources = [None, "", "é", "z", "a", "🙂", "hot", "hot", "hot", "-"]
    rows = [(d, sources[(i * 7) % 10], None if i % 4 else "en", None if i % 5 == 0 else i, t) for i, (d, t) in enumerate(odd_rows())]
    rows += [(1000 + i, "hot", "de", i, f"line {i}\nnext\n" if i % 3 else "no breaks") for i in range(100)] + [(1000, "hot", "de", 0, "no breaks")] * 2
    df = clashing(ready.createDataFrame(rows, DOCS).repartition(4))
    assert proved(df) == plain_manifest(rows)
    assert manifest.manifest(df.filter("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 243, 244])
def test_manifest_of_full_and_open_runs(ready, n):
    rows = [(i, "s", "en", i, f"text\n{i}") for i in range(n)]
    assert proved(ready.createDataFrame(rows, DOCS)) == plain_manifest(rows)


def test_proofs_lead_to_the_root(ready):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(50)]
    out = manifest.manifest(ready.createDataFrame(rows, DOCS)).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] and set(map(len, r["proof"])) <= {64, 128} for r in out)


# --- clusters -----------------------------------------------------------------------------------------------


def plain_clusters(rows, k=40, rounds=5, dim=64):
    kept = [(i, tuple(int(np.floor(256 * x)) for x in np.array(v, dtype=np.float32).astype(float))) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((p for p in kept if p[0] is not None), key=lambda p: (sha(f"2:{p[0]}"), p[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if members:
                centres[j] = tuple(sum(x) // len(members) for x in zip(*members))
    own, text = assign(), [",".join(map(str, c)) for c in centres]
    return ordered((i, c, d, sum(e for e, b in own if b == c), sum(e for e, _ in own), sha(text[c])) for (i, _), (d, c) in zip(kept, own))


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_of_odd_vectors(ready):
    rows = [r for r in odd_vectors() if r[0] != 10] + [(500 + i, [float(i % 3)] * 64) for i in range(12)]  # ties
    got = ordered(tuple(r[c] for c in CLUSTER) for r in vantage.exact_clusters(frame(ready, rows)).collect())
    assert got == plain_clusters(rows)
    few = rows[:7]
    got = ordered(tuple(r[c] for c in CLUSTER) for r in vantage.exact_clusters(frame(ready, few)).collect())
    assert got == plain_clusters(few)
    assert vantage.exact_clusters(frame(ready, rows).filter("false")).count() == 0
    assert vantage.exact_clusters(frame(ready, [(1, None)])).count() == 0


def test_components_too_large_for_exact_distances_are_refused(ready):
    with pytest.raises(Exception, match="no exact distance"):
        vantage.exact_clusters(frame(ready, [(1, [1e30] * 64)])).count()


def test_tree_search_is_that_of_all_centroids():
    rng = np.random.default_rng(0)
    for scale in (2, 200, 1 << 24):
        c, x = rng.integers(-scale, scale, (40, 5)), rng.integers(-scale, scale, (3_000, 5))
        c[7] = c[31]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own, squared = vantage.VantageTree(c).nearest(x)
        assert (own == d.argmin(axis=1)).all() and (squared == d.min(axis=1)).all()


def test_tree_search_leaves_out_what_cannot_be_nearer(monkeypatch):
    """On separate clusters most leaves stay closed."""
    rng = np.random.default_rng(1)
    c = np.repeat(rng.integers(-10_000, 10_000, (8, 4)), 8, axis=0) + rng.integers(-20, 20, (64, 4))
    tree, opened = vantage.VantageTree(c), []
    x = c[rng.integers(0, 64, 100)] + rng.integers(-5, 5, (100, 4))
    monkeypatch.setattr(tree, "nodes", [(k, Watched(w, opened), *r) if k == "leaf" else (k, w, *r) for k, w, *r in tree.nodes])
    for row in x:
        tree.nearest(row[None])
    leaves = sum(kind == "leaf" for kind, *_ in tree.nodes)
    assert leaves > 8 and len(opened) < len(x) * leaves / 3


class Watched:
    def __init__(self, numbers, opened):
        self.numbers, self.opened = numbers, opened

    def tolist(self):
        self.opened.append(self.numbers)
        return self.numbers.tolist()
