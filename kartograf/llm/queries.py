"""The registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartograf.llm import exact_dedup, forest, jaccard, manifest, packing, pieces, pii, prefixes, quality, revisits, suffixes, urls, vantage
from kartograf.llm.base import prepared, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepared(spark), sf_dir)

        ready.__name__, ready.__doc__ = name, run.__doc__
        QUERIES[name] = (ready, sql)
        return run

    return add


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)""")
def op1(spark, d):
    """Exact copies of all documents."""
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _glob_sql(glob: str) -> str:
    """DuckDB's GLOB differs on brackets only, which the patterns do not use."""
    return f"(host || path) GLOB '{glob}'"


_PATHS = ",\n".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.PATH_RULES)
_GLOBS = " ".join(f"WHEN {_glob_sql(g)} THEN '{v}:{g}'" for v, g in sorted(urls.GLOB_RULES, key=lambda x: (-len(x[1]), x[1])))


@query("op5_url_filters", rf"""WITH cut AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)(/[^?#]*)?', 1) AS h,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)(/[^?#]*)?', 2) AS path FROM pages),
pg AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, row_number() OVER () AS n FROM cut),
rules(verdict, rh, rp) AS (VALUES {_PATHS}),
best AS (SELECT n, verdict, rh || rp AS rule FROM pg JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, rh || rp) = 1),
other AS (SELECT n, CASE {_GLOBS} END AS g FROM pg)
SELECT page_id, host, path, rule, coalesce(best.verdict, split_part(g, ':', 1), 'allow') AS verdict,
  CASE WHEN rule IS NULL THEN substr(g, strpos(g, ':') + 1) END AS pattern FROM pg JOIN other USING (n) LEFT JOIN best USING (n)""")
def op5(spark, d):
    """All pages by address."""
    return urls.judge_urls(table(spark, d, "pages"), urls.rule_table(spark))


def sha(text):
    return F.sha2(text, 256)


@query("op2_sentencepiece")
def op2(spark, d):
    """All documents encoded, and the digest of what each chunk's pieces decode to."""
    v = pieces.load_vocabulary()
    decoded = pieces.decode_pieces(pieces.encode_pieces(table(spark, d, "documents"), v), v)
    return decoded.select("doc_id", "chunk", "n_chunks", F.size("ids").alias("n_pieces"), "ids", sha(F.col("text")).alias("decoded_sha256"))


@query("op3_suffix_dedup")
def op3(spark, d):
    """Passages that all documents repeat from earlier ones."""
    return suffixes.repeated_passages(table(spark, d, "documents")).drop("removed")


@query("op4_pii")
def op4(spark, d):
    """Personal data in all documents."""
    return pii.personal_data(table(spark, d, "documents"))


@query("op6_quality_classifier")
def op6(spark, d):
    """All documents against a model of those labelled good."""
    return quality.judge_quality(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("op7_best_fit_packing")
def op7(spark, d):
    """All documents, by words, in sequences of 512 to 8,192."""
    return packing.pack_documents(table(spark, d, "documents"))


@query("op8_document_fingerprints")
def op8(spark, d):
    """Fingerprints of all documents and of their edited texts."""
    return prefixes.fingerprints(table(spark, d, "documents"))


_HEADERS = """'{"content-length":"' || n || '","content-type":"' || kind_of || '","date":"' || moment || '"' || CASE WHEN tag IS NULL THEN '' ELSE ',"etag":"\\"' || tag || '\\""' END || ',"expires":"' || (moment + 60) || '"}'"""


@query("op9_warc_revisits", rf"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN page_id % 3 <> 0 THEN md5(coalesce(html, '')) END AS tag,
  CASE WHEN page_id % 5 <> 0 THEN 'day ' || length(coalesce(html, '')) END AS lm FROM pages),
rec AS (SELECT page_id * 3 AS record_id, 'response' AS kind, url, page_id * 60 AS date, tag, lm, sha256(html) AS sha, length(html) AS n, 'text/html' AS ct FROM p
  UNION ALL SELECT page_id * 3 + 1, 'revisit', regexp_replace(url, '^https?://', 'HTTP://') || '#again', page_id * 60 + 2400000, tag, lm, NULL, 0, 'none' FROM p
  UNION ALL SELECT page_id * 3 + 2, 'revisit', url, page_id * 60 - 60, tag, lm, NULL, 0, 'none' FROM p),
bare AS (SELECT *, regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '(?s)^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM rec),
cut AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '(?s)^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '(?s)^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g') AS rest FROM bare),
c AS (SELECT *, host || regexp_replace(rest, '[/?&]+$', '') AS canonical FROM cut),
seen AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(id := record_id, tag := tag, lm := lm, sha := sha, n := n) END IGNORE NULLS) OVER (
  PARTITION BY canonical ORDER BY date, CASE WHEN kind = 'response' THEN 1 ELSE 0 END, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
s AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN b.id IS NULL THEN 'missing'
  WHEN tag IS NOT NULL AND b.tag IS NOT NULL THEN CASE WHEN tag = b.tag THEN 'resolved' ELSE 'mismatch' END
  WHEN lm IS NOT NULL AND b.lm IS NOT NULL THEN CASE WHEN lm = b.lm THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS state FROM seen),
h AS (SELECT *, state IN ('resolved', 'unverified') AS taken FROM s),
m AS (SELECT record_id, kind, canonical, date, CASE WHEN kind <> 'response' THEN b.id END AS base_id, state, CASE WHEN taken THEN b.sha ELSE sha END AS payload_digest,
  CASE WHEN taken THEN b.n ELSE n END AS n, CASE WHEN taken THEN 'text/html' ELSE ct END AS kind_of, date AS moment, CASE WHEN taken THEN coalesce(tag, b.tag) ELSE tag END AS tag FROM h)
SELECT record_id, kind, canonical, date, base_id, state, {_HEADERS} AS headers, payload_digest FROM m""")
def op9(spark, d):
    """Three records of every page, resolved."""
    return revisits.resolve_revisits(revisits.page_records(table(spark, d, "pages")))


@query("op10_ngram_jaccard_join")
def op10(spark, d):
    """Groups of near copies among all documents."""
    return jaccard.near_components(table(spark, d, "documents")).drop("text_hash")


@query("op11_embedding_near_dedup", """WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings),
fine AS (SELECT * FROM v WHERE len(q) > 0 AND len(list_filter(q, lambda x: x IS NOT NULL AND isfinite(x))) = len(q) AND len(list_filter(q, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.n AS i, b.n AS j, b.vec_id FROM fine a JOIN fine b ON a.n <> b.n AND len(a.q) = len(b.q)
  WHERE list_dot_product(a.q, b.q) / sqrt(list_dot_product(a.q, a.q)) / sqrt(list_dot_product(b.q, b.q)) >= 0.9),
reach AS (SELECT n, n AS r, vec_id FROM v UNION SELECT reach.n, j, links.vec_id FROM reach JOIN links ON links.i = reach.r),
own AS (SELECT n, min(vec_id) AS component_id FROM reach GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM links WHERE i = v.n) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN own USING (n)""")
def op11(spark, d):
    """Near copies among all vectors."""
    return forest.near_vectors(table(spark, d, "embeddings"))


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(d[i]) AS BIGINT))), lambda c, b:
  list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))"""


def _tree(name: str, leaves: str) -> str:
    """All nodes (tree, level, i, h) over the numbered leaves, and of each node the others of its run."""
    return f"""{name} AS (SELECT tree, 0 AS level, i, h FROM {leaves} UNION ALL SELECT tree, any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, i // 3),
{name}_top AS (SELECT tree, max(level) AS top, arg_max(h, level) AS h FROM {name} GROUP BY tree),
{name}_run AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON b.tree = a.tree AND b.level = a.level AND b.i // 3 = a.i // 3 JOIN {name}_top t ON t.tree = a.tree WHERE a.level < t.top GROUP BY 1, 2, 3)"""


@query("op12_merkle_manifest", f"""WITH RECURSIVE docs AS (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents),
lf AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS later FROM docs),
own AS (SELECT *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM lf),
{_tree('low', 'own')},
tops AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS name FROM low_top),
{_tree('high', 'tops')},
way AS (SELECT o.tree, o.i, r.level, r.l, r.r FROM own o JOIN low_run r ON r.tree = o.tree AND r.i = o.i // CAST(3 ** r.level AS BIGINT)
  UNION ALL SELECT o.tree, o.i, 1000 + r.level, r.l, r.r FROM own o JOIN tops t ON t.name = o.tree JOIN high_run r ON r.i = t.i // CAST(3 ** r.level AS BIGINT)),
steps AS (SELECT tree, i, l, r, row_number() OVER (PARTITION BY tree, i ORDER BY level) AS k FROM way),
proofs AS (SELECT tree, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY 1, 2),
walk AS (SELECT tree, i, 0 AS k, later AS h FROM own UNION ALL SELECT w.tree, w.i, s.k, sha256(s.l || w.h || s.r) FROM walk w JOIN steps s ON s.tree = w.tree AND s.i = w.i AND s.k = w.k + 1),
ends AS (SELECT tree, i, arg_max(h, k) AS folded_root FROM walk GROUP BY 1, 2)
SELECT o.doc_id, o.leaf, t.h AS subroot, (SELECT h FROM high_top) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = (SELECT h FROM high_top) AS verified FROM own o JOIN low_top t ON t.tree = o.tree JOIN ends e ON e.tree = o.tree AND e.i = o.i LEFT JOIN proofs p ON p.tree = o.tree AND p.i = o.i""")
def op12(spark, d):
    """Proofs of all documents; every other one, by its checksum, is found later without its line ends."""
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.manifest(table(spark, d, "documents"), tampered={"text": found}).drop("proof")


def _nearest(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (SELECT n, vec_id, q, c, d FROM (SELECT n, vec_id, v.q, c, list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - m.q[j]) * (v.q[j] - m.q[j]))) AS d
  FROM kept v, c{k} m) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)"""


def _moved(k: int) -> str:
    return f"""c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{k} o LEFT JOIN (SELECT c, list((s - (s % m + m) % m) // m ORDER BY j) AS q FROM
  (SELECT c, j, sum(q[j]) AS s, count(*) AS m FROM a{k}, range(1, 65) r(j) GROUP BY c, j) GROUP BY c) m ON m.c = o.c)"""


_ROUNDS_SQL = ",\n".join(f"{_nearest(k)}, {_moved(k)}" for k in range(vantage.ROUNDS))


@query("op13_centroid_clustering", f"""WITH kept AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {vantage.CENTROIDS}),
{_ROUNDS_SQL}, {_nearest(vantage.ROUNDS)},
f AS (SELECT vec_id, c, d, sum(d) OVER (PARTITION BY c) AS own, sum(d) OVER () AS everything FROM a{vantage.ROUNDS})
SELECT vec_id, CAST(f.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST(everything AS BIGINT) AS inertia,
  sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM f JOIN c{vantage.ROUNDS} m ON m.c = f.c""")
def op13(spark, d):
    """All vectors in 40 clusters."""
    return vantage.exact_clusters(table(spark, d, "embeddings"))
