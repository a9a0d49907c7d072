"""Registered queries of the operators and their SQL equivalents (DuckDB), where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bbit_minhash, bin_completion, block_whitening, chat_parts, cover_tree, hamming_index, language_id, merkle_slots, mixing, range_coder, tag_paths
from . import token_counts, toxic_segments


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(_table(spark, sf_dir, "embeddings"))


def op2_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.token_files(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract_pages(_table(spark, sf_dir, "pages"))


def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_products(_table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bbit_minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_merkle_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_slots.tamper_check(_table(spark, sf_dir, "documents"))


def op13_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_parts.format_and_read_back(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_hamming_index, op2_range_coder, op3_token_counts, op4_tag_paths, op5_bin_completion, op6_language_id,
                                   op7_cover_tree, op8_mixing, op9_bbit_minhash, op10_toxic_segments, op11_block_whitening,
                                   op12_merkle_slots, op13_chat_parts)}

_COVER_TREE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(length(text), 0) AS n FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / greatest(1 / (1 + abs(n / greatest(size, 1) - 6)), 1e-6) AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s0),
s2 AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS words, sum(w) OVER () AS weights,
    coalesce(sum(2 * source_size) OVER before, 0) AS cap_before, coalesce(sum(w) OVER before, 0) AS w_before,
    row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS nr
  FROM s1 WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (words - cap_before) / (weights - w_before) AS level FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, nr) FROM s3 WHERE cap / w > level) AS common FROM s3),
s5 AS (SELECT source, source_size, least(cap::DOUBLE, w * common) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s5),
p AS (
  SELECT k.doc_id, k.size, s6.source_size, s6.target, s6.epochs, s6.target - s6.epochs * s6.source_size AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN s6 ON k.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
  (least(epochs + CASE WHEN start + size / 2 < budget THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken FROM p"""

_MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id AND 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
  coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id"""

_MERKLE = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS flat,
    xor(4294967295::BIGINT, list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, b: list_reduce(range(8)::BIGINT[],
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END, xor(c::BIGINT, ascii(b)::BIGINT))::VARCHAR, '4294967295')::BIGINT) AS crc
  FROM documents),
h AS (
  SELECT doc_id, source, crc % 2 = 0 AS hit, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) AS bent FROM f),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
t AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS node FROM l
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
s AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, n, subroot AS node FROM s
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
b AS (
  SELECT l.doc_id, l.leaf, 0 AS part, t.lvl, t.pos < l.pos // (3 ** t.lvl)::BIGINT AS early, t.pos, t.node
  FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.pos // 3 = l.pos // (3 ** (t.lvl + 1))::BIGINT
    AND t.pos <> l.pos // (3 ** t.lvl)::BIGINT AND t.n > 1
  UNION ALL
  SELECT l.doc_id, l.leaf, 1, u.lvl, u.pos < s.pos // (3 ** u.lvl)::BIGINT, u.pos, u.node
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN u ON u.pos // 3 = s.pos // (3 ** (u.lvl + 1))::BIGINT
    AND u.pos <> s.pos // (3 ** u.lvl)::BIGINT AND u.n > 1),
k AS (
  SELECT l.doc_id, l.leaf, x.part, x.lvl FROM l JOIN (SELECT DISTINCT source, n, lvl, 0 AS part FROM t WHERE n > 1) x ON x.source IS NOT DISTINCT FROM l.source
  UNION ALL SELECT l.doc_id, l.leaf, 1, y.lvl FROM l, (SELECT DISTINCT lvl FROM u WHERE n > 1) y),
p AS (
  SELECT k.doc_id, k.leaf, k.part, k.lvl, coalesce(string_agg(node, '' ORDER BY pos) FILTER (early), '') AS before,
    coalesce(string_agg(node, '' ORDER BY pos) FILTER (NOT early), '') AS after
  FROM k LEFT JOIN b ON b.doc_id IS NOT DISTINCT FROM k.doc_id AND b.leaf = k.leaf AND b.part = k.part AND b.lvl = k.lvl
  GROUP BY k.doc_id, k.leaf, k.part, k.lvl),
q AS (
  SELECT doc_id, leaf, list(before || '|' || after ORDER BY part, lvl) AS steps, string_agg(before || after, '' ORDER BY part, lvl) AS proof
  FROM p GROUP BY doc_id, leaf),
r AS (SELECT node AS root FROM u WHERE n = 1),
v AS (
  SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    list_reduce(coalesce(q.steps, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)),
      CASE WHEN coalesce(l.hit, false) THEN l.bent ELSE l.leaf END) AS folded_root
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN r
    LEFT JOIN q ON q.doc_id IS NOT DISTINCT FROM l.doc_id AND q.leaf = l.leaf)
SELECT *, folded_root = root AS verified FROM v"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, regexp_replace(regexp_replace(text, '(\\*)(### |</turn>|<image:|<audio:|<document:)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS body,
    replace(replace(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), ':', '%3A'), '#', '%23'), '<', '%3C'), '\', '%5C') AS name
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(name) + 2 + length(body) + length('</turn>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLE_SQL = {"op7_cover_tree": _COVER_TREE, "op8_mixing": _MIXING, "op9_bbit_minhash": _MINHASH, "op12_merkle_slots": _MERKLE, "op13_chat_parts": _CHAT}
