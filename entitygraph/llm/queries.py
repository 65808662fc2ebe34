"""The registered queries of this subpackage and, where SQL can express the
result, their DuckDB text.  Every query reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, language, manifest, mixing, near_dups, neighbours, packing, quality_model, quality_rules,
               sharding, token_store, vector_codes, vector_dups)
from .common import table


def op1_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read_back(spark, table(spark, sf_dir, "documents"),
                                            tokenizer=packing.tokenizer_path("byte_bpe_50k.json"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_pairwise_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents")).drop("host_rejected")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_pointer_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bin_completion": op1_bin_completion,
    "op2_token_store": op2_token_store,
    "op3_snapshot_collapse": op3_snapshot_collapse,
    "op4_pairwise_additive": op4_pairwise_additive,
    "op5_nn_descent": op5_nn_descent,
    "op6_histogram_sort": op6_histogram_sort,
    "op7_ftrl_language": op7_ftrl_language,
    "op8_setsketch": op8_setsketch,
    "op9_host_rules": op9_host_rules,
    "op10_systematic_mix": op10_systematic_mix,
    "op11_pointer_proofs": op11_pointer_proofs,
    "op12_resident_lloyd": op12_resident_lloyd,
    "op13_p_stable": op13_p_stable,
}

WORD = r"[^\x20\x09-\x0D]+"


def _told_sql(text: str) -> str:
    """The fields of a leaf written one after another."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)


def _lloyd_sql(rounds: int = 6) -> str:
    """Integer product codes with unrolled rounds: x(r, j, i, x) are components
    (row, part, position), c0, c1, ... the codebooks (part, entry, position)."""
    steps = ["""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, 8 * i // len(q) AS j, i, q[i + 1] AS x FROM (SELECT r, q, unnest(range(len(q))) AS i FROM v)),
c0 AS MATERIALIZED (SELECT r AS e, j, i, x AS c FROM x WHERE r < 16)"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, j, min({{'d': d, 'e': e}}) AS b FROM (SELECT r, x.j, e, sum((x - c) * (x - c)) AS d
      FROM x JOIN c{k} c ON x.j = c.j AND x.i = c.i GROUP BY ALL) GROUP BY r, j)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (SELECT c.e, c.j, c.i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} c LEFT JOIN
      (SELECT b.e AS e, x.j, x.i, sum(x) AS s, count(*) AS n FROM x JOIN a{k} a ON x.r = a.r AND x.j = a.j GROUP BY ALL) m
      ON m.e = c.e AND m.j = c.j AND m.i = c.i)""")
    return ",".join(steps) + f""",
g AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY j) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j, e, i)) FROM c{rounds}) AS codebooks_sha256
FROM g JOIN v USING (r)"""


ORACLE: dict[str, str] = {
    "op3_snapshot_collapse": """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
h AS (SELECT conv_id, p, n, md5(CAST(list({'r': role, 'x': text}) OVER (PARTITION BY conv_id ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR)) AS k FROM t),
m AS (SELECT min(conv_id) AS conv_id FROM h WHERE p = n AND k NOT IN (SELECT k FROM h WHERE p < n) GROUP BY k)
SELECT conv_id, CAST((p - 1) // 256 AS INTEGER) AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY p) AS rendered
FROM t JOIN m USING (conv_id) GROUP BY 1, 2""",
    "op9_host_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, regexp_extract_all(t, '{WORD}') AS w,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
f AS (SELECT m.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, word_chars, n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS x FROM b WHERE source <> '' GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(x) / sum(n) AS mu, sum(1.0 / n) AS inv, sum(x * x / n) AS sq FROM h),
v AS (SELECT *, greatest(0, sq - n * mu * mu) / n * k / greatest(k - 1, 1) AS between_hosts FROM s),
p AS (SELECT mu, CASE WHEN k < 2 OR between_hosts - mu * (1 - mu) * inv / k <= 0 THEN 1e6
        ELSE least(1e6, greatest(1, (mu * (1 - mu) - between_hosts) / (between_hosts - mu * (1 - mu) * inv / k))) END AS st FROM v),
bad AS (SELECT source FROM h, p WHERE (x + st * mu) / (n + st) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.source""",
    "op10_systematic_mix": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
z AS (SELECT cap / weight AS k, level FROM l WHERE cap >= level * weight ORDER BY 1, 2 LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap / weight < z.k THEN cap ELSE least(cap, z.level * weight) END AS target,
        ('0x' || substr(md5('mix|' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, z),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1)::DOUBLE AS pos FROM d)
SELECT doc_id, size, source_size, target,
  CAST(least(floor((pos + 1) * (target / source_size) + u) - floor(pos * (target / source_size) + u),
        ceil(target / source_size)) * size AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source""",
    "op11_pointer_proofs": f"""
WITH RECURSIVE f AS (SELECT *, CAST(doc_id AS VARCHAR) AS k, CASE WHEN text IS NOT NULL AND list_reduce(list_concat([4294967295],
        flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), {', '.join(['-1'] * 8)}]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) % 2 = 1
        THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, sha256({_told_sql('text')}) AS leaf, sha256({_told_sql('changed')}) AS tampered FROM f),
r AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up AS (SELECT tree, 0 AS h, pos, leaf AS x, count(*) OVER (PARTITION BY tree) AS n FROM r UNION ALL
  SELECT tree, h + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)), CAST(ceil(max(n) / 3) AS BIGINT) FROM up
  WHERE n > 1 GROUP BY tree, h, pos // 3),
over AS (SELECT 0 AS h, tree AS pos, x, count(*) OVER () AS n FROM up WHERE n = 1 UNION ALL
  SELECT h + 1, pos // 3, sha256(string_agg(x, '' ORDER BY pos)), CAST(ceil(max(n) / 3) AS BIGINT) FROM over WHERE n > 1 GROUP BY h, pos // 3),
sib AS MATERIALIZED (SELECT a.tree, a.h, a.pos, a.n, coalesce(string_agg(b.x, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.x, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM (SELECT tree, h, pos, x, n FROM up UNION ALL SELECT -1, h, pos, x, n FROM over) a
  JOIN (SELECT tree, h, pos, x FROM up UNION ALL SELECT -1, h, pos, x FROM over) b
  ON a.tree = b.tree AND a.h = b.h AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (SELECT tree AS t0, pos AS p0, tree, 0 AS h, pos, tampered AS x, '' AS proof FROM r UNION ALL
  SELECT t0, p0, CASE WHEN s.n IS NULL THEN -1 ELSE w.tree END, CASE WHEN s.n IS NULL THEN 0 ELSE w.h + 1 END,
    CASE WHEN s.n IS NULL THEN w.tree ELSE w.pos // 3 END, CASE WHEN s.n IS NULL THEN w.x ELSE sha256(s.l || w.x || s.r) END,
    CASE WHEN s.n IS NULL THEN proof ELSE proof || s.l || s.r END
  FROM walk w LEFT JOIN sib s ON w.tree = s.tree AND w.h = s.h AND w.pos = s.pos WHERE w.tree >= 0 OR s.n IS NOT NULL),
ended AS (SELECT t0, p0, arg_max(x, h) AS folded, arg_max(proof, h) AS proof FROM walk WHERE tree = -1 GROUP BY t0, p0)
SELECT doc_id, leaf, u.x AS subroot, o.x AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = o.x AS verified
FROM r JOIN ended ON r.tree = t0 AND r.pos = p0 JOIN (SELECT tree, x FROM up WHERE n = 1) u ON u.tree = r.tree,
  (SELECT x FROM over WHERE n = 1) o""",
    "op12_resident_lloyd": _lloyd_sql(),
    "op13_p_stable": """
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (SELECT * FROM e WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
      AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.x) = len(b.x)
      AND list_cosine_similarity(a.x, b.x) >= 0.95),
w AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
c AS (SELECT a, min(vec_id) AS least FROM w JOIN e ON e.r = w.b GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM e LEFT JOIN c ON c.a = e.r LEFT JOIN n ON n.a = e.r""",
}
