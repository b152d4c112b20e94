"""The queries op1 to op13 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.sharding import shard_by_bytes

    rows = shard_by_bytes(documents(spark, sf_dir), 40)
    return rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.quality import fit_quality, judge

    docs = documents(spark, sf_dir)
    return judge(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.licences import scan_licences

    return scan_licences(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.mixing import mix

    return mix(documents(spark, sf_dir), [3, 1, 2]).drop("source")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.wavelet import round_trip

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.minhash import fingerprint_with_edits

    return fingerprint_with_edits(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.toxicity import fit_toxicity, score_documents

    docs = documents(spark, sf_dir)
    return score_documents(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.suffixes import repeated_bytes

    return repeated_bytes(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.negatives import hard_negatives
    from framewright.llm.vectors import embeddings

    return hard_negatives(embeddings(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.codes import compress
    from framewright.llm.vectors import embeddings

    return compress(embeddings(spark, sf_dir))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.llm.circulant import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def queries() -> dict:
    named = (op1_sharding, op2_packing, op3_quality_rules, op4_licence_scans, op5_mixing, op6_simhash, op7_token_output, op8_fingerprints, op9_toxicity, op10_suffix_dedup, op11_hard_negatives, op12_vector_codes, op13_minhash)
    return {f.__name__: f for f in named}


_OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][k + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(min(CASE WHEN level <= cap / weight THEN level END) OVER (), cap / weight) * weight)::DOUBLE AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT *, round(target)::BIGINT - epochs * source_size AS budget FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - ahead)))::BIGINT AS taken
FROM (SELECT d.*, source_size, target, epochs, budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP11 = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.k, a.vec_id AS anchor_id, r.k AS other, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.k <> r.k WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id, other) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.k, p.other ORDER BY s.score DESC, s.id, s.other)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.k = s.k WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""


def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    square = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    sql = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT k, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM r, (SELECT unnest(range({parts}))::INTEGER AS part)),
b0 AS MATERIALIZED (SELECT part, (k - 1)::INTEGER AS entry, x AS c FROM p WHERE k <= {entries})"""
    for t in range(rounds + 1):
        sql += f""",
a{t} AS MATERIALIZED (SELECT k, p.part, min(struct_pack(d := {square}, entry := b.entry)) AS best FROM p JOIN b{t} b ON p.part = b.part GROUP BY k, p.part)"""
        if t < rounds:
            sql += f""",
u{t} AS (SELECT p.part, best.entry AS entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS i FROM a{t} JOIN p ON p.k = a{t}.k AND p.part = a{t}.part),
m{t} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM u{t} GROUP BY ALL),
c{t} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{t} GROUP BY ALL),
b{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(c{t}.c, b.c) AS c FROM b{t} b LEFT JOIN c{t} USING (part, entry))"""
    return sql + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
e AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} JOIN r USING (k) GROUP BY k, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, h
"""


_OP13 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS MATERIALIZED (SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM w),
g AS MATERIALIZED (SELECT s, min(doc_id) AS first, row_number() OVER () AS g FROM d WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT g, len(s) AS n, unnest(s) AS x FROM g),
l AS MATERIALIZED (SELECT a.g AS a, b.g AS b FROM e a JOIN e b ON a.x = b.x AND a.g <> b.g AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT g, g AS t FROM g UNION SELECT r.g, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT r.g, min(first) AS component_id FROM r JOIN g ON r.t = g.g GROUP BY r.g)
SELECT doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN doc_id ELSE component_id END AS component_id,
    CASE WHEN len(d.s) = 0 THEN true ELSE doc_id IS NOT DISTINCT FROM component_id END AS kept
FROM d LEFT JOIN g ON d.s = g.s LEFT JOIN c ON g.g = c.g
"""


def oracle_sql() -> dict[str, str]:
    from framewright.llm import licences

    return {"op4_licence_scans": licences.oracle(), "op5_mixing": _OP5, "op11_hard_negatives": _OP11, "op12_vector_codes": _op12(), "op13_minhash": _OP13}
