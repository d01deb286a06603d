"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's dialect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokenizers
from .binary import read_tokens, write_tokens
from .classifier import classify
from .common import shared_dir
from .jaccard import jaccard_components
from .lm import score_documents
from .merkle import merkle_manifest
from .mixing import mix_sources
from .packing import pack_documents
from .quality import quality_rules
from .secrets import scan_secrets
from .suffix_array import PASSAGE, drop_repeated_bytes
from .suffix_tree import drop_repeated_words
from .tokens import vocabulary
from .topk import exact_top_k, quantised, usable


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(documents(spark, sf_dir)).drop("kept")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(documents(spark, sf_dir), short=PASSAGE).drop("kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("copies")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("vec"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op9_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), path, vocabulary())
    return read_tokens(spark, path)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_tree, op2_suffix_array, op3_packing, op4_mixing, op5_topk, op6_lm, op7_jaccard, op8_quality, op9_binary, op10_secrets, op11_classifier, op12_merkle, op13_alignment)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op4_mixing": rf"""
WITH d AS (
    SELECT doc_id, source, len({_WORDS}) AS size, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM documents
), k AS (
    SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * symbols::DOUBLE / greatest(size, 1)::DOUBLE)) AS key FROM d
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM k GROUP BY source
), c AS (
    SELECT *, source_size::DOUBLE * 3.0::DOUBLE AS cap, source_size::DOUBLE * 3.0::DOUBLE / w AS r FROM s
), l AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
    FROM c WINDOW b AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(w * coalesce(max(level) FILTER (WHERE level <= r) OVER (), max(r) OVER ()), cap) AS target FROM l
), p AS (
    SELECT doc_id, size, source_size, target,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before))::BIGINT AS taken
FROM p""",
    "op5_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), p AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_quality": rf"""
WITH w AS (
    SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), g AS (
    SELECT id, i, count(*) OVER (PARTITION BY id, words[i], words[i + 1], words[i + 2]) AS n FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), r AS (
    SELECT id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE n > 1) GROUP BY id
), li AS (
    SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), f AS (
    SELECT w.id, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN r USING (id) LEFT JOIN li USING (id)
), failing AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), v AS (
    SELECT id, lang, source, x.metric AS metric, ceil(ln((x.a + 1)::DOUBLE / (x.b + 1)) / ln(1.02::DOUBLE))::INT AS bin,
        CASE WHEN x.metric = 'length' THEN ceil(ln((x.a + 1)::DOUBLE / (x.b + 1)) / ln(1.02::DOUBLE))::INT WHEN x.a > 0 THEN ceil(ln(x.a::DOUBLE / (x.b + 1)) / ln(1.02::DOUBLE))::INT END AS own
    FROM (SELECT id, lang, source, unnest([{{'metric': 'symbols', 'a': n_symbols, 'b': n_words}}, {{'metric': 'lines', 'a': n_dup_lines, 'b': n_lines}},
        {{'metric': 'repeats', 'a': n_repeat_words, 'b': n_words}}, {{'metric': 'length', 'a': word_chars, 'b': n_words}}]) AS x FROM failing WHERE NOT base_failed)
), m AS (
    SELECT lang, source, metric, bin, count(*) AS n FROM v GROUP BY ALL
), mp AS (
    SELECT lang, metric, bin, sum(n) AS n FROM m GROUP BY ALL
), q AS (
    SELECT lang, source, metric, max(total) AS of, min(bin) FILTER (WHERE upto >= 0.25 * total) AS q1, min(bin) FILTER (WHERE upto >= 0.75 * total) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM m)
    GROUP BY lang, source, metric
), qp AS (
    SELECT lang, metric, q1 - 3 * greatest(q3 - q1, CASE WHEN of < 20 THEN 10 ELSE 1 END) AS lo, q3 + 3 * greatest(q3 - q1, CASE WHEN of < 20 THEN 10 ELSE 1 END) AS hi FROM (
        SELECT lang, metric, max(total) AS of, min(bin) FILTER (WHERE upto >= 0.25 * total) AS q1, min(bin) FILTER (WHERE upto >= 0.75 * total) AS q3
        FROM (SELECT *, sum(n) OVER (PARTITION BY lang, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, metric) AS total FROM mp)
        GROUP BY lang, metric)
), t AS (
    SELECT q.lang, q.source, q.metric,
        CASE WHEN q.of < 20 THEN qp.hi ELSE least(q.q3 + 3 * greatest(q.q3 - q.q1, 1), qp.hi) END AS hi,
        CASE WHEN q.of < 20 THEN qp.lo ELSE greatest(q.q1 - 3 * greatest(q.q3 - q.q1, 1), qp.lo) END AS lo
    FROM q JOIN qp ON q.lang IS NOT DISTINCT FROM qp.lang AND q.metric = qp.metric
), o AS (
    SELECT id, bool_or(coalesce(own > hi OR v.metric = 'length' AND own < lo, false)) AS outside
    FROM v JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.metric = t.metric GROUP BY id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, true) AS kept FROM failing LEFT JOIN o USING (id)""",
    "op12_merkle": """
WITH RECURSIVE bits AS (
    SELECT i, i AS v, 0 AS k FROM range(256) AS x(i) UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), f AS (
    SELECT *, row_number() OVER () AS id,
        CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
            || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
        CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
        doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 7 = 0 AS hit
    FROM documents, crc
), l AS (
    SELECT id, doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
        CASE WHEN hit THEN sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END || tail) END AS altered
    FROM f
), p AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), nodes AS (
    SELECT lang, 0 AS level, pos AS i, leaf AS h, n FROM p
    UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n
), subroots AS (
    SELECT lang, h, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, place AS i, h, m AS n FROM subroots
    UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, i // 2, n
), ways AS (
    SELECT p.id, level, h, i < (pos >> level) AS is_left FROM p JOIN nodes ON nodes.lang IS NOT DISTINCT FROM p.lang AND i = xor(pos >> level, 1::BIGINT)
    UNION ALL SELECT p.id, height + level, u.h, i < (place >> level) FROM p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN upper u ON i = xor(place >> level, 1::BIGINT)
), proofs AS (
    SELECT id, sha256(string_agg(h, '' ORDER BY level)) AS proof_sha256 FROM ways GROUP BY id
), climb AS (
    SELECT p.id, 0 AS level, coalesce(altered, leaf) AS h, height + (SELECT max(level) FROM upper) AS top FROM p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    UNION ALL SELECT c.id, c.level + 1, sha256(CASE WHEN w.id IS NULL THEN c.h WHEN is_left THEN w.h || c.h ELSE c.h || w.h END), top FROM climb c LEFT JOIN ways w ON w.id = c.id AND w.level = c.level WHERE c.level < top
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN climb c ON c.id = p.id AND c.level = top JOIN upper r ON r.n = 1 LEFT JOIN proofs ON proofs.id = p.id""",
}
