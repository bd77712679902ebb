"""One query per training-data operator, over whole tables with production parameters, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, embeddings, exact_dedup, langid, licenses, minhash, packing, sharding, suffix, toxicity
from evidentia.partitions import spread


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _costly(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each, over all cores."""
    return spread(_table(spark, sf_dir, name))


def op1_embedding_neardup(spark, sf_dir):
    """The audit stays with the operator, which works on until its recall is met; links are held against all pairs by the SQL."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings")).drop("audit_recall")


def op2_bpe_roundtrip(spark, sf_dir):
    return bpe.bpe_digests(_costly(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return langid.detect(_costly(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(_costly(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_toxicity(spark, sf_dir):
    return toxicity.detect(_costly(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark, sf_dir):
    return minhash.near_dedup(_costly(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix.cut_repeats(_costly(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_costly(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_neardup, op2_bpe_roundtrip, op3_exact_dedup, op4_language_id, op5_packing, op6_toxicity, op7_sharding,
        op8_minhash_neardup, op9_suffix_dedup, op10_license_scan,
    )
}

#: The checksum of a row's id as text, bit by bit, as DuckDB has none.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

SQL = {
    "op1_embedding_neardup": """
        WITH RECURSIVE u AS (
            SELECT vec_id, embedding::double[] AS e, list_inner_product(embedding::double[], embedding::double[]) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.9
        ), walk(node, root) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, walk.root FROM walk JOIN l ON l.a = walk.node
        ), c AS (SELECT node AS vec_id, min(root) AS component_id FROM walk GROUP BY node), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    # the sample of the operator holds all rows of a language up to 2000, so that profiles here are of all
    "op4_language_id": f"""
        WITH d AS (
            SELECT doc_id, lang, {_CRC32} % 4 = 2 AS held_out, regexp_replace(lower(coalesce(text, '')) || ' ', '[^\\p{{L}}]+', ' ', 'g') AS s, text FROM documents
        ), g AS (
            SELECT doc_id, g, count(*) AS n FROM (
                SELECT doc_id, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, length(s) - k + 2), lambda i: substring(s, i, k))))) AS g FROM d
            ) WHERE trim(g) <> '' GROUP BY ALL
        ), learned AS (
            SELECT lang, g, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE lang IS NOT NULL AND text IS NOT NULL AND NOT held_out GROUP BY ALL
        ), p AS (
            SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) AS r FROM learned QUALIFY r <= 300
        ), m AS (
            SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) AS r FROM g QUALIFY r <= 300
        ), away AS (
            SELECT doc_id, l.lang, sum(least(abs(coalesce(p.r, 1000000) - m.r), 300)) AS t, count(*) AS k
            FROM m CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = m.g GROUP BY ALL
        ), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, lang) AS place FROM away QUALIFY place = 1)
        SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - t / (300 * k)::double, 0) AS score FROM d LEFT JOIN best b USING (doc_id)
    """,
    "op8_minhash_neardup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents
        ), c AS (
            SELECT doc_id, s, count(*) AS n FROM (
                SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
            ) GROUP BY ALL
        ), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS met FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE met >= 0.8 * (x.total + y.total - met)
        ), walk(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, walk.root FROM walk JOIN l ON l.a = walk.node),
        k AS (SELECT node AS doc_id, min(root) AS class_id FROM walk GROUP BY node)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, doc_id = class_id AS kept FROM k
    """,
    "op3_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.text_sha256 = g.text_sha256
    """,
}
