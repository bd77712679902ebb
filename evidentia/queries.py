"""Queries that bind the library's operators to the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import chunking, factcheck, index, metrics, research, retrieval, verification
from evidentia.partitions import kept, sent, small_batches, spread, workspace
from evidentia.sources import pages, parsers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def costly(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each, over all cores."""
    return spread(table(spark, sf_dir, name))


# the term list of column ``text`` in DuckDB
_LOW = "replace(replace(lower(text), '§', ' section '), 'u.s.c.', 'usc')"
_BASE = rf"regexp_extract_all({_LOW}, '[a-z0-9]+(?:[.\-–][a-z0-9]+)*(?:\([a-z0-9]+\))*')"
TERMS = rf"""flatten(list_transform({_BASE}, lambda t: list_concat([t],
    CASE WHEN contains(t, '(') THEN list_concat([split_part(t, '(', 1)], regexp_extract_all(t, '\(([a-z0-9]+)\)', 1)) ELSE [] END,
    CASE WHEN contains(t, '-') AND length(t) < 12 THEN [replace(t, '-', '')] ELSE [] END)))"""
NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

INDEX = f"""
dt AS (SELECT doc_id, {TERMS} AS terms FROM documents),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt),
post AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM dt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
RANKED = (
    INDEX
    + f""",
qt AS (SELECT item_id, {TERMS} AS terms FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(terms) AS term FROM qt) GROUP BY ALL),
bm AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN post USING (term) JOIN idfs USING (term), stats GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0),
ov AS (SELECT item_id, doc_id, round(count(*) / sqrt(any_value(size)), 6) AS score FROM q
       JOIN (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS size, term FROM post) USING (term) GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ov),
f1 AS (SELECT item_id, doc_id, rank - 1 AS first_rank FROM lexical WHERE rank <= 40),
f2 AS (SELECT item_id, doc_id, rank - 1 AS second_rank FROM sparse WHERE rank <= 40),
fu AS (SELECT item_id, doc_id, first_rank, second_rank,
       round(coalesce(1.0::double / (61 + first_rank), 0) + coalesce(1.0::double / (61 + second_rank), 0), 9) AS rrf
       FROM f1 FULL JOIN f2 USING (item_id, doc_id)),
fused AS (SELECT *, concat_ws('+', CASE WHEN first_rank IS NOT NULL THEN 'overlap' END, CASE WHEN second_rank IS NOT NULL THEN 'sparse' END) AS found_by,
          row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, first_rank ASC NULLS LAST, second_rank) - 1 AS pool_rank FROM fu),
auth AS (SELECT doc_id, source, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 5 END AS authority_rank FROM documents)"""
)


def _final(where: str = "true", weight: float = 0.6) -> str:
    return f""",
pool AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pool_rank) AS pool FROM fused JOIN auth USING (doc_id) WHERE {where}),
adj AS (SELECT *, round(rrf + {weight} * (4 - least(authority_rank, 4)), 9) AS adjusted FROM pool WHERE pool <= 40),
fin AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY adjusted DESC, pool) - 1 AS final_rank FROM adj)"""


_BUILT: dict[tuple[str, str], index.Index] = {}


def _index(spark, d) -> index.Index:
    """The index of the documents, built once a session and folder; queries read its tables."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _BUILT:
        source, none = F.col("source"), F.lit(None).cast("string")
        rank = F.when(source == "src0", 1).when(source == "src1", 2).when(source == "src2", 3).otherwise(5)
        rows = table(spark, d, "documents").select(
            F.col("doc_id").alias("chunk_id"), "source", F.concat(F.lit("doc "), "doc_id").alias("citation"), F.col("lang").alias("title"), "text",
            none.alias("url"), none.alias("effective_date"), rank.alias("authority_rank"),
        )
        _BUILT[at] = index.index_of(rows, f"{workspace(spark)}/index-{uuid.uuid4().hex}")
    return _BUILT[at]


def _sparse(spark, d, k=40):
    found = _index(spark, d)
    return retrieval.ranked(found.tokens, found.terms, found.stats, "chunk_id", table(spark, d, "benchmark"), "item_id", "text", k).withColumnRenamed("chunk_id", "doc_id")


def _both(spark, d):
    found = _index(spark, d)
    rows = retrieval.both_ranked(found.tokens, found.terms, found.stats, "chunk_id", table(spark, d, "benchmark"), "item_id", "text", 40)
    return [r.withColumnRenamed("chunk_id", "doc_id") for r in rows]


def _fused(spark, d):
    return retrieval.fuse(*_both(spark, d), "item_id", "doc_id", names=("overlap", "sparse"))


def _with_text(spark, d, rows):
    """``rows`` with the text of each one's document; few rows are sent to the documents, so that no text is moved."""
    rows = kept(rows, "found")
    return sent(rows)(rows).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _sources(spark, d):
    ranks = spark.createDataFrame([("src0", 1), ("src1", 2), ("src2", 3)], "source string, authority_rank int")
    docs = table(spark, d, "documents").select("doc_id", "source").join(F.broadcast(ranks), "source", "left")  # a dimension of fixed size
    return docs.withColumn("authority_rank", F.coalesce("authority_rank", F.lit(5)))


@query(f"SELECT doc_id, len(terms)::bigint AS n_terms, sha1(array_to_string(terms, ' ')) AS terms_sha1 FROM (SELECT doc_id, {TERMS} AS terms FROM documents)")
def tokenize_terms(spark, d):
    rows = costly(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("terms"))
    return rows.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.sha1(F.array_join("terms", " ").cast("binary")).alias("terms_sha1"))


@query("""SELECT coalesce(source, 'TOTAL') AS source, count(*) AS docs, round(avg(length(text)), 6) AS avg_chars, sum(length(text))::bigint AS chars,
          count(DISTINCT lang) AS langs FROM documents GROUP BY ROLLUP (source)""")
def corpus_report(spark, d):
    n = F.length("text")
    rows = table(spark, d, "documents").rollup("source").agg(F.count("*").alias("docs"), F.round(F.avg(n), 6).alias("avg_chars"), F.sum(n).cast("bigint").alias("chars"), F.countDistinct("lang").alias("langs"))
    return rows.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@query(f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def bm25_idf(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {RANKED} SELECT item_id, doc_id, round(score, 4) AS score, rank::bigint AS rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark, d):
    return _sparse(spark, d, 10).select("item_id", "doc_id", F.round("score", 4).alias("score"), (F.col("rank") + 1).cast("bigint").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_inner_product(q.embedding::double[], x.embedding::double[]), 6) AS score
          FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
          SELECT query_id, vec_id, score, rank::bigint AS rank FROM r WHERE rank <= 10""")
def dense_topk(spark, d):
    rows = costly(spark, d, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = retrieval.dense(rows, "vec_id", "embedding", asked, "query_id", "q", 10)
    return found.select("query_id", "vec_id", "score", (F.col("rank") + 1).cast("bigint").alias("rank"))


@query(f"WITH {RANKED} SELECT item_id, doc_id, round(rrf, 6) AS rrf, found_by, pool_rank::bigint AS pool_rank FROM fused")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("item_id", "doc_id", F.round("rrf", 6).alias("rrf"), "found_by", F.col("pool_rank").cast("bigint").alias("pool_rank"))


@query(f"WITH {RANKED}{_final(weight=0.0)} SELECT item_id, doc_id, 'S' || (final_rank + 1) AS tag FROM fin WHERE final_rank < 8")
def hybrid_topk(spark, d):
    p = retrieval.Params(authority=0.0)
    return retrieval.retrieve(_fused(spark, d), _sources(spark, d), "item_id", "doc_id", p=p).select("item_id", "doc_id", "tag")


_KEEP = "source IN ('src1', 'src2', 'src3')"


@query(f"WITH {RANKED}{_final(_KEEP, 0.0)} SELECT item_id, doc_id, source, final_rank::bigint AS final_rank FROM fin WHERE final_rank < 8")
def hybrid_source_filtered(spark, d):
    p = retrieval.Params(authority=0.0)
    rows = retrieval.retrieve(_fused(spark, d), _sources(spark, d), "item_id", "doc_id", keep=["src1", "src2", "src3"], p=p)
    return rows.select("item_id", "doc_id", "source", F.col("final_rank").cast("bigint").alias("final_rank"))


@query(f"WITH {RANKED}{_final()} SELECT item_id, doc_id, round(adjusted, 6) AS adjusted, final_rank::bigint AS final_rank FROM fin WHERE final_rank < 8")
def authority_prior(spark, d):
    rows = retrieval.retrieve(_fused(spark, d), _sources(spark, d), "item_id", "doc_id")
    return rows.select("item_id", "doc_id", F.round("adjusted", 6).alias("adjusted"), F.col("final_rank").cast("bigint").alias("final_rank"))


@query(f"""WITH {RANKED}{_final()} SELECT b.item_id, (rrf IS NULL OR rrf < 0.03) AS abstain,
          CASE WHEN rrf IS NULL THEN 'no candidates' WHEN rrf < 0.03 THEN 'low score' END AS reason
          FROM benchmark b LEFT JOIN (SELECT item_id, rrf FROM fin WHERE final_rank = 0) USING (item_id)""")
def abstain_gate(spark, d):
    rows = retrieval.retrieve(_fused(spark, d), _sources(spark, d), "item_id", "doc_id")
    return retrieval.abstain(table(spark, d, "benchmark"), rows, "item_id", 0.03)


_ROUND = "{0} AS (SELECT *, row_number() OVER (PARTITION BY item_id, grp ORDER BY pool_rank) AS r FROM (SELECT *, CASE WHEN authority_rank = 1 THEN 'statute' WHEN authority_rank = 2 THEN 'regulation' ELSE 'guidance' END AS grp FROM fused JOIN auth USING (doc_id)))"


@query(f"WITH {RANKED}, {_ROUND.format('g')} SELECT item_id, grp, doc_id, r::bigint AS rank FROM g WHERE r <= 3")
def compare_authorities(spark, d):
    found = _fused(spark, d)
    found = sent(found)(found).join(_sources(spark, d), "doc_id")
    rows = research.per_authority(found, "item_id", {"statute": ["src0"], "regulation": ["src1"]}, other="guidance")
    return rows.select("item_id", F.col("kind").alias("grp"), "doc_id", F.col("place").cast("bigint").alias("rank"))


_EXPAND = ", ".join(
    ("CASE WHEN regexp_matches(lower(text), '{p}') THEN " + ("concat('INA section ', regexp_extract(lower(text), '{p}', 1), ' Immigration and Nationality Act')" if r"\1" in w else "'{w}'") + " END").format(p=p, w=w)
    for p, w in T.EXPANSIONS
)


@query(f"SELECT conv_id, turn, concat_ws(' ', text, {_EXPAND}) AS expanded FROM conversations")
def query_expansion(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.expand_query(F.col("text")).alias("expanded"))


@query(f"""WITH q AS (SELECT item_id, {NORM.format('text')} AS quote FROM benchmark), b AS (SELECT doc_id, {NORM.format('text')} AS body FROM documents)
          SELECT DISTINCT item_id, doc_id FROM q, b WHERE quote <> '' AND contains(body, quote)""")
def quote_exact(spark, d):
    return verification.quotes_in(table(spark, d, "benchmark"), "item_id", "text", costly(spark, d, "documents"), "doc_id", "text")


@query()
def quote_fuzzy(spark, d):
    """Each passage against its three best documents; no SQL, as difflib's ratio has none."""
    pairs = _sparse(spark, d, 3).join(table(spark, d, "benchmark").withColumnRenamed("text", "quote"), "item_id")
    pairs = kept(_with_text(spark, d, pairs), "pairs")
    return verification.verify_quotes(pairs, "quote", "text").select("item_id", "doc_id", "similarity", "found")


_SENT = r"list_filter(string_split(regexp_replace(text, '([.!?])[\s]+([A-Z\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(rf"""WITH s AS (SELECT doc_id, {_SENT} AS ss FROM documents)
          SELECT doc_id, len(ss)::bigint AS sentences, len(list_filter(ss, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 5 AND NOT regexp_matches(s, '\bS\d+\b')))::bigint AS uncited FROM s""")
def sentence_coverage(spark, d):
    n, uncited = verification.coverage(F.col("text"))
    return costly(spark, d, "documents").select("doc_id", n.alias("sentences"), uncited.alias("uncited"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text, '\b([A-Z]\w*\d+|S\d+)\b', 1))) AS tags FROM conversations)
          SELECT conv_id, turn, len(list_filter(tags, lambda x: x IN ('S1', 'S2', 'S3')))::bigint AS valid, len(list_filter(tags, lambda x: regexp_matches(x, '^S\d+$') AND x NOT IN ('S1', 'S2', 'S3')))::bigint AS invalid FROM t""")
def tag_validity(spark, d):
    tags, there = verification.cited_tags(F.col("text")), F.array(*(F.lit(f"S{i}") for i in (1, 2, 3)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_intersect(tags, there)).cast("bigint").alias("valid"), F.size(F.array_except(tags, there)).cast("bigint").alias("invalid"))


_GRADE = "CASE WHEN toxic = 0 AND quality = 1 AND doc_id % 3 <> 0 THEN 'GROUNDED' WHEN toxic > 0 OR quality < 0.5 THEN 'UNGROUNDED' ELSE 'PARTIAL' END"


@query(f"""SELECT doc_id, {_GRADE} AS grade, CASE {_GRADE} WHEN 'UNGROUNDED' THEN 'low' WHEN 'PARTIAL' THEN 'medium' ELSE 'high' END AS confidence,
          CASE {_GRADE} WHEN 'UNGROUNDED' THEN 'AUTOMATED GROUNDING CHECK FAILED: see grade' WHEN 'PARTIAL' THEN 'Partial grounding: see grade' ELSE '' END AS caveats FROM labels""")
def grounding_enforced(spark, d):
    """The grade of each labelled document read as an answer: toxic as invalid tags, quality as fidelity, every third not fully covered."""
    rows = table(spark, d, "labels")
    covered = F.when(F.col("doc_id") % 3 != 0, 1.0).otherwise(0.5)
    rows = rows.withColumn("grade", verification.grade(F.col("toxic"), F.col("quality"), covered))
    confidence, caveats = verification.enforce(F.col("grade"), F.lit("high"), F.array().cast("array<string>"), F.lit("see grade"))
    return rows.select("doc_id", "grade", confidence.alias("confidence"), F.array_join(caveats, "; ").alias("caveats"))


_HEAD = r"^\s*(?:\d+\s?FAM\s[\d.\-()A-Z]+.*|[A-Z]\.\s+[A-Z]\S.{0,80}|\d{1,2}\.\s+[A-Z]\S.{0,80}|Chapter\s+\d+\s*[-–].{0,80}|[A-Z][A-Z0-9 ,''\-/&()]{6,80})\s*$"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
          h AS (SELECT *, (regexp_matches(trim(line), '{_HEAD}') AND length(trim(line)) < 100) AS is_heading FROM l),
          b AS (SELECT *, sum(is_heading::int) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM h),
          g AS (SELECT doc_id, block, coalesce(max(CASE WHEN is_heading THEN trim(line) END), '') AS heading, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS body FROM b GROUP BY ALL)
          SELECT doc_id, block::bigint AS block, heading, sha1(body) AS body_sha1 FROM g WHERE body <> ''""")
def heading_blocks(spark, d):
    rows = chunking.heading_blocks(costly(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", "block", "heading", F.sha1(F.col("body").cast("binary")).alias("body_sha1"))


@query()
def statutory_chunks(spark, d):
    """An ordered fold a document: no SQL; held against the published marker vectors in the tests."""
    return chunking.chunk_statutory(costly(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, concat(doc_id, printf('#%04d:', doc_id % 10000), substring(sha1(text), 1, 12)) AS chunk_id, floor(length(text) / 4)::bigint AS tokens FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") % 10000, F.col("text")).alias("chunk_id"), T.approx_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT page_id, sha1(regexp_replace(regexp_replace(regexp_replace(translate(html, chr(160) || '‘’“”', ' ''''""'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_sha1 FROM pages""")
def normalize_whitespace(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha1(T.normalize_ws(F.col("html")).cast("binary")).alias("clean_sha1"))


_PDF = "text"
for _p in T.FURNITURE:
    _PDF = f"regexp_replace({_PDF}, '(?im){_p}', '', 'g')"
_PDF = rf"regexp_replace({_PDF}, '([a-z])[ \t]*-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g')"
for _ in range(2):
    _PDF = rf"regexp_replace({_PDF}, '([^\n.:;?!\-])\n([a-z])', '\1 \2', 'g')"


@query(f"SELECT doc_id, sha1({_PDF}) AS clean_sha1 FROM documents")
def clean_page_text(spark, d):
    return costly(spark, d, "documents").select("doc_id", F.sha1(T.clean_pdf_text(F.col("text")).cast("binary")).alias("clean_sha1"))


@query()
def html_parse(spark, d):
    """Title, first heading and text of every page, by the standard library's parser; no SQL."""
    small_batches(spark)
    return costly(spark, d, "pages").withColumn("p", parsers.parse_html("html")).select("page_id", "url", "p.*")


@query("SELECT min(doc_id) AS doc_id, source, count(*) AS copies FROM documents GROUP BY source, text")
def dedupe_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return docs.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""SELECT doc_id, coalesce(CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 END, 5) AS authority_rank FROM documents""")
def authority_dim(spark, d):
    return _sources(spark, d).select("doc_id", "authority_rank")


_PAIRS = [
    ("8 CFR § 214.2(f)(10)(ii)(C)", "8 CFR 214.2(f)(10)"), ("8 CFR § 214.2(h)", "8 CFR 214.2(f)"), ("INA § 214(g) (8 U.S.C. § 1184(g))", "INA 214(g)(1)(A)"),
    ("INA § 274 (8 U.S.C. § 1324)", "INA 274A"), ("IRS Publication 501", "IRS Publication 501"), ("INA § 101", ""), ("9 FAM 402.1", "9 FAM"),
]
_N = r"regexp_replace(regexp_replace(replace(replace(lower({0}), '§', ''), 'u.s.c.', 'usc'), '\s+', '', 'g'), '\(8usc[\d.]+(?:\([a-z0-9]+\))*\)', '', 'g')"


@query(
    "WITH c(found, gold) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS) + "), n AS (SELECT found, gold, " + _N.format("found") + " AS p, " + _N.format("gold") + r""" AS g FROM c),
    k AS (SELECT *, regexp_extract(p, '^([a-z]+[\d]*[\d.]*)', 1) AS ps, regexp_extract(g, '^([a-z]+[\d]*[\d.]*)', 1) AS gs,
    array_to_string(regexp_extract_all(p, '\(([a-z0-9]+)\)', 1), '') AS pl, array_to_string(regexp_extract_all(g, '\(([a-z0-9]+)\)', 1), '') AS gl FROM n)
    SELECT found, gold, g <> '' AND CASE WHEN ps <> '' AND gs <> '' THEN ps = gs AND (starts_with(pl, gl) OR starts_with(gl, pl)) ELSE contains(p, g) OR contains(g, p) END AS matches, g <> '' AND p = g AS exact FROM k"""
)
def citation_match(spark, d):
    rows = spark.createDataFrame(_PAIRS, "found string, gold string")
    return rows.select("found", "gold", T.citation_match(F.col("found"), F.col("gold")).alias("matches"), T.citation_match(F.col("found"), F.col("gold"), strict=True).alias("exact"))


@query("WITH x(act, code) AS (VALUES ('214', '1184'), ('274A', '1324a'), ('101', '1101'), ('999', NULL), ('331', '1442')) SELECT act, code FROM x")
def crosswalk_join(spark, d):
    asked = spark.createDataFrame([("INA 214(b)", "214"), ("INA § 274A", "274A"), ("101", "101"), ("INA 999", "999"), ("ina 331", "331")], "cited string, act string")
    rows = asked.withColumn("key", parsers.act_key(F.col("cited"))).join(F.broadcast(parsers.crosswalk(spark)), F.col("key") == F.col("act_section"), "left")
    return rows.select("act", F.col("code_section").alias("code"))


_HIT = f"""gold AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {NORM.format('text')} AS quote FROM benchmark), (SELECT doc_id, {NORM.format('text')} AS body FROM documents) WHERE quote <> '' AND contains(body, quote)),
hit AS (SELECT item_id, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS hit FROM (SELECT DISTINCT item_id FROM gold) i LEFT JOIN (SELECT * FROM sparse WHERE rank <= 10) s USING (item_id) LEFT JOIN gold g USING (item_id, doc_id) GROUP BY item_id)"""


@query(f"""WITH {RANKED}, {_HIT} SELECT count(*) AS n, {', '.join(f'round(avg((coalesce(hit, 999) <= {k})::int), 6) AS recall_{k}' for k in (1, 3, 5, 8))},
          round(avg(coalesce(1.0::double / hit, 0)), 6) AS mrr, round(avg(CASE WHEN hit <= 5 THEN 1.0::double / log2(hit + 1) ELSE 0 END), 6) AS ndcg_5 FROM hit""")
def retrieval_metrics(spark, d):
    gold = kept(quote_exact(spark, d).withColumnRenamed("doc_id", "gold_doc"), "gold")
    found = metrics.first_hit(_sparse(spark, d, 10), gold, "item_id", "rank", F.col("doc_id") == F.col("gold_doc"))
    return metrics.retrieval_metrics(found)


_CASES = """cases AS (SELECT lang AS config, CASE WHEN quality = 1 THEN 'SUPPORTED' WHEN toxic = 1 THEN 'NOT_ADDRESSED' ELSE 'CONTRADICTED' END AS gold,
 CASE WHEN n_chars < 500 THEN 'NOT_ADDRESSED' WHEN n_chars < 1000 THEN 'PARTIALLY_SUPPORTED' WHEN toxic = 1 THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS pred,
 toxic, quality, n_chars, doc_id FROM labels JOIN documents USING (doc_id))"""


def _cases(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    n, toxic = F.col("n_chars"), F.col("toxic")
    return rows.select(
        F.col("lang").alias("config"), "doc_id",
        F.when(F.col("quality") == 1, "SUPPORTED").when(toxic == 1, "NOT_ADDRESSED").otherwise("CONTRADICTED").alias("gold_verdict"),
        F.when(n < 500, "NOT_ADDRESSED").when(n < 1000, "PARTIALLY_SUPPORTED").when(toxic == 1, "CONTRADICTED").otherwise("SUPPORTED").alias("predicted_verdict"),
        F.when(F.col("doc_id") % 2 == 0, F.col("quality") == 1).alias("cited_gold"), F.when(F.col("doc_id") % 5 != 0, F.col("quality").cast("double")).alias("quote_fidelity"),
        F.when(toxic == 1, "UNGROUNDED").otherwise("GROUNDED").alias("grounding_grade"), (n / 1000).alias("latency_s"), (n * 0.25 / 1e6).alias("cost_usd"),
        (F.col("doc_id") % 7 == 0).alias("downgraded"),
    )


@query(f"""WITH {_CASES}, m AS (SELECT config, count(*) AS n, round(avg((gold = pred)::int), 6) AS accuracy,
 round(avg(CASE WHEN gold = pred THEN 1.0::double WHEN pred = 'PARTIALLY_SUPPORTED' AND gold IN ('SUPPORTED', 'CONTRADICTED') THEN 0.5 ELSE 0 END), 6) AS score,
 coalesce(round(avg(CASE WHEN doc_id % 2 = 0 THEN (quality = 1)::int END), 6), 0) AS citation_precision, coalesce(round(avg(CASE WHEN doc_id % 5 <> 0 THEN quality END), 6), 1) AS quote_fidelity,
 round(sum(toxic)::double / count(*), 6) AS hallucination,
 coalesce(round(sum(CASE WHEN pred IN ('SUPPORTED', 'CONTRADICTED') THEN toxic END)::double / nullif(count(CASE WHEN pred IN ('SUPPORTED', 'CONTRADICTED') THEN 1 END), 0), 6), 0) AS residual_hallucination,
 coalesce(round(sum(CASE WHEN pred IN ('SUPPORTED', 'CONTRADICTED') OR doc_id % 7 = 0 THEN toxic END)::double / nullif(count(CASE WHEN pred IN ('SUPPORTED', 'CONTRADICTED') OR doc_id % 7 = 0 THEN 1 END), 0), 6), 0) AS detected_hallucination,
 coalesce(round(count(CASE WHEN gold = 'NOT_ADDRESSED' AND pred = 'NOT_ADDRESSED' THEN 1 END)::double / nullif(count(CASE WHEN pred = 'NOT_ADDRESSED' THEN 1 END), 0), 6), 0) AS abstention_precision,
 coalesce(round(count(CASE WHEN gold = 'NOT_ADDRESSED' AND pred = 'NOT_ADDRESSED' THEN 1 END)::double / nullif(count(CASE WHEN gold = 'NOT_ADDRESSED' THEN 1 END), 0), 6), 1) AS abstention_recall,
 round(avg(n_chars / 1000::double), 6) AS latency_s, round(sum(n_chars * 0.25::double / 1e6), 6) AS cost_usd FROM cases GROUP BY config) SELECT * FROM m""")
def generation_metrics(spark, d):
    return metrics.generation_metrics(_cases(spark, d), ["config"])


@query(f"WITH {_CASES}, m AS (SELECT config, round(avg((gold = pred)::int), 6) AS a FROM cases GROUP BY config) SELECT (SELECT config FROM m ORDER BY a DESC, config DESC LIMIT 1) AS best, round(max(a) - min(a), 6) AS gap FROM m")
def best_config(spark, d):
    rows = metrics.generation_metrics(_cases(spark, d), ["config"])
    return rows.agg(F.max_by("config", F.struct("accuracy", "config")).alias("best"), F.round(F.max("accuracy") - F.min("accuracy"), 6).alias("gap"))


_V = "CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'NOT_ADDRESSED' END"


@query(f"""SELECT doc_id // 4 AS claim_id, CASE WHEN bool_or({_V} = 'CONTRADICTED') THEN CASE WHEN bool_and({_V} <> 'SUPPORTED') THEN 'CONTRADICTED' ELSE 'PARTIALLY_SUPPORTED' END
          WHEN bool_and({_V} = 'SUPPORTED') THEN 'SUPPORTED' WHEN bool_and({_V} = 'NOT_ADDRESSED') THEN 'NOT_ADDRESSED' ELSE 'PARTIALLY_SUPPORTED' END AS verdict FROM labels GROUP BY ALL""")
def verdict_aggregate(spark, d):
    v = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("quality") == 1, "SUPPORTED").otherwise("NOT_ADDRESSED")
    rows = table(spark, d, "labels").withColumn("claim_id", F.floor(F.col("doc_id") / 4)).withColumn("v", v)
    return rows.groupBy("claim_id").agg(metrics.overall_verdict(F.col("v")).alias("verdict"))


@query(rf"""WITH s AS (SELECT item_id, text, {_SENT} AS ss FROM benchmark) SELECT item_id, len(ss) > 0 AND len(list_filter(ss, lambda p: len(list_filter(regexp_split_to_array(trim(p), '\s+'), lambda w: w <> '')) < 5 OR length(trim(p)) < 25 OR length(trim(p)) > length(text) + 40)) = 0 AS usable FROM s""")
def usable_subclaims(spark, d):
    return table(spark, d, "benchmark").select("item_id", metrics.usable_split(T.split_sentences(F.col("text")), F.col("text")).alias("usable"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events)
          SELECT event_type, event_id, rank::bigint AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rank) AS kept FROM r WHERE rank <= 4 AND ts::date >= DATE '2024-01-15' - 7) WHERE kept <= 3""")
def currency_check(spark, d, as_of=datetime.date(2024, 1, 15)):
    """Of the four best notices of each kind, the first three that are recent as of a given day."""
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")) - 1
    rows = table(spark, d, "events").select("event_type", rank.alias("final_rank"), F.to_date("ts").cast("string").alias("effective_date"), F.col("event_id").cast("string").alias("citation"))
    rows = rows.withColumns({"title": F.col("final_rank").cast("string"), "url": F.lit("")})
    recent = factcheck.recent_changes(rows, ["event_type"], as_of.isoformat(), days=7)
    return recent.select("event_type", F.col("citation").cast("bigint").alias("event_id"), (F.col("title") + 1).cast("bigint").alias("rank"))


@query("""SELECT role, count(*) AS calls, sum(length(text) // 4)::bigint AS tokens, round(sum(length(text) // 4) * CASE role WHEN 'assistant' THEN 2.0::double WHEN 'user' THEN 0.25 ELSE 0 END / 1e6, 9) AS usd
          FROM conversations GROUP BY role""")
def usage_cost(spark, d):
    prices = spark.createDataFrame([("assistant", 2.0), ("user", 0.25)], "role string, price double")
    rows = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum(T.approx_tokens(F.col("text"))).alias("tokens"))
    return rows.join(F.broadcast(prices), "role", "left").select("role", "calls", "tokens", F.round(F.col("tokens") * F.coalesce("price", F.lit(0.0)) / 1e6, 9).alias("usd"))


@query("""SELECT conv_id, count(*) AS steps, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers, max_by(turn, turn) AS last_turn, string_agg(role, '>' ORDER BY turn) AS trace FROM conversations GROUP BY conv_id""")
def turn_trace(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", "steps", "answers", "last_turn", F.array_join(F.transform("t", lambda s: s["role"]), ">").alias("trace"))


_CITED = "'SRC § ' || (doc_id % 50) || '(' || chr(97 + (doc_id % 5)::int) || ')'"


def _cited(spark, d):
    """Every document as a chunk under an invented citation."""
    number, letter = F.col("doc_id") % 50, F.char(97 + F.col("doc_id") % 5)
    citation = F.concat(F.lit("SRC § "), number, F.lit("("), letter, F.lit(")"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), citation.alias("citation"), (F.col("doc_id") % 7).alias("seq"), "source", F.length("text").alias("n_chars"))


_ASKED = [("a", "SRC 7"), ("b", "src § 12(c)"), ("c", "SRC 99"), ("d", "§ ")]


@query("WITH q(qid, cited) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ASKED) + f"""), c AS (SELECT doc_id AS chunk_id, {_CITED} AS citation, doc_id % 7 AS seq FROM documents),
    m AS (SELECT qid, chunk_id, citation, row_number() OVER (PARTITION BY qid ORDER BY length(citation), seq, chunk_id) AS rank FROM q, c
          WHERE regexp_replace(lower(cited), '[§ ]', '', 'g') <> '' AND contains(regexp_replace(lower(citation), '[§ ]', '', 'g'), regexp_replace(lower(cited), '[§ ]', '', 'g')))
    SELECT qid, chunk_id, citation, rank::bigint AS rank FROM m WHERE rank <= 6""")
def citation_lookup(spark, d):
    asked = spark.createDataFrame(_ASKED, "qid string, cited string")
    return index.lookup_citations(asked, "qid", "cited", _cited(spark, d)).select("qid", "chunk_id", "citation", (F.col("rank") + 1).cast("bigint").alias("rank"))


_GOLD = [("a", "SRC § 7(c)"), ("b", "SRC 12"), ("c", "SRC 99"), ("d", ""), ("e", "SRC 3(z)")]


@query("WITH g(id, gold) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _GOLD) + f"""), n AS (SELECT id, gold, {_N.format('gold')} AS g FROM g), c AS (SELECT DISTINCT {_N.format(_CITED)} AS p FROM documents),
    k AS (SELECT id, g, p, regexp_extract(p, '^([a-z]+[0-9.]*)', 1) AS ps, regexp_extract(g, '^([a-z]+[0-9.]*)', 1) AS gs, regexp_extract(p, '\\(([a-z0-9]+)\\)', 1) AS pl, regexp_extract(g, '\\(([a-z0-9]+)\\)', 1) AS gl FROM n, c)
    SELECT id, CASE WHEN any_value(g) = '' THEN 'abstention' WHEN bool_or(p = g OR (ps = gs AND (starts_with(pl, gl) OR starts_with(gl, pl)))) THEN 'ok' ELSE 'missing' END AS status FROM k GROUP BY id""")
def gold_resolution(spark, d):
    return index.resolve_gold(spark.createDataFrame(_GOLD, "id string, gold string"), "id", "gold", _cited(spark, d))


@query(f"""SELECT coalesce(source, 'TOTAL') AS source, count(*) AS chunks, round(avg(length(text)), 6) AS avg_chars, count(DISTINCT {_CITED}) AS citations, floor(sum(length(text)) / 4)::bigint AS tokens
    FROM documents GROUP BY ROLLUP (source)""")
def chunk_report(spark, d):
    return index.chunk_report(_cited(spark, d))


# the second ranker's scores of a query and the first 2000 characters of a passage
_LEXICAL = f"""pt AS (SELECT doc_id, {TERMS} AS held FROM (SELECT doc_id, substring(text, 1, 2000) AS text FROM documents)),
qd AS (SELECT item_id, list_distinct({TERMS}) AS want FROM benchmark)"""
_SCORE = "round(len(list_intersect(want, held)) / greatest(len(want), 1)::double, 6)"


@query(f"""WITH {RANKED}, {_LEXICAL}, pool AS (SELECT * FROM fused WHERE pool_rank < 40),
    lx AS (SELECT item_id, doc_id, pool_rank, {_SCORE} AS score, {_SCORE} + 0.6 * (4 - least(authority_rank, 4)) AS adjusted FROM pool JOIN pt USING (doc_id) JOIN qd USING (item_id) JOIN auth USING (doc_id)),
    m AS (SELECT 'overlap' AS mode, item_id, doc_id, rank FROM lexical UNION ALL SELECT 'sparse', item_id, doc_id, rank FROM sparse UNION ALL SELECT 'hybrid', item_id, doc_id, pool_rank + 1 FROM fused
    UNION ALL SELECT 'hybrid+rerank', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pool_rank) FROM lx
    UNION ALL SELECT 'hybrid+rerank+auth', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(adjusted, 9) DESC, pool_rank) FROM lx) SELECT mode, item_id, doc_id, rank::bigint AS rank FROM m WHERE rank <= 8""")
def ablation_modes(spark, d):
    """The same queries in the five configurations of the retrieval ablation; the first ranker is a lexical overlap, as there is no embedder here."""
    first, second = _both(spark, d)
    none, weight = first.filter(F.lit(False)), retrieval.Params().authority
    both = retrieval.fuse(first, second, "item_id", "doc_id")
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("asked"))
    scored = _with_text(spark, d, both.filter(F.col("pool_rank") < 40)).join(asked, "item_id")
    scored = kept(scored.withColumn("lexical", retrieval.lexical_score(F.col("asked"), F.col("text"))).drop("text", "asked"), "scored")
    runs = [
        ("overlap", retrieval.fuse(first, none, "item_id", "doc_id"), None, 0.0), ("sparse", retrieval.fuse(none, second, "item_id", "doc_id"), None, 0.0),
        ("hybrid", both, None, 0.0), ("hybrid+rerank", scored, F.col("lexical"), 0.0), ("hybrid+rerank+auth", scored, F.col("lexical"), weight),
    ]
    parts = [
        retrieval.retrieve(f, _sources(spark, d), "item_id", "doc_id", score=by, p=retrieval.Params(authority=w)).select(F.lit(m).alias("mode"), "item_id", "doc_id", (F.col("final_rank") + 1).cast("bigint").alias("rank"))
        for m, f, by, w in runs
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


_WIDE = RANKED.replace(f"SELECT item_id, {TERMS} AS terms FROM benchmark", f"SELECT item_id, {TERMS} AS terms FROM (SELECT item_id, concat_ws(' ', text, {_EXPAND}) AS text FROM benchmark)")


@query(f"""WITH {_WIDE}, {_LEXICAL}, lx AS (SELECT item_id, doc_id, rank, round({_SCORE} + 0.6 * (4 - least(authority_rank, 4)), 9) AS adjusted
    FROM sparse JOIN pt USING (doc_id) JOIN qd USING (item_id) JOIN auth USING (doc_id) WHERE rank <= 40),
    fin AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY adjusted DESC, rank) AS final FROM lx)
    SELECT item_id, doc_id, 'S' || final AS tag, round(adjusted, 6) AS adjusted FROM fin WHERE final <= 8""")
def index_search(spark, d):
    """The built index searched with the expanded queries, the second ranker and the authority prior."""
    asked = table(spark, d, "benchmark").select("item_id", "text").withColumnRenamed("text", "q")
    found = _index(spark, d).search(asked, "item_id", "q", mode="sparse", rerank=True)
    return found.select("item_id", F.col("chunk_id").alias("doc_id"), "tag", F.round("adjusted", 6).alias("adjusted"))


@query(f"WITH {INDEX} SELECT doc_id, sum(tf)::bigint AS terms, count(*) AS held, any_value(dl)::bigint AS dl FROM post GROUP BY doc_id")
def index_postings(spark, d):
    """What the built index holds of each document: its terms, distinct terms and length."""
    return _index(spark, d).tokens.filter("dl > 0").select(F.col("chunk_id").alias("doc_id"), F.size("terms").cast("bigint").alias("terms"), F.col("held").cast("bigint").alias("held"), "dl")


@query(f"""SELECT doc_id // 4 AS claim_id, CASE WHEN bool_or({_GRADE} = 'UNGROUNDED') THEN 'UNGROUNDED' WHEN bool_or({_GRADE} = 'PARTIAL') THEN 'PARTIAL' ELSE 'GROUNDED' END AS grade FROM labels GROUP BY ALL""")
def answer_grade(spark, d):
    covered = F.when(F.col("doc_id") % 3 != 0, 1.0).otherwise(0.5)
    rows = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 4).alias("claim_id"), verification.grade(F.col("toxic"), F.col("quality"), covered).alias("g"))
    return rows.groupBy("claim_id").agg(factcheck.answer_grade(F.col("g")).alias("grade"))


_LOOSE = [
    (1, '{"caveats": "none", "verdict": "SUPPORTED"}', "", "SUPPORTED"), (2, '```json\n{"caveats": ["a", "b"], "verdict": "CONTRADICTED"}\n```', "a;b", "CONTRADICTED"),
    (3, 'So: {"caveats": "one thing", "verdict": "MAYBE"} done', "one thing", "NOT_ADDRESSED"), (4, '{"caveats": null}', "", "NOT_ADDRESSED"),
    (5, '{"caveats": 3}', "3", "NOT_ADDRESSED"), (6, "no json here", factcheck.UNREADABLE, "NOT_ADDRESSED"), (7, None, factcheck.UNREADABLE, "NOT_ADDRESSED"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::bigint, '{c}', '{v}')" for i, _, c, v in _LOOSE) + ") t(id, caveats, verdict)")
def loose_answers(spark, d):
    """Model outputs of seven shapes; the SQL states what each must come to."""
    rows = spark.createDataFrame([(i, o) for i, o, _, _ in _LOOSE], "id long, output string")
    return factcheck.read_answers(rows).select("id", F.array_join("caveats", ";").alias("caveats"), "verdict")


@query(f"""WITH {RANKED}{_final(weight=0.0)}, b AS (SELECT item_id, final_rank, '[S' || (final_rank + 1) || '] doc ' || doc_id || ' | ' || source || chr(10) || 'source=' || source || ' url=' || chr(10) || '---' || chr(10) || text || chr(10) AS block
    FROM fin JOIN documents USING (doc_id, source) WHERE final_rank < 8) SELECT item_id, sha1(string_agg(block, chr(10) || chr(10) ORDER BY final_rank)) AS context_sha1 FROM b GROUP BY item_id""")
def context_blocks(spark, d):
    rows = _with_text(spark, d, retrieval.retrieve(_fused(spark, d), _sources(spark, d), "item_id", "doc_id", p=retrieval.Params(authority=0.0)))
    rows = rows.select("item_id", "final_rank", "tag", F.concat(F.lit("doc "), "doc_id").alias("citation"), F.col("source").alias("title"), "source", F.lit("").alias("url"), "text")
    return factcheck.contexts(rows, ["item_id"]).select("item_id", F.sha1(F.col("context").cast("binary")).alias("context_sha1"))


@query("""WITH r AS (SELECT user_id % 20 AS topic, event_id, ts::date AS day, row_number() OVER (PARTITION BY user_id % 20 ORDER BY value DESC, event_id) AS rank FROM events)
    SELECT topic, event_id, row_number() OVER (PARTITION BY topic ORDER BY day DESC NULLS LAST, rank)::bigint AS place FROM r WHERE rank <= 6""")
def recent_changes(spark, d):
    """The six best notices of a topic, the latest first; those without a date last."""
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("topic"), "event_id", "value", F.to_date("ts").alias("effective_date"))
    best = retrieval.top_k(rows, "topic", [F.desc("value"), F.col("event_id")], 6, "final_rank")
    return research.newest_first(best, "topic").select("topic", "event_id", F.col("place").cast("bigint").alias("place"))


@query("""WITH s AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text) AS k FROM conversations) SELECT conv_id, role, turn, sha1(text) AS text_sha1 FROM s WHERE k = 1""")
def last_record(spark, d):
    """Of what was recorded under one key, the last."""
    rows = parsers.first_of(table(spark, d, "conversations"), ["conv_id", "role"], [F.desc("turn"), F.col("text")])
    return rows.select("conv_id", "role", "turn", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


@query()
def page_text(spark, d):
    """The text of each page's main element without navigation, by the standard library's parser; no SQL."""
    return costly(spark, d, "pages").select("page_id", pages.page_text(F.col("html"), pages.POLICY_BODY, pages.POLICY_JUNK).alias("text"))


@query()
def chunk_corpus(spark, d):
    """The documents as chunks under context headers; an ordered fold, so no SQL."""
    docs = costly(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.concat(F.lit("doc "), "doc_id").alias("citation"), F.col("lang").alias("title"), "text")
    none = F.lit(None).cast("string")
    return chunking.chunk_corpus(docs.withColumns({"url": none, "breadcrumb": F.array().cast("array<string>"), "as_of": none, "effective_date": none}))


@query()
def grounding_report(spark, d):
    """Each passage as an answer that quotes itself under the tags S1 and S9, checked against what was found for it; no SQL, as quotes are matched fuzzily."""
    found = _with_text(spark, d, retrieval.retrieve(_fused(spark, d), _sources(spark, d), "item_id", "doc_id")).withColumn("citation", F.concat(F.lit("doc "), "doc_id"))
    found = kept(found, "found")
    quote = lambda tag: F.struct(F.lit(tag).alias("tag"), F.col("text").alias("quote"), F.lit("").alias("relevance"))
    answers = table(spark, d, "benchmark").select("item_id", F.col("text").alias("explanation"), F.array(quote("S1"), quote("S9")).alias("evidence"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("caveats"))
    return factcheck.downgrade(factcheck.ground(answers, found, ["item_id"])).select("item_id", "grade", "confidence", "grounding", F.size("caveats").alias("n_caveats"))
