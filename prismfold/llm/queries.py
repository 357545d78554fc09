"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding, licenses, line_dedup, neardup, packing, repeats, sharding, toxicity, warc
from .common import NULL_ID

#: Labels in the order of the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.LineIndex.build(docs).apply(docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__sha256").alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    group = F.when(F.col("group_id") != NULL_ID, F.col("group_id")).alias("group_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), group)


def op5_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]), F.lit(0).cast("long")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.CaptureIndex.write(table(spark, sf_dir, "pages")).read()
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), "containment", F.to_json("matches").alias("matches"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_embedding_near_dedup, op2_line_dedup, op3_packing, op4_sharding, op5_repeat_removal, op6_minhash_near_dedup, op7_warc, op8_benchmark_decontamination, op9_toxicity, op10_license_scan)
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


_LINES = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
),
counted AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper > doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN counted USING (k) GROUP BY doc_id
"""

_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN comp USING (vec_id)
"""

_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


#: The words of a text, as SQL.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
c AS (SELECT min(doc_id) AS c, any_value(w) AS w FROM w WHERE text IS NOT NULL GROUP BY CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 't' || text END),
s AS (SELECT DISTINCT c, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM c WHERE len(w) > 0),
n AS (SELECT c, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.c AS a, b.c AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.c < b.c GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT c, c FROM c UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS c, min(b) AS class_id FROM reach GROUP BY 1),
named AS (SELECT c, CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') END AS k FROM c),
of_doc AS (SELECT w.doc_id, coalesce(min(c.c), w.doc_id) AS c FROM w LEFT JOIN (SELECT c.c, CASE WHEN len(c.w) > 0 THEN 'w' || array_to_string(c.w, ' ') ELSE 't' || d.text END AS k FROM c JOIN documents d ON d.doc_id = c.c) c
  ON w.text IS NOT NULL AND c.k = CASE WHEN len(w.w) > 0 THEN 'w' || array_to_string(w.w, ' ') ELSE 't' || w.text END GROUP BY 1)
SELECT doc_id, coalesce(class_id, of_doc.c) AS class_id, coalesce(class_id, of_doc.c) = doc_id AS kept FROM of_doc LEFT JOIN least ON least.c = of_doc.c
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 9], ' ') for i in range(1, len(w) - 8)] END) AS s, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, k, unnest([{{'i': i, 's': array_to_string(w[i:i + k - 1], ' ')}} for i in range(1, len(w) - k + 2)]) AS x FROM d, k WHERE len(w) >= k),
o AS (SELECT DISTINCT doc_id, p.k, x.i AS i, item_id FROM p JOIN q ON q.k = p.k AND q.s = x.s),
h AS (SELECT doc_id, count(DISTINCT t) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS t FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_near_dedup": _NEAR, "op8_benchmark_decontamination": _LEAKS, "op1_embedding_near_dedup": _LINKS, "op2_line_dedup": _LINES, "op7_warc": _WARC}
