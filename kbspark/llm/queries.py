"""The registered queries of the operators: each over its whole tables, with the parameters for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, decontam, exact_dedup, fill_middle, html_text, langid, licenses, sharding, simhash, topk, toxicity, turns, warc
from kbspark.llm.shared import unused


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _remainder(key: str, n: int):
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = with_language(docs.select("doc_id", "text"), docs)
    return rows.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, learn_from: DataFrame, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with language and score, learned from the rows of learn_from that are not held out."""
    languages, prototypes = langid.learn(learn_from, _remainder("doc_id", 5) != 0)
    return langid.predict(docs, languages, prototypes, into=into)


def in_a_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in one of the languages learned from docs, as far as its length tells."""
    may_learn = _remainder("doc_id", 5) != 0
    languages, prototypes = langid.learn(docs, may_learn)
    floors = langid.floors(docs, may_learn, languages, prototypes)
    lang, score, size = (unused(docs, c) for c in ("_kb_lang", "_kb_score", "_kb_size"))
    rows = langid.predict(docs, languages, prototypes, into=(lang, score), size=size)
    return rows.where((F.col(lang) != langid.UNKNOWN) & langid.in_a_language(score, size, floors)).select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"start": "start_at", "end": "end_at"})


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, _read(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    codec = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = docs.select("doc_id", codec.round_trip(F.col("text")).alias("_own"))
    return both.select("doc_id", bpe.token_count(F.col("_own.ids")).alias("n_tokens"), F.sha2("_own.ids", 256).alias("ids_sha256"), F.sha2("_own.decoded", 256).alias("decoded_sha256"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", html_text.extract_main_text(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = with_toxicity(spark, docs.select("doc_id", "text"), sf_dir, docs, average="average_score")
    score = F.col("toxic_score")
    return rows.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), "average_score")


def with_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, learn_from: DataFrame, into: str = "toxic_score", average: str | None = None) -> DataFrame:
    """docs with a score, learned from the labelled rows of learn_from that are not held out."""
    model = toxicity.fit_labelled(learn_from, _read(spark, sf_dir, "labels"), _remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model, into=into, average=average)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_read(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    # floor() of a double is a long in Spark, which NaN and infinity can't be: those vectors go before
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) < 2.0**54, F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))
    rows = rows.select("vec_id", F.when(finite, whole).alias("embedding"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(_read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    return turns.with_digests(rows, turns.plans(rows)).withColumnRenamed("conv", "conv_id")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    made = docs.select("doc_id", fill_middle.fill_in_middle(F.col("text"), F.col("doc_id")).alias("made"))
    back = made.select("doc_id", "made", fill_middle.restore(F.col("made.output"), F.col("made.form")).alias("back"))
    return back.select("doc_id", "made.n", "made.form", "made.prefix_chars", "made.middle_chars", "made.output_sha256", F.col("back.text_sha256").alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_language_id, op3_decontamination, op4_byte_bpe, op5_main_text, op6_toxicity, op7_warc, op8_simhash, op9_topk, op10_sharding, op11_conversation_repair, op12_exact_dedup, op13_fill_in_middle)}

ORACLES = {
    "op7_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM r""",
    "op9_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op11_conversation_repair": """
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- CRC-32 bit by bit: the generator polynomial reversed, over the bytes of the key
h AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([ord(k[i]) FOR i IN range(1, length(k) + 1)],
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295)) % 20 AS hit FROM d),
r AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE hit > 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM r),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS a, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before,
         CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS t FROM o)),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM f GROUP BY 1),
-- (cost, audit, repaired rows) of the best way into each state: q nothing yet, s, u, a; b1 and so on after inserts
p AS (
  SELECT conv_id, 0::BIGINT AS i, (0, '', []::VARCHAR[]) AS q, (1000000000, '', []::VARCHAR[]) AS s, (1000000000, '', []::VARCHAR[]) AS u, (1000000000, '', []::VARCHAR[]) AS v FROM n
  UNION ALL
  SELECT conv_id, i, (q[1] + 4, q[2] || 'D', q[3]),
         least((s[1] + 4, s[2] || 'D', s[3]), (CASE WHEN a = 's' THEN q[1] + keep ELSE 1000000000 END, q[2] || 'K', list_append(q[3], role || ':' || text))),
         least((u2[1] + 4, u2[2] || 'D', u2[3]),
           (CASE WHEN a = 'u' THEN q[1] + keep ELSE 1000000000 END, q[2] || 'K', list_append(q[3], role || ':' || text)), (q[1] + keep + 3, q[2] || 'R', list_append(q[3], 'user:' || text)),
           (CASE WHEN a = 'u' THEN s[1] + keep ELSE 1000000000 END, s[2] || 'K', list_append(s[3], role || ':' || text)), (s[1] + keep + 3, s[2] || 'R', list_append(s[3], 'user:' || text)),
           (CASE WHEN a = 'u' THEN v2[1] + keep ELSE 1000000000 END, v2[2] || 'K', list_append(v2[3], role || ':' || text)), (v2[1] + keep + 3, v2[2] || 'R', list_append(v2[3], 'user:' || text))),
         least((v2[1] + 4, v2[2] || 'D', v2[3]),
           (CASE WHEN a = 'a' THEN u2[1] + keep ELSE 1000000000 END, u2[2] || 'K', list_append(u2[3], role || ':' || text)), (u2[1] + keep + 3, u2[2] || 'R', list_append(u2[3], 'assistant:' || text)))
  FROM (
    SELECT *, least(v, (u1[1] + 3, u1[2] || 'I', list_append(u1[3], 'assistant:'))) AS v2,
           least(u1, (v1[1] + 3, v1[2] || 'I', list_append(v1[3], 'user:'))) AS u2 FROM (
      SELECT p.conv_id, f.i, q, s, u, v, f.a, f.role, f.text, CASE WHEN f.fault IN ('b', 'd') THEN 1000000000 WHEN f.fault = 't' THEN 3 ELSE 0 END AS keep,
             least(u, (q[1] + 3, q[2] || 'I', list_append(q[3], 'user:')), (s[1] + 3, s[2] || 'I', list_append(s[3], 'user:')), (v[1] + 3, v[2] || 'I', list_append(v[3], 'user:'))) AS u1,
             least(v, (u[1] + 3, u[2] || 'I', list_append(u[3], 'assistant:'))) AS v1
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))),
e AS (
  SELECT p.conv_id, least(q, v, (u[1] + 3, u[2] || 'I', list_append(u[3], 'assistant:')), (s[1] + 6, s[2] || 'II', list_append(list_append(s[3], 'user:'), 'assistant:'))) AS best
  FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = n.size)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(array_to_string(best[3], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_exact_dedup": """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
g AS (
  SELECT doc_id, body, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS n, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(body) AS text_sha256 FROM g""",
    "op13_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l FROM documents),
c AS (
  SELECT doc_id, t, l, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, n, form, array_to_string(l[1:least(x, y)], '') AS pre, array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(l[greatest(x, y) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p""",
}
