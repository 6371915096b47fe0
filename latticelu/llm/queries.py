"""The registered queries of the corpus operators, thin over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmlex, langid, media, packing, sharding, simhash, urlfilter, warc
from .common import read

#: URL rules of op6, as the contract gives them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The conversation that op9 adds.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.shuffle_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    text = F.col("text")
    return written.select(
        "doc_id",
        sharding.record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def url_model(spark: SparkSession, sf_dir: str, labelled_rows: int = 20_000) -> urlfilter.UrlModel:
    """Words of all `documents`; class counts from those whose toxic label is among the `labelled_rows` of least hashed id."""
    labels = read(spark, sf_dir, "labels").filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("label"))
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(labelled_rows)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return urlfilter.fit(docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.filter_urls(read(spark, sf_dir, "pages"), RULES, url_model(spark, sf_dir))
    return found.select("page_id", "host", "path", "rule", "verdict", "score", F.array_join("tokens", " ").alias("tokens"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("response.kind").alias("record_type"), F.col("refers_page").alias("refers_to"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(media.to_media(read(spark, sf_dir, "documents")))
    return media.features(stored)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(chat.expand(rows.unionByName(extra)))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlex.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_best_fit_packing, op2_sharding, op3_simhash, op4_language_id, op5_decontamination, op6_url_filter, op7_warc, op8_media, op9_chat, op10_html, pipeline)
    return {f.__name__: f for f in own}


# base32 by groups of twenty bits: five hex digits are four letters
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, (1 + (k // 4) * 5)::BIGINT, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN k = 1 OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 AND page_id IS NOT NULL THEN first END AS refers_to
FROM d"""

_ESCAPED = "length(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'))"
OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (SELECT *, 24 + {_ESCAPED.format("replace(role, chr(10), 'nn')")} + {_ESCAPED.format("text")} AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far, max(k) OVER (PARTITION BY conv_id) AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
             coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, count(*) FILTER (role = 'assistant') AS n_examples,
             sum(chars) AS chars, sum(so_far) FILTER (role = 'assistant' OR k = n) AS example_chars
      FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, n_examples, example_chars::BIGINT AS example_chars FROM g"""


def oracle_sql() -> dict[str, str]:
    """The rest has no SQL form (tokenisers, seeded shuffles, vote fingerprints, models, spectra, markup)."""
    return {"op7_warc": OP7_SQL.strip(), "op9_chat": OP9_SQL.strip()}
