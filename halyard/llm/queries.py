"""The queries opN_<name> and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import ann, chat, langid, linededup, mixing, packing, quality, simhash, topk, toxicity
from halyard.llm.terms import held_out
from halyard.llm.tokens import public
from halyard.llm.workers import small_batches, spread
from halyard.session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, to be sent to Python in small batches."""
    small_batches(spark)
    return spread(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: see ``toxicity``."""
    docs = _documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: see ``mixing.plan``."""
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, quality_score, keep (1 from 0.5 on). See ``quality``."""
    docs = _documents(spark, sf_dir)
    found = quality.score(docs, quality.fit(docs))
    return found.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).cast("int").alias("keep"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and conversation -1, read back: see ``chat``."""
    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.windows(rows, public("byte_bpe_50k.json"), budget=1024, history=2, ranks=public("byte_bpe_50k.tiktoken")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products for every 20th vector: see ``topk``."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


def packed(docs: DataFrame) -> DataFrame:
    """All documents in sequences of 1024 tokens: a row a piece, its ids as a digest."""
    found = packing.pieces(docs, public("byte_bpe_50k.json"), capacity=1024, end_id=2, ranks=public("byte_bpe_50k.tiktoken"))
    digest = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, capacity=1024)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents: see ``packing``."""
    return packed(_documents(spark, sf_dir))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine for every 50th vector: see ``ann``."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: see ``simhash.groups``."""
    found = simhash.groups(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every line of every document: see ``linededup.classes``."""
    return linededup.classes(_documents(spark, sf_dir), max_edits=2, per_edit=16)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: see ``langid``."""
    docs = _documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_quality, op4_chat, op5_topk, op6_packing, op7_ann, op8_simhash, op9_linededup, op10_langid)}


OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('42:', coalesce(doc_id::VARCHAR, ''))) AS draw
  FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS n,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * n / w AS ratio,
         (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
lvl AS (SELECT coalesce(arg_min(level, ratio) FILTER (ratio > level), 'infinity'::DOUBLE) AS level FROM ranked),
share AS (
  SELECT source, n::BIGINT AS source_size, least(3 * n, lvl.level * w) AS target,
         floor(least(3 * n, lvl.level * w) + 0.5)::BIGINT AS words
  FROM ranked, lvl),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest
  FROM share),
run AS (
  SELECT sized.*, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM run JOIN passes ON run.source IS NOT DISTINCT FROM passes.source
"""


OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op5_topk": OP5}
