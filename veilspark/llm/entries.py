"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import SubstringDedup

    out = SubstringDedup().run(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import LanguageModel

    return LanguageModel().score(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import SourceMixer

    return SourceMixer().report(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import ChatFormatter, read_loss, read_turns, text_part

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    messages = rows.unionByName(extra).withColumn("content", text_part(F.col("text")))
    out = ChatFormatter().format(messages)
    turns = read_turns(F.col("formatted"))
    back = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), back.alias("back"), read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss")).alias("learned"), "formatted")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("back", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?MEDIA\]|PART\])', '\1\\\2\3', 'g') AS body,
         regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?MEDIA\]|PART\])', '\1\\\2\3', 'g') AS head
  FROM m
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + length(head) + length('<s>[INST][/INST]</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import Packer

    return Packer(word_tokenizer()).pack(table(spark, sf_dir, "documents"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import WarcWriter

    pages = table(spark, sf_dir, "pages")
    return WarcWriter().write(pages).read(pages)


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearcopies import NearCopies

    return NearCopies().join(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import QualityClassifier, held_out, training_labels

    docs = table(spark, sf_dir, "documents")
    classifier = QualityClassifier()
    model = classifier.train(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import load, store

    return load(store(table(spark, sf_dir, "documents")), tensors=True)


def op10_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import ProjectionSearch

    return ProjectionSearch().search(table(spark, sf_dir, "embeddings"), every=20)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import Decontaminator

    found = Decontaminator().report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS number, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, w[s + 1 : s + least(len(w), 10)] AS gram FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)
), k AS (SELECT DISTINCT len(gram) AS k FROM g),
h AS (
  SELECT number, s, k, item_id
  FROM (SELECT number, s, k, w[s + 1 : s + k] AS said FROM (SELECT number, w, k, unnest(range(len(w) - k + 1)) AS s FROM d, k)) JOIN g ON said = gram
), c AS (SELECT number, count(DISTINCT p) AS n_hit FROM (SELECT number, unnest(range(s, s + k)) AS p FROM h) GROUP BY number),
n AS (SELECT number, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT number, CAST(item_id AS VARCHAR) AS name FROM h WHERE item_id IS NOT NULL) GROUP BY number)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (number) LEFT JOIN n USING (number)
"""


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import Aligner

    return Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import PeriodicRuns, planted, report

    return report(PeriodicRuns().run(table(spark, sf_dir, "documents"), planted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import mixing

    return {"op3_mix_sources": mixing.SQL, "op4_chat_format": OP4_SQL, "op6_warc_index": OP6_SQL, "op11_decontaminate": OP11_SQL}
