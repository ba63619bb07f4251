"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it
as Parquet in the shared folder and reads it again as the next stage's docs.

Defined results of all stages: null and empty texts are texts without words; a null doc_id is less
than all others; very long texts are worked on whole; an empty table gives an empty
table with the same columns; columns other than doc_id, text and source pass through unread,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import materialise
from veilspark.llm.entries import word_tokenizer
from veilspark.llm.mixing import SourceMixer
from veilspark.llm.nearcopies import NearCopies
from veilspark.llm.packing import Packer
from veilspark.llm.quality import QualityClassifier, training_labels
from veilspark.llm.substrings import SubstringDedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A document at the limit (a score of one half, as all have without labels) stays; repeated rows share
    one fate; null and empty texts are scored as texts without words.
    """
    classifier = QualityClassifier()
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep(docs, classifier.train(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least doc_id.

    Documents without words are no copies of each other and stay; of rows equal in doc_id and
    text one stays, any of them.
    """
    return NearCopies().keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the text; a text without any stays as it is.

    Earlier is by doc_id, then by text; a text that is all repeats becomes empty; n_chars follows the text
    where it changed.
    """
    out = SubstringDedup().run(docs, carry=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null source is a source of its own; documents without words take no room and come as often as their place
    in the order says; repeated rows share one fate.
    """
    return SourceMixer().mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of 2048.

    A text without words is its end id alone; only longer texts than a sequence are cut; a document
    that comes twice is packed twice.
    """
    return Packer(word_tokenizer()).pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Neither the classifier nor the join and dedup can be said in SQL on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i + 1}")
    return docs
