"""A corpus pipeline: documents to tokens, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept, and returns a DataFrame;
all but the last return the columns of ``documents`` as they came. Rejected documents go; the others stay unchanged.

Every stage takes an empty table (and gives one), texts of any length, extra columns, and columns that have the names of
an operator's own (``score``, ``kept``, ``key`` ...): they stay as they are. What else is odd is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm import bpe, decontam, langid, neardup, toxicity
from screenloom.llm.common import settle, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity score that rejects.

    Null and empty texts, and all texts where no model can be learned (no labels, or of one class), score 0 and stay.
    Equal rows score alike; a score of exactly the limit goes. A null id doesn't matter.
    """
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, docs) < toxicity.REJECT)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose cross-entropy is usual for the language found.

    Texts without a letter (null, empty, blank, numbers) are in no known language and go. Where no row has a language
    there is nothing to judge by, and all rows stay. Equal rows are judged alike; null ids and languages don't matter.
    """
    small_batches(spark)
    model = langid.fit(docs)
    return docs if model is None else docs.where(langid.predict(model, docs)["accepted"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id (of one id, the text with the least hash).

    Five-word shingles and a similarity of 0.8, as holds where no contract says otherwise (``op3`` has four words by its
    contract). Empty texts are like nothing and stay; of rows equal in id and text one stays; rows with a null id stay.
    """
    small_batches(spark)
    return neardup.deduplicated(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; null and empty items are held by none; equal rows are judged alike.
    """
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that is left: ``doc_id``, ``n_tokens``, ``ids``.

    A null text is an empty one and has no tokens; equal rows are encoded each; a null id stays null.
    """
    small_batches(spark)
    encoded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), decode=False)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL has no way to express the models of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
