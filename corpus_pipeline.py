"""A corpus pipeline over documents: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a frame with the columns of
docs, the last one the encoded documents. Stages other than the last keep
clean documents as they came.

Defined results, of every stage: null and empty texts pass all stages and have
no ids; a null doc_id is an id of its own, larger than all others; rows that
repeat doc_id and text are kept or dropped alike, near duplicates among them
too; of copies the document of the smallest id stays; a score, similarity or
count that is a threshold exactly counts as reaching it; texts of any length
are read whole; columns beside doc_id and text are unchanged, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdance.llm import decontamination, line_templates, near_duplicates, piece_codec, toxicity
from verdance.llm.common import remove, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labelled
    documents of sf_dir, doesn't reject."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and recurring runs of lines stay in the
    first of their documents only; a document that consists of such alone goes. A
    near copy as a whole stays as it is: the next stage judges it."""
    return line_templates.without_recurring(docs, drop_emptied=True, with_runs=True, keep_copies=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near
    duplicates: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return near_duplicates.one_of_each(docs, n=5, similarity=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of the documents left."""
    return piece_codec.digests(piece_codec.encode_and_decode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_templates", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("piece_codec", encode),
]
#: SQL can't express the classifier and the encoding; tests hold every stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
