"""Corpus cleaning: the stages in order, each over all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, which may have further
columns of any names; the last returns the doc_id and token digests. A null text is an empty one to every stage and
stays null until the last. Stages keep every row but those they reject: toxic documents, later members of a
near-duplicate group, documents that contain a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.llm import bpe, decontaminate, linededup, simhash, toxicity
from sigloom.llm.common import neutral, stored, table


def toxicity_stage(spark, docs, sf_dir):
    """Drops the documents that the classifier chain, trained on the labelled ones, calls toxic."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, chain)


def line_dedup_stage(spark, docs, sf_dir):
    """Deletes the runs of words and the whole lines that occurred before, by the rule of op8.

    A document stays even if nothing is left of its text.
    """
    plain, name, back = neutral(docs)
    found = linededup.drop_repeated_lines(plain, name["doc_id"], name["text"])
    if "n_chars" in name:
        found = found.withColumn(name["n_chars"], F.length(name["text"]).cast("long"))
    return back(found)


def near_dedup_stage(spark, docs, sf_dir):
    """Keeps the document with the smallest doc_id of each near-duplicate group.

    Groups are those of op1: fingerprints of 3-word shingles within 2 bits. Looser copies (most pairs with a 5-word
    Jaccard similarity of 0.8 or more differ in 3 to 11 bits) all stay.
    """
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Drops the documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark, docs, sf_dir):
    """Encodes the texts that are left, and decodes them again."""
    return bpe.add_tokens(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Several stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"stage-{name}")
    return docs
