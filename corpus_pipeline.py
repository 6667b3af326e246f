"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.llm import chosen_path, decontaminate, line_dedup, line_quality, pieces
from evenkeel.llm.common import table


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules, or with too small a share of content lines, go."""
    return line_quality.keep_good(docs, line_quality.train(docs, table(spark, sf_dir, "labels")))


def shared_lines(spark, docs, sf_dir):
    """A line of ten documents or more stays where it comes first; a document of which no word is left goes."""
    kept = line_dedup.drop_shared_lines(docs, min_docs=10, keep="first", n_chars="n_chars")
    return kept.where(F.btrim(F.coalesce("text", F.lit("")), F.lit(line_dedup.BLANK)) != "")


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of copies and near copies stays."""
    return chosen_path.one_of_each(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents of which a twentieth or more are benchmark passages go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark, docs, sf_dir):
    """The ids of every text."""
    return pieces.encode_texts(docs).select("row.doc_id", "row.lang", "row.source", "row.n_chars", "n_ids", "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", shared_lines), ("near duplicates", near_duplicates),
          ("decontamination", decontaminated), ("sentencepiece", token_ids)]

#: The labelling, the join and the encoding have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each written to the shared folder and read again by the next."""
    from evenkeel.session import cut_lineage

    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
