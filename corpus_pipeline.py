"""Documents to training sequences: each stage reads what the one before it wrote.

1. toxicity: documents that the classifier rejects go; it learns from labels of rows that are not held out.
2. line dedup: later repeated runs of lines go; a document that they leave empty goes with them.
3. n-gram Jaccard join: of each group of near-equal documents the smallest id stays, once.
4. benchmark decontamination: documents with a benchmark window go.
5. packing: the rest in sequences of at most 2048 tokens, with one mixture of sources throughout.

Each text is decided on by itself, also if several texts share an id.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crosspanel.llm import decontamination, jaccard, lines, packing, toxicity  # noqa: E402
from crosspanel.llm.base import table  # noqa: E402
from crosspanel.session import release, stage, staged  # noqa: E402

# a score from here on rejects a document
TOXIC_SCORE = 0.5
# decisions by document that are broadcast at most, some 30 bytes each
BROADCAST_DECISIONS = 1_000_000


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _at() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__doc")) & (_version() == F.col("__version"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose id and text, by its hash, are not in `gone` (__doc, __version); rows without an id go by their text."""
    gone = stage(gone.distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_DECISIONS else gone
    return docs.join(gone, _at(), "left_anti")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose whole text scores as toxic.

    Each row is judged by its own text. The classifier learns from the documents
    of this stage's input and the labels table; documents of one id share a
    verdict only if their texts are equal. A row without an id is judged too.
    """
    model = toxicity.train(docs, toxicity.open_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs.withColumn("__key", F.struct("doc_id", _version().alias("version"))), model, "__key")
    bad = scored.where(F.col("score") >= TOXIC_SCORE).select(F.col("__key.doc_id").alias("__doc"), F.col("__key.version").alias("__version"))
    return _without(docs, bad)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeated runs of lines; n_chars follows the text. Emptied documents go, documents empty before stay."""
    out = lines.remove_runs(docs)
    blank = F.coalesce(F.trim(F.regexp_replace("text", "\\s", "")), F.lit("")) == ""
    out = out.where(~((F.col("n_removed") > 0) & blank))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest id.

    Of linked texts with one id, that with the smaller hash stays, of rows equal
    in id and text the one smallest in its other columns. Texts without words
    and rows without an id are linked with nothing and all stay.
    """
    found = stage(jaccard.link_sets(jaccard.keyed(docs.where(F.col("doc_id").isNotNull()))).where(F.col("n_shingles") > 0))
    named = found.withColumnsRenamed({"doc": "__doc", "version": "__version"})
    kept = _without(docs, named.where((F.col("root") != F.col("__doc")) | (F.col("root_version") != F.col("__version"))).select("__doc", "__version"))
    again = stage(named.groupBy("__doc", "__version").count().where(F.col("count") > 1).select("__doc", "__version"))
    if again.isEmpty():
        return kept
    rows = kept.join(again, _at(), "left_semi")
    one = rows.groupBy("doc_id", _version().alias("__version")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
    return _without(kept, again).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs, with or without an id; null texts have none."""
    found = decontamination.mark_windows(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(F.size("hits") > 0).select(F.col("doc_id").alias("__doc"), _version().alias("__version")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left; null texts and ids, repeated rows and an empty table as in `packing.pack`."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# a classifier and a tokenizer are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again.

    Once a stage's result is written, tables staged on the way to it are deleted.
    """
    since = staged(spark)
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        release(spark, since, keep_last=True)
    return docs
