"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. :func:`run` writes each result as Parquet and reads it back for the
next. Counted as part of ``quillspark.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language, mixture, near_dups, queries, token_files
from quillspark.llm.store import table, written
from quillspark.runtime import ship

#: Share of the tokens that reach the mixture which is kept, at most one epoch of each source.
SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, drop_ambiguous: bool = True) -> DataFrame:
    """Learns from the labelled two thirds, names every document's language anew, and drops
    those without letters (null and empty texts among them) and those it finds ambiguous.
    Repeated rows are judged one by one; without labelled rows no language is known and all go."""
    ship(spark)
    own = docs.toDF(*(f"own_{k}" for k in range(len(docs.columns))))
    place = {name: f"own_{k}" for k, name in enumerate(docs.columns)}
    found = language.predict(own, queries.language_model(docs), text_col=place["text"]).where(F.col("lang_pred") != language.UNKNOWN)
    if drop_ambiguous:
        found = found.where(~F.col("lang_ambiguous"))
    return found.select(*(F.col("lang_pred" if name == "lang" else o).alias(name) for name, o in place.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five-word shingles, likeness of 0.8 or more).

    Texts without words are in no group. Rows that share an id are one document, whatever their
    texts; the row with the least text stays (null first). Rows with a null id all stay.
    """
    ship(spark)
    found = near_dups.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    kept = written(found.groupBy("kept_id").agg(F.count("*").alias("rows")), "kept")
    # Positions, as names may repeat those used here.
    own = docs.toDF(*(f"own_{k}" for k in range(len(docs.columns))))
    key, text = (F.col(f"own_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    out = own.join(kept.select("kept_id"), key.eqNullSafe(F.col("kept_id")), "left_semi")
    again = kept.where("rows > 1 AND kept_id IS NOT NULL").select("kept_id")
    if not again.isEmpty():
        several = out.join(again, key == F.col("kept_id"), "left_semi")
        least = F.min_by(F.struct(*own.columns), F.struct(text.isNotNull(), text))
        one = several.groupBy(key).agg(least.alias("row")).select("row.*")
        out = out.join(again, key == F.col("kept_id"), "left_anti").unionByName(one)
    return out.toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; shorter benchmark passages are cut out of the others. Texts
    without hits, null and empty ones among them, stay as they are; repeated rows are judged one
    by one."""
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), remove="both")


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the mixture's token budgets. Rows with a null id or without words are not
    taken; rows that share an id are chosen one by one."""
    ship(spark)
    return mixture.mixed(docs, queries.mixture_levels(), queries.MIXTURE_WEIGHTS, SHARE, max_epochs=1)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32. Null and empty
    texts have the end id alone; rows that share an id follow one another by text; rows with a
    null id are left out."""
    ship(spark)
    return token_files.token_files(docs, queries.tokenizer_path()).withColumnRenamed("value", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
    ("token_output", token_output),
]

#: The first, fourth and fifth stage can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
