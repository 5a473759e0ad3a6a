"""The corpus pipeline: quality rules, shingle join, suffix-array deduplication, secret redaction, packing.

Every stage reads what its predecessor wrote, and all but the last return the columns of ``documents``. Changed texts carry
their new ``n_chars`` where that column exists. Every stage takes an empty table, nulls in any column, rows given several times, texts of any
length, and columns besides those of ``documents``, whatever their names, which it hands on as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality_rules, secrets, shingle_join, suffix_dedup
from tessera.llm.redaction import redact
from tessera.session import remove_paths, scratch, scratch_scope, ship

#: SQL can express neither suffix arrays, tokenizers nor packing; tests/llm compares the stages with plain Python instead.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def _stage(place: int) -> Callable:
    """A stage owns the scratch tables it makes. They go when a later stage of the same folder starts, for that reads what was written of them."""

    def around(fn: Callable) -> Callable:
        @wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            ship(spark)
            _forget(spark, sf_dir, place)
            with scratch_scope() as made:
                out = fn(spark, docs, sf_dir)
            _owned(spark).setdefault((sf_dir, place), []).extend(made)
            return out

        return run_stage

    return around


def _owned(spark: SparkSession) -> dict[tuple[str, int], list[str]]:
    sc = spark.sparkContext
    if not hasattr(sc, "_tessera_stages"):
        sc._tessera_stages = {}
    return sc._tessera_stages


def _forget(spark: SparkSession, sf_dir: str, before: int) -> None:
    """Remove what earlier stages of a folder's run have made."""
    owned = _owned(spark)
    for at in [x for x in owned if x[0] == sf_dir and x[1] < before]:
        remove_paths(spark, owned.pop(at))


@_stage(0)
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; equal rows have equal verdicts; an empty table stays empty."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]  # statistics have names of their own
    kept = quality_rules.quality_rules(docs.toDF(*own), own[names.index("text")]).filter("kept")
    return kept.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])


@_stage(1)
def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id.

    A null id counts as the least: such rows stay, and near copies of them go. Rows that share an id go or stay together; documents without
    words link with nothing and stay; an empty table stays empty.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    d = docs.toDF(*own)
    at = F.col(own[names.index("doc_id")])
    found = shingle_join.shingle_components(d.select(at.alias("doc_id"), F.col(own[names.index("text")]).alias("text")))
    gone = found.filter("doc_id IS NOT NULL AND NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("gone")).distinct()
    return d.join(gone, at == F.col("gone"), "left_anti").select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])


@_stage(2)
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier place has.

    Null and empty texts stay as they are. A null id comes before all others; ties of ids are in order of the text's hash; a row given
    again is one document and loses no more than that; an empty table stays empty.
    """
    return _counted(suffix_dedup.suffix_dedup(docs, digest=False), docs.columns)


@_stage(3)
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind. Null and empty texts stay, equal rows change alike, an empty table stays empty."""
    return _counted(redact(docs, *secrets.default_vocabulary()), docs.columns)


@_stage(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in training sequences.

    A null text is an empty one, a single closing id; rows given again are packed again; pieces of one length are interchangeable;
    an empty table gives no piece. Columns besides doc_id are not carried.
    """
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", keep_quality),
    ("shingle_join", keep_one_of_near),
    ("suffix_dedup", remove_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each stored and read again; what a stage needed goes once its result is stored."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove_paths(spark, last)
        last.append(path)
    _forget(spark, sf_dir, len(STAGES))
    return docs
