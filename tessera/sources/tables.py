"""Sources and sinks: delimited files, record tables, truth lists, links, vectors, caches and job steps."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("tessera")
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated file with a header and without quoting: all text, an empty field an empty text."""
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return raw.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields])


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def cached_parquet(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and stored first if it has no success marker."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_shards(spark: SparkSession, pattern: str, keys: list[str]) -> DataFrame:
    """Shards of one table; of several values for a key the first, in order of the shards' names, that is neither null nor NaN nor infinite."""
    df = spark.read.parquet(pattern).withColumn("shard_", F.col("_metadata.file_path"))

    def first(f: T.StructField) -> Column:
        c = F.col(f.name)
        good = c.isNotNull()
        if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
            good = good & ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.min_by(c, F.when(good, F.col("shard_"))).alias(f.name)

    return df.groupBy(*keys).agg(*[first(f) for f in df.schema.fields if f.name not in {*keys, "shard_"}])


def union_sources(**sources: DataFrame) -> DataFrame:
    """Tables one below the other, with the name of each in ``src``."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("src", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def source_of(entity_id: Column) -> Column:
    """The source a record's id names: what stands before the first hyphen."""
    return F.substring_index(entity_id, "-", 1)


def explode_truth(truth: DataFrame, entity: str = "source1_entity_id", matches: str = "matched_entity_ids") -> DataFrame:
    """(entity, record) of a table with comma-joined record ids; an entity without any gives no row."""
    return truth.select(F.col(entity).alias("entity"), F.explode(F.split(matches, ",")).alias("record")).filter("record != ''")


def owners(records: DataFrame, pairs: DataFrame, key: str = "record") -> DataFrame:
    """Every record with the entity that owns it, or null."""
    return records.join(pairs.select(F.col("record").alias(key), F.col("entity").alias("owner")), key, "left")


def joined_ids(entities: DataFrame, pairs: DataFrame, entity: str = "entity", record: str = "record") -> DataFrame:
    """(entity, ids) for every entity: its record ids sorted and joined by commas, or an empty text."""
    lists = pairs.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set(F.col(record).cast("string"))), ",").alias("ids"))
    return entities.select(entity).join(lists, entity, "left").select(entity, F.coalesce("ids", F.lit("")).alias("ids"))


def write_links(links: DataFrame, path: str, order: str | None = None, columns: tuple[str, str] = ("source1_entity_id", "matched_entity_ids"), one_file: bool = False) -> None:
    """Delimited files with a header, in the order of a column that isn't written; the names of the files are in that order too.

    Every task writes its range of the order. ``one_file`` puts all through one task, for readers that want a single file.
    """
    df = links.orderBy(order) if order else links
    cols = [c for c in links.columns if c != order]
    df = df.select(*[F.col(c).alias(n) for c, n in zip(cols, columns, strict=True)])
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def validate_links(links: DataFrame, entities: DataFrame, records: DataFrame, entity: str = "entity", ids: str = "ids") -> DataFrame:
    """(problem, n): unknown or missing entities, entities given twice, unknown records, records given to several entities."""
    pairs = links.select(F.col(entity), F.explode(F.split(ids, ",")).alias("record")).filter("record != ''")
    known = records.select(F.col("record").cast("string"))

    def n(df: DataFrame, problem: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")

    return (
        n(links.join(entities, entity, "left_anti"), "unknown entity")
        .union(n(entities.join(links, entity, "left_anti"), "missing entity"))
        .union(n(links.groupBy(entity).count().filter("count > 1"), "entity twice"))
        .union(n(pairs.join(known, "record", "left_anti"), "unknown record"))
        .union(n(pairs.groupBy("record").count().filter("count > 1"), "record of several entities"))
    )


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same ones at every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, rows: Iterable[dict], path: str) -> None:
    """A small result, such as a profile, as one JSON file of whatever file system the path names."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(list(rows), indent=1, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def alias_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table under another name."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def concat_stores(*stores: DataFrame) -> DataFrame:
    """Stores of arrays (tokens, vectors) one below the other."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out


class Steps:
    """Named steps that are skipped once their output has a success marker."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def run(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        done = exists(self.spark, f"{path}/_SUCCESS")
        log.info("%s: %s", name, "there already" if done else "running")
        return cached_parquet(self.spark, path, build)


def unseen_values(df: DataFrame, seen: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that another table hasn't."""
    return df.select(column).distinct().join(seen.select(column).distinct(), column, "left_anti")


def resolve_values(spec: str, every: list[str], unseen: list[str]) -> list[str]:
    """The values a specification names: ``all``, ``unlabelled`` (those without labels) or a comma-joined list."""
    if spec == "all":
        return every
    return unseen if spec == "unlabelled" else [x for x in spec.split(",") if x]
