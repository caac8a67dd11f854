"""Ratings files: delimited raw text, header CSV, named datasets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingloom.schema import DATASET_FOLDERS, RATINGS_CSV_COLUMNS, RAW_RATINGS


def canonical_ratings(
    df: DataFrame, user: str = "userId", item: str = "itemId", rating: str = "rating", dedupe: bool = True
) -> DataFrame:
    """Bring any ratings table to ``userId, itemId, rating``, one row per user and item.

    The largest rating wins among duplicates. The aggregate combines on the map side, so a
    table without duplicates costs one shuffle and a user with most of the rows no hot task.
    """
    ratings = df.select(
        F.col(user).cast("bigint").alias("userId"),
        F.col(item).cast("bigint").alias("itemId"),
        F.col(rating).cast("double").alias("rating"),
    )
    if not dedupe:
        return ratings
    return ratings.groupBy("userId", "itemId").agg(F.max("rating").alias("rating"))


def read_ratings_csv(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """Header CSV, columns by name in any order and no inference pass.

    A header that lacks a column, files whose headers differ, and lines that do not fit are errors.
    """
    kinds = dict(zip(RATINGS_CSV_COLUMNS, [T.LongType(), T.LongType(), T.DoubleType(), T.LongType()]))
    header = spark.read.csv(path, header=True).columns
    lacking = [name for name in RATINGS_CSV_COLUMNS[:3] if name not in header]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    schema = T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in header])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")
    return canonical_ratings(rows, item="movieId", dedupe=dedupe)


def dataset_path(name: str, base_dir: str = "./data") -> str:
    if name not in DATASET_FOLDERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASET_FOLDERS)}")
    return f"{base_dir.rstrip('/')}/{DATASET_FOLDERS[name]}/ratings.csv"


def load_ratings(spark: SparkSession, name: str, base_dir: str = "./data") -> DataFrame:
    """Ratings of a named dataset. A missing path raises Spark's own PATH_NOT_FOUND."""
    return read_ratings_csv(spark, dataset_path(name, base_dir))


def read_ratings_dat(spark: SparkSession, path: str) -> DataFrame:
    """Raw ``user::item::rating::time`` lines; a line that does not fit is an error."""
    return spark.read.csv(path, sep="::", schema=RAW_RATINGS, mode="FAILFAST")


def quarantine_dat(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Raw lines as two tables below ``out``: those that fit, and the text of those that do not.

    Both are written in one pass over the files. ``read_ratings_dat`` fails instead.
    """
    bad = "bad_line"
    schema = T.StructType([*RAW_RATINGS.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.csv(path, sep="::", schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    lines.withColumn("rejected", F.col(bad).isNotNull()).write.partitionBy("rejected").parquet(out)
    schema = T.StructType([*schema.fields, T.StructField("rejected", T.BooleanType())])
    written = spark.read.schema(schema).parquet(out)
    return written.where("NOT rejected").select(*RAW_RATINGS.fieldNames()), written.where("rejected").select(bad)


def csv_columns(raw: DataFrame) -> DataFrame:
    renamed: list[Column] = [F.col(f.name).alias(c) for f, c in zip(RAW_RATINGS.fields, RATINGS_CSV_COLUMNS)]
    return raw.select(*renamed)


def convert_dat(spark: SparkSession, dat_path: str, out_path: str, mode: str = "errorifexists") -> None:
    """Rewrite raw lines as header CSV, split by split and without a shuffle."""
    csv_columns(read_ratings_dat(spark, dat_path)).write.mode(mode).csv(out_path, header=True)


def convert_all(spark: SparkSession, base_dir: str = "./data") -> list[str]:
    """Convert every named dataset that has a raw file; return the names converted."""
    done = []
    for name, folder in DATASET_FOLDERS.items():
        source = f"{base_dir.rstrip('/')}/{folder}/ratings.dat"
        try:
            convert_dat(spark, source, dataset_path(name, base_dir))
        except AnalysisException as error:
            # Only a missing raw file is skipped; an existing target is an error to report.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            done.append(name)
    return done
