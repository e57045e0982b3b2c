"""What several operators of this folder need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir

# White space is the six ASCII characters; everything between is a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared work folder: computed once, safe from lost executors."""
    path = new_work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, not null; splitting is twice as fast as extracting them."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fenced(df: DataFrame) -> DataFrame:
    """``df``, with its columns worked out once, before any filter on them.

    A filter would be pushed into the projections below, and their array
    functions evaluated once for each element that refers to them. Nothing is
    pushed below the output of a generator.
    """
    return df.select(F.inline_outer(F.array(F.struct("*"))))
