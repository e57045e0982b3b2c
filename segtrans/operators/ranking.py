"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import PACKED, new_work_dir, with_int

# A window sorts one group in one task; beyond this many rows the group is split.
GROUP_ROWS = 2_000_000


def large_groups(df: DataFrame, group: list[str], rows: int = GROUP_ROWS,
                 weight: Column | None = None) -> DataFrame | None:
    """``(group, n_rows)`` of the groups over the limit, or None if there are none.

    Reads the group columns only and counts before the shuffle. There are fewer
    than (all rows / limit) such groups, so 500,000 short rows at 10**12: small
    enough to broadcast, which is what the callers do with it. ``weight`` is for
    rows that each stand for several.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(*group).agg(size.alias("n_rows")).where(F.col("n_rows") > rows)
    if sizes.isEmpty():
        return None
    # Written, because several joins will ask for it.
    path = new_work_dir(df.sparkSession, "large-groups")
    sizes.write.parquet(path)
    return df.sparkSession.read.schema(sizes.schema).parquet(path)


def _row_number(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window) - 1)


def _split_row_number(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """Row numbers where one group may be larger than any task.

    The rows are ranged by group and order, so a large group lies across many
    partitions, each a contiguous stretch of it. They are written with the
    number of their stretch (range bounds are sampled, and must not be drawn a
    second time). A row's number is then its number in the stretch plus the rows
    of the stretches before, and the latter are a table of one row per stretch.
    """
    spark = df.sparkSession
    path = new_work_dir(spark, "stretches")
    key = [F.col(g) for g in group]
    (
        df.repartitionByRange(*key, *order)
        .withColumn("_stretch", F.spark_partition_id())
        .write.option("compression", PACKED).parquet(path)
    )
    ranged = spark.read.schema(with_int(df.schema, "_stretch")).parquet(path)
    before = (
        ranged.groupBy(*group, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                Window.partitionBy(*group).orderBy("_stretch")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ) - F.col("_n"),
        )
        .drop("_n")
    )
    local = _row_number(ranged, [*group, "_stretch"], order, "_local")
    return (
        local.join(before, [*group, "_stretch"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("int"))
        .select(*df.columns, out)
    )


def number_rows(df: DataFrame, group: list[str], order: list, out: str,
                large: DataFrame | None = None) -> DataFrame:
    """Add ``out``, the 0-based number of the row in its group.

    ``order`` must be total within a group. Groups named in ``large`` go the
    split way, all others through a plain window; no row is left out.
    """
    if large is None:
        return _row_number(df, group, order, out)
    # Written, because both ways read it; what made it would run twice, with all its shuffles.
    path = new_work_dir(df.sparkSession, "unnumbered")
    df.write.option("compression", PACKED).parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    keys = F.broadcast(large.select(*group))
    usual = _row_number(df.join(keys, group, "left_anti"), group, order, out)
    split = _split_row_number(df.join(keys, group, "left_semi"), group, order, out)
    return usual.unionByName(split.select(*usual.columns))
