"""Writers: projected CSV / Parquet, banded raster tables, append-only ledgers, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_rank


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly the listed fields: extras are dropped, missing ones are NULL."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    project(df, fields).write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def write_raster(df: DataFrame, path: str, row: str = "row", column: str = "col", band_rows: int = 256,
                 mode: str = "errorifexists") -> None:
    """Parquet partitioned by row band and sorted, so windows skip folders and row groups."""
    banded = df.withColumn("row_band", F.floor(F.col(row) / band_rows).cast("int"))
    spread = banded.repartitionByRange("row_band", row, column).sortWithinPartitions("row_band", row, column)
    spread.write.mode(mode).partitionBy("row_band").parquet(path)


def ledger_rows(runs: DataFrame, start: int, order: str, stamp=None) -> DataFrame:
    """New ledger rows with ids freeze-0001... by the order column; ties go by the other columns."""
    ranked = global_rank(runs, [order, *[c for c in runs.columns if c != order]], out="_number")
    at = F.current_timestamp() if stamp is None else F.lit(stamp).cast("timestamp")
    number = F.col("_number") + (start - 1)
    return ranked.withColumn("run_id", F.format_string("freeze-%04d", number)).withColumn("timestamp_utc", at).drop("_number")


def sample_rows(df: DataFrame, order: list, n: int = 200_000) -> DataFrame:
    """First n rows in a stated order: a distributed top-n."""
    return df.orderBy(*order).limit(n)
