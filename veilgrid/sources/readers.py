"""Readers: every table gets an explicit schema; only the point reader discovers columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import coerce_double

# Accepted column names of point products, in order of preference.
POINT_ALIASES = {
    "longitude": ["longitude", "lon", "x", "long"],
    "latitude": ["latitude", "lat", "y"],
    "velocity_mm_per_year": [
        "mean_velocity", "velocity", "vel", "up_velocity", "vertical_velocity", "vertical_velocity_mm_year",
        "vertical_velocity_mm_per_year", "mean_velocity_mm_year", "mean_velocity_mm_per_year", "mean_velocity_mm_yr",
        "mean_vel", "v_mean", "v_up", "vu", "ortho_up", "up",
    ],
}
OPTIONAL_ALIASES = {
    "temporal_coherence": ["temporal_coherence", "coherence", "temp_coh"],
    "amplitude_dispersion": ["amplitude_dispersion", "amp_dispersion", "ad"],
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped. Without a schema all columns are text.

    A schema picks columns by header name, in its own order; text that does not fit a type is NULL, and
    a name the header lacks is an error.
    """
    df = spark.read.option("header", True).csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("\ufeff").strip('"'))
    if schema is None:
        return df
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}; the header has {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-document JSON; a top-level array becomes one row per element."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point table by suffix: parquet, pq, csv, txt, csv.gz or gz text."""
    name = path.lower().rstrip("/")
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if name.endswith((".csv", ".txt", ".gz")):
        return read_csv(spark, path)
    raise ValueError(f"unsupported point format: {path}; use parquet, pq, csv, txt or gz")


def normalize_name(name: str) -> str:
    return re.sub(r"\W|_", "_", name).lower().strip("_")


def find_column(columns: list[str], aliases: list[str], label: str, required: bool = True) -> str | None:
    """Exact alias first, then alias as part of a name; alias order is the priority."""
    known = {normalize_name(c): c for c in columns}
    exact = (known[a] for a in aliases if a in known)
    partial = (original for a in aliases for n, original in known.items() if a in n)
    found = next(exact, None) or next(partial, None)
    if found is None and required:
        raise ValueError(f"no {label} column among {', '.join(columns)}; accepted names: {', '.join(aliases)}")
    return found


def resolve_points(df: DataFrame) -> DataFrame:
    """Canonical point columns as DOUBLE (unparsable text is NULL); optional ones if present."""
    picks: list[Column] = []
    for out, aliases in POINT_ALIASES.items():
        source = find_column(df.columns, aliases, out)
        picks.append(coerce_double(F.col(f"`{source}`")).alias(out))
    for out, aliases in OPTIONAL_ALIASES.items():
        source = find_column(df.columns, aliases, out, required=False)
        if source:
            picks.append(coerce_double(F.col(f"`{source}`")).alias(out))
    return df.select(*picks)


def raster_window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int, band: str | None = None,
                  band_rows: int = 256, row: str = "row", column: str = "col") -> DataFrame:
    """Cells of [r0, r1) x [c0, c1); literal bounds reach the Parquet scan.

    ``band`` names the partition column row div band_rows of tables written by
    ``sinks.write_raster``, so whole folders are skipped.
    """
    out = cells.filter((F.col(row) >= r0) & (F.col(row) < r1) & (F.col(column) >= c0) & (F.col(column) < c1))
    return out.filter(F.col(band).between(r0 // band_rows, (r1 - 1) // band_rows)) if band else out


def manifest_pairs(manifest: DataFrame, frame_id: str, rasters: DataFrame, path: str = "local_path") -> DataFrame:
    """Usable pairs of a frame: status ok, frame equal or blank, raster known; by pair."""
    same = (F.col("frame_id") == frame_id) | F.col("frame_id").isNull() | (F.col("frame_id") == "")
    kept = manifest.filter((F.col("download_status") == "ok") & same)
    return kept.join(rasters.select(path).distinct(), path, "left_semi").orderBy("pair")
