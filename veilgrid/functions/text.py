"""Text, JSON and HTML column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import col

# Header words that hint at coordinates and at velocity.
COORD_HINTS = ["lon", "longitude", "x", "lat", "latitude", "y", "easting", "northing", "geometry"]
VELOCITY_HINTS = ["velocity", "mean_velocity", "vel", "v", "up", "vu", "mean_vel", "deformation"]
READABLE_SUFFIXES = [".csv", ".parquet", ".pq", ".gz"]
ARCHIVE_SUFFIXES = [".zip", ".gpkg", ".geojson", ".json"]
PLACEHOLDER_NAMES = ["DOWNLOAD_HERE.txt"]


def slugify(c, default: str = "term") -> Column:
    """Lower-case words joined by single underscores; ``default`` when nothing is left."""
    slug = F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def region_label(c) -> Column:
    return F.trim(F.replace(col(c), F.lit("_"), F.lit(" ")))


def strip_prefix(c, prefix: str) -> Column:
    return F.when(col(c).startswith(prefix), F.substr(col(c), F.lit(len(prefix) + 1))).otherwise(col(c))


def after_first(c, mark: str) -> Column:
    """Text after the first mark; the whole text when there is none."""
    at = F.locate(mark, col(c))
    return F.when(at > 0, F.substr(col(c), at + F.lit(len(mark)))).otherwise(col(c))


def join_numbers(*cs) -> Column:
    return F.concat_ws(",", *[col(c).cast("string") for c in cs])


def split_numbers(c) -> Column:
    return F.transform(F.split(col(c), ","), lambda x: x.try_cast("double"))


def pair_year(pair) -> Column:
    return F.substring(col(pair), 1, 4).try_cast("int")


def transport_category(tags: Column) -> Column:
    """Way tags to railway / major_road, NULL for anything else."""
    highway = F.lower(F.try_element_at(tags, F.lit("highway")))
    return F.when(F.map_contains_key(tags, "railway"), "railway").when(
        F.coalesce(highway, F.lit("")) != "", "major_road"
    )


def key_country(key) -> Column:
    """Two-letter fourth part of an object key, else the catch-all group."""
    part = F.get(F.split(col(key), "/"), F.lit(3))
    return F.when(F.length(part) == 2, part).otherwise("ROOT_OR_AGGREGATE")


def file_suffix(name) -> Column:
    """Lower-case last extension with its dot, or the no-suffix marker."""
    base = F.element_at(F.split(col(name), "/"), -1)
    suffix = F.regexp_extract(F.lower(base), r"^.+(\.[^.]+)$", 1)
    return F.when(suffix == "", "[no_suffix]").otherwise(suffix)


def top_dir(name) -> Column:
    return F.get(F.split(col(name), "/"), F.lit(0))


def hint_columns(header: Column, hints: list[str]) -> Column:
    """Names in a header array that contain one of the hint words."""
    words = F.array(*[F.lit(h) for h in hints])
    return F.filter(header, lambda c: F.exists(words, lambda h: F.contains(F.lower(F.trim(c)), h)))


def preflight_status(file_name, suffix, header: Column, readable: Column) -> Column:
    """How far an uploaded file is from being usable as a point table."""
    named = F.lower(col(suffix))
    usable = (F.size(hint_columns(header, COORD_HINTS)) > 0) & (F.size(hint_columns(header, VELOCITY_HINTS)) > 0)
    return (
        F.when(col(file_name).isin(PLACEHOLDER_NAMES), "placeholder")
        .when(named.isin(ARCHIVE_SUFFIXES), "needs_conversion")
        .when(~named.isin(READABLE_SUFFIXES), "unsupported_suffix")
        .when(~readable, "unreadable")
        .when(usable, "candidate")
        .otherwise("inspect_columns")
    )


PROBE_SCHEMA = T.ArrayType(
    T.StructType([
        T.StructField("h5_member", T.StringType()),
        T.StructField("n_time_steps", T.LongType()),
        T.StructField("velocity_stats", T.StructType([
            T.StructField("median", T.DoubleType()),
            T.StructField("finite_count", T.LongType()),
            T.StructField("fraction_lt_minus_5", T.DoubleType()),
        ])),
    ])
)


def preferred_probe(text, marker: str = "cum_filt.h5") -> Column:
    """First probe record whose member name holds the marker, else the first record."""
    rows = F.from_json(col(text), PROBE_SCHEMA)
    marked = F.filter(rows, lambda r: F.contains(F.coalesce(r["h5_member"], F.lit("")), F.lit(marker)))
    return F.coalesce(F.get(marked, F.lit(0)), F.get(rows, F.lit(0)))


def first_probe(text) -> Column:
    """First probe record, whatever its member."""
    return F.get(F.from_json(col(text), PROBE_SCHEMA), F.lit(0))


HITS_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("aoi_id", T.StringType()),
    T.StructField("query_kind", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("hits", T.ArrayType(T.StructType([
            T.StructField("filename", T.StringType()),
            T.StructField("filesize", T.LongType()),
            T.StructField("release", T.StringType()),
        ]))),
    ])),
])


def download_url(endpoint: str, filename, query_id) -> Column:
    """Link of one hit; empty text unless both parts are known."""
    both = (F.coalesce(col(filename), F.lit("")) != "") & (F.coalesce(col(query_id), F.lit("")) != "")
    return F.when(
        both, F.concat(F.lit(endpoint + "/download/"), col(filename), F.lit("?id="), col(query_id))
    ).otherwise("")


#: a JSON member at any depth whose key names a link and whose value is an http text
URL_MEMBER = r'"[^"\\]*(?i:download|href|url)[^"\\]*"\s*:\s*"(http(?:[^"\\]|\\.)*)"'


def json_urls(text) -> Column:
    """Links found anywhere in a JSON document, in document order, without repeats.

    JSON escapes inside the value are decoded.
    """
    found = F.regexp_extract_all(col(text), F.lit(URL_MEMBER), F.lit(1))
    unquote = lambda u: F.from_json(F.concat(F.lit('{"u":"'), u, F.lit('"}')), "u string")["u"]
    return F.array_distinct(F.transform(found, unquote))


def html_rows(html, row_pattern: str, group: int = 0) -> Column:
    """Every table row of a page that matches the pattern."""
    return F.regexp_extract_all(col(html), F.lit(row_pattern), F.lit(group))


def html_cells(row, cell_pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(row), F.lit(cell_pattern), F.lit(group))
