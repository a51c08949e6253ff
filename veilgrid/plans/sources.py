"""Sources and sinks. Files are written from the given tables, then read back and compared with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators.ordering import union_all
from ..runtime import scratch
from ..sources import files, readers, sinks
from . import views as V
from .registry import query


@query("src_csv_bom", "select c_custkey, c_name, c_mktsegment from customer")
def src_csv_bom(spark, d):
    """Text CSV whose first header name carries a byte-order mark."""
    path = scratch(spark, "bom")
    cols = [F.col("c_custkey").cast("string").alias("\ufeffc_custkey"), "c_name", "c_mktsegment"]
    V.table(spark, d, "customer").select(*cols).write.option("header", True).csv(path)
    return readers.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("src_csv_typed", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier", rnd="s_acctbal:2")
def src_csv_typed(spark, d):
    path = scratch(spark, "typed")
    V.table(spark, d, "supplier").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("src_points", """with p as (select unnest(['csv', 'gz', 'parquet']) as format, 100e0 + (event_id % 1000) / 1000e0 as lon,
       15e0 - (user_id % 100) / 100e0 as lat, 5e0 - value / 10e0 as v from events)
       select format, count(*) as n, sum(lon) as sum_lon, sum(lat) as sum_lat, count(*) filter (where v <= -5e0) as n_strong from p group by format""",
       rnd="sum_lon:3 sum_lat:3")
def src_points(spark, d):
    """The same points as csv, gzip csv and parquet, with odd column names."""
    p = V.points(spark, d).select(F.col("lon").alias("Lon Deg"), F.col("lat").alias("Lat Deg"), F.col("velocity_mm_yr").alias("V_UP mm yr"))
    base = scratch(spark, "points")
    p.write.option("header", True).csv(f"{base}/plain.csv")
    p.write.option("header", True).option("compression", "gzip").csv(f"{base}/packed.csv.gz")
    p.write.option("compression", "zstd").parquet(f"{base}/columns.pq")
    parts = [("csv", "plain.csv"), ("gz", "packed.csv.gz"), ("parquet", "columns.pq")]
    read = [readers.resolve_points(readers.read_points(spark, f"{base}/{f}")).withColumn("format", F.lit(n)) for n, f in parts]
    return union_all(read).groupBy("format").agg(
        F.count(F.lit(1)).alias("n"), F.sum("longitude").alias("sum_lon"), F.sum("latitude").alias("sum_lat"),
        F.count_if(F.col("velocity_mm_per_year") <= -5).alias("n_strong"),
    )


@query("src_json", """select event_type, count(*) as finite_count, avg(value) as mean, max(value) as max from events group by event_type""", rnd="mean max")
def src_json(spark, d):
    """One JSON document per summary: written whole, read whole."""
    stats = V.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("a"), F.max("value").alias("m"))
    body = F.struct("event_type", F.struct(F.col("n").alias("finite_count"), F.col("a").alias("mean"), F.col("m").alias("max")).alias("stats"))
    path = scratch(spark, "json")
    # a handful of event types make one document
    stats.agg(F.to_json(F.collect_list(body)).alias("value")).write.text(path)
    doc = readers.read_json_document(spark, path, "event_type string, stats struct<finite_count: bigint, mean: double, max: double>")
    return doc.select("event_type", "stats.*")


@query("src_raster_window", """select cell_row, cell_col, vlm_mm_yr from fx_grid where cell_row >= 10 and cell_row < 70 and cell_col >= 16 and cell_col < 100""",
       "fx_grid", "vlm_mm_yr:2")
def src_raster_window(spark, d):
    """A banded raster table is written once; the window then skips bands and row groups."""
    path = scratch(spark, "raster")
    sinks.write_raster(V.grid(spark, d).select("cell_row", "cell_col", "vlm_mm_yr"), path, "cell_row", "cell_col", band_rows=32)
    cells = spark.read.parquet(path)
    return readers.raster_window(cells, 10, 70, 16, 100, "row_band", 32, "cell_row", "cell_col").drop("row_band")


_MANIFEST = """m as (select concat(cast(2015 + doc_id % 8 as varchar), '0101_', cast(2015 + doc_id % 8 as varchar), lpad(cast(doc_id as varchar), 6, '0')) as pair,
       case doc_id % 3 when 0 then 'F1' when 1 then '' else 'F2' end as frame_id, case when n_chars % 5 = 0 then 'failed' else 'ok' end as download_status,
       concat('r/', cast(doc_id % 977 as varchar)) as local_path from documents), r as (select concat('r/', cast(page_id as varchar)) as local_path from pages)"""


@query("src_manifest", f"with {_MANIFEST} select m.* from m where download_status = 'ok' and frame_id in ('F1', '') and local_path in (select local_path from r)")
def src_manifest(spark, d):
    doc, year = F.col("doc_id"), (F.lit(2015) + F.col("doc_id") % 8).cast("string")
    manifest = V.table(spark, d, "documents").select(
        F.concat(year, F.lit("0101_"), year, F.lpad(doc.cast("string"), 6, "0")).alias("pair"),
        F.when(doc % 3 == 0, "F1").when(doc % 3 == 1, "").otherwise("F2").alias("frame_id"),
        F.when(F.col("n_chars") % 5 == 0, "failed").otherwise("ok").alias("download_status"),
        F.concat(F.lit("r/"), (doc % 977).cast("string")).alias("local_path"),
    )
    page = F.col("page_id")
    rasters = V.table(spark, d, "pages").select(F.concat(F.lit("r/"), page.cast("string")).alias("local_path"))
    return readers.manifest_pairs(manifest, "F1", rasters)


_SUFFIXES = [".csv", ".parquet", ".zip", ".txt", ".gz"]


@query("src_preflight", f"""with f as (select doc_id, case when doc_id % 50 = 0 then 'DOWNLOAD_HERE.txt' else concat('f', cast(doc_id as varchar)) end as file_name,
         list_extract({_SUFFIXES!r}, cast(doc_id % 5 as int) + 1) as suffix, string_split(split_part(text, chr(10), 1), ' ') as header from documents),
       h as (select *, len(list_filter(header, lambda c: list_bool_or(list_transform({text.COORD_HINTS!r}, lambda h: contains(lower(trim(c)), h))))) > 0 as coord,
         len(list_filter(header, lambda c: list_bool_or(list_transform({text.VELOCITY_HINTS!r}, lambda h: contains(lower(trim(c)), h))))) > 0 as vel from f)
       select doc_id, case when file_name = 'DOWNLOAD_HERE.txt' then 'placeholder' when suffix = '.zip' then 'needs_conversion'
         when suffix = '.txt' then 'unsupported_suffix' when len(header[1]) = 0 then 'unreadable' when coord and vel then 'candidate' else 'inspect_columns' end as status from h""")
def src_preflight(spark, d):
    doc = F.col("doc_id")
    header = F.split(F.substring_index("text", "\n", 1), " ")
    files = V.table(spark, d, "documents").select(
        "doc_id", F.when(doc % 50 == 0, "DOWNLOAD_HERE.txt").otherwise(F.concat(F.lit("f"), doc.cast("string"))).alias("file_name"),
        F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (doc % 5 + 1).cast("int")).alias("suffix"), header.alias("header"),
    )
    readable = F.length(F.get("header", F.lit(0))) > 0
    return files.select("doc_id", text.preflight_status("file_name", "suffix", F.col("header"), readable).alias("status"))


_FILES = [*V.SCHEMAS, "embeddings", "benchmark", "conversations"]


@query("src_preflight_files", f"""with h as (select table_name, list(column_name) as header from information_schema.columns where table_name in {tuple(dict.fromkeys(_FILES))!r} group by table_name),
       c as (select *, len(list_filter(header, lambda c: list_bool_or(list_transform({text.COORD_HINTS!r}, lambda h: contains(lower(trim(c)), h))))) > 0 as coord,
         len(list_filter(header, lambda c: list_bool_or(list_transform({text.VELOCITY_HINTS!r}, lambda h: contains(lower(trim(c)), h))))) > 0 as vel from h)
       select concat(table_name, '.parquet') as file_name, len(header) as n_columns, case when coord and vel then 'candidate' else 'inspect_columns' end as status from c""", ints="n_columns")
def src_preflight_files(spark, d):
    """The table files themselves as uploads: their headers are read by tasks."""
    heads = files.file_headers(spark, [f"{d}/{n}.parquet" for n in _FILES])
    status = text.preflight_status("file_name", "suffix", F.col("header"), F.col("readable"))
    return heads.select("file_name", F.size("header").alias("n_columns"), status.alias("status"))


@query("src_key_listing", """with k as (select case when len(split_part(url, '/', 4)) = 2 then split_part(url, '/', 4) else 'ROOT_OR_AGGREGATE' end as country_or_group from pages)
       select country_or_group, count(*) as n_keys from k group by country_or_group""")
def src_key_listing(spark, d):
    return V.table(spark, d, "pages").groupBy(text.key_country("url").alias("country_or_group")).agg(F.count(F.lit(1)).alias("n_keys"))


_EXT = [".TIF", ".txt", ".h5", ".png", "", ".csv"]


@query("src_archive_inventory", f"""with m as (select concat(source, '/', lang, '/f', cast(doc_id as varchar), list_extract({_EXT!r}, cast(doc_id % 6 as int) + 1)) as filename, n_chars as size,
         lower(list_extract({_EXT!r}, cast(doc_id % 6 as int) + 1)) as ext, source from documents),
       s as (select case when ext = '' then '[no_suffix]' else ext end as item, count(*) as n from m group by 1)
       select 'suffix' as kind, item, n as value from s union all select 'top_dir', source, count(*) from m group by source
       union all select 'largest', filename, size from (select filename, size from m order by size desc, filename limit 20)
       union all select 'flag', 'has_geotiff', cast(max(case when item in ('.tif', '.tiff') then 1 else 0 end) as bigint) from s
       union all select 'flag', 'has_text_metadata', cast(max(case when item in ('.txt', '.csv', '.json', '.xml', '.rsc', '.par') then 1 else 0 end) as bigint) from s""",
       ints="value")
def src_archive_inventory(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 6 + 1).cast("int"))
    m = V.table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), ext).alias("filename"), F.col("n_chars").alias("size"))
    row = lambda kind, item, value: [F.lit(kind).alias("kind"), item.alias("item"), value.cast("bigint").alias("value")]
    suffixes = m.groupBy(text.file_suffix("filename").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    dirs = m.groupBy(text.top_dir("filename").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    top = m.orderBy(F.col("size").desc(), "filename").limit(20)
    has = lambda names: F.max(F.col("s").isin(names).cast("int"))
    flags = suffixes.agg(has([".tif", ".tiff"]).alias("has_geotiff"), has([".txt", ".csv", ".json", ".xml", ".rsc", ".par"]).alias("has_text_metadata"))
    return union_all([
        suffixes.select(*row("suffix", F.col("s"), F.col("n"))), dirs.select(*row("top_dir", F.col("s"), F.col("n"))),
        top.select(*row("largest", F.col("filename"), F.col("size"))),
        flags.unpivot([], flags.columns, "item", "value").select(*row("flag", F.col("item"), F.col("value"))),
    ])


@query("src_file_hash")
def src_file_hash(spark, d):
    """Hashes of the table files themselves; the list holds a repeat on purpose."""
    names = [*V.SCHEMAS, "embeddings", "benchmark", "conversations", "region"]
    out = files.file_hashes(spark, [f"{d}/{n}.parquet" for n in names])
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "bytes", "sha256")


@query("sink_csv_project", "select cast(p_partkey as varchar) as p_partkey, p_brand, cast(null as varchar) as note, cast(p_size as varchar) as p_size from part")
def sink_csv_project(spark, d):
    """Only the listed fields are written; one that does not exist comes out blank."""
    path = scratch(spark, "project")
    sinks.write_csv(V.table(spark, d, "part"), path, ["p_partkey", "p_brand", "note", "p_size"])
    return readers.read_csv(spark, path)


@query("sink_ledger_append", """with runs as (select c_mktsegment as candidate_stack, avg(c_acctbal) as score from customer group by c_mktsegment),
       old as (select 'freeze-0001' as run_id, 'seed' as candidate_stack, cast(null as double) as score)
       select run_id, candidate_stack, score from old union all
       select concat('freeze-', lpad(cast(row_number() over (order by score desc) + 1 as varchar), 4, '0')), candidate_stack, score from runs""", rnd="score")
def sink_ledger_append(spark, d):
    """A ledger gains numbered rows in append mode and is read back whole."""
    path = scratch(spark, "ledger")
    runs = V.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("candidate_stack")).agg(F.avg("c_acctbal").alias("score"))
    stamp = "2026-01-01 00:00:00"
    old = spark.range(1).select(F.lit("freeze-0001").alias("run_id"), F.lit("seed").alias("candidate_stack"), F.lit(stamp).cast("timestamp").alias("timestamp_utc"))
    fields = ["run_id", "candidate_stack", "score", "timestamp_utc"]
    first = old.withColumn("score", F.lit(None).cast("double")).select(*fields)
    first.write.parquet(path)
    sinks.ledger_rows(runs.withColumn("_o", -F.col("score")), 2, "_o", stamp).select(*fields).write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("timestamp_utc")


@query("sink_sample", "select point_id, lon, lat, velocity_mm_yr from fx_points order by velocity_mm_yr, point_id limit 200000", "fx_points", "lon lat velocity_mm_yr")
def sink_sample(spark, d):
    p = V.points(spark, d).select("point_id", "lon", "lat", "velocity_mm_yr")
    return sinks.sample_rows(p, ["velocity_mm_yr", "point_id"])
