"""Text, JSON, HTML and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from . import views as V
from .registry import query


@query("slugify", r"""select doc_id, coalesce(nullif(trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'term') as slug from documents""")
def slugify(spark, d):
    """Slugs of whole texts."""
    return V.table(spark, d, "documents").select("doc_id", X.slugify("text").alias("slug"))


@query("region_normalize", """select c_custkey, trim(replace(concat(c_mktsegment, '_', c_name, '_'), '_', ' ')) as label,
       c_name as stripped,
       substr(c_name, strpos(c_name, '#') + 1) as tail from customer""")
def region_normalize(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(
        "c_custkey", X.region_label(F.concat("c_mktsegment", F.lit("_"), "c_name", F.lit("_"))).alias("label"),
        X.strip_prefix(F.concat(F.lit("avg_effect:"), "c_name"), "avg_effect:").alias("stripped"), X.after_first("c_name", "#").alias("tail"))


@query("bbox_text", """with t as (select c_custkey, concat_ws(',', cast(c_custkey as varchar), cast(c_nationkey as varchar), cast(c_custkey + 5 as varchar), cast(c_nationkey + 2 as varchar)) as bbox from customer)
       select c_custkey, bbox, cast(split_part(bbox, ',', 1) as double) as west, cast(split_part(bbox, ',', 4) as double) as north,
       concat_ws(';', split_part(bbox, ',', 1), split_part(bbox, ',', 2)) as first_ids from t""", rnd="west north")
def bbox_text(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", X.join_numbers(
        "c_custkey", "c_nationkey", F.col("c_custkey") + 5, F.col("c_nationkey") + 2).alias("bbox"))
    v = X.split_numbers("bbox")
    return c.select("c_custkey", "bbox", v[0].alias("west"), v[3].alias("north"),
                    F.concat_ws(";", F.slice(F.split("bbox", ","), 1, 2)).alias("first_ids"))


@query("pair_year", """with p as (select concat(strftime(o_orderdate, '%Y%m%d'), '_', strftime(o_orderdate + interval 12 day, '%Y%m%d')) as pair, o_totalprice as strong_km,
       o_totalprice * 0.25e0 as hidden_km from orders)
       select cast(substr(pair, 1, 4) as int) as year, count(*) as n_pairs, sum(strong_km - hidden_km) as visible_km from p group by 1""", rnd="visible_km:2")
def pair_year(spark, d):
    day = lambda c: F.date_format(c, "yyyyMMdd")
    o = F.col("o_orderdate")
    p = V.table(spark, d, "orders").select(
        F.concat(day(o), F.lit("_"), day(o + F.expr("interval 12 days"))).alias("pair"), F.col("o_totalprice").alias("strong_km"),
        (F.col("o_totalprice") * 0.25).alias("hidden_km"))
    return p.groupBy(X.pair_year("pair").alias("year")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("strong_km") - F.col("hidden_km")).alias("visible_km")).orderBy("year")


@query("json_fields", """with e as (select event_id, value, cast(json_extract(props, '$.k') as bigint) as k from events)
       select event_id, k, coalesce(cast(json_extract_string(case when k % 2 = 0 then '{"a": 1}' else '{}' end, '$.a') as bigint), -1) as with_default,
         case when k % 3 = 0 then 'run/cum_filt.h5' else 'run/raw.h5' end as member, case when k % 3 = 0 then -value else value end as median,
         k as n_time_steps from e""", rnd="median")
def json_fields(spark, d):
    """Nested fields with defaults, and the preferred element of an array of records; time steps come from the first."""
    k = F.from_json("props", "k bigint")["k"]
    rec = lambda member, steps, med: F.struct(
        F.lit(member).alias("h5_member"), steps.alias("n_time_steps"), F.struct(med.alias("median")).alias("velocity_stats"))
    e = V.table(spark, d, "events").select("event_id", "value", k.alias("k"))
    raw, filt = rec("run/raw.h5", F.col("k"), F.col("value")), rec("run/cum_filt.h5", F.col("k") + 1, -F.col("value"))
    doc = F.to_json(F.when(F.col("k") % 3 == 0, F.array(raw, filt)).otherwise(F.array(raw)))
    e = e.withColumn("p", X.preferred_probe(doc)).withColumn("q", X.first_probe(doc))
    flag = F.from_json(F.when(F.col("k") % 2 == 0, '{"a": 1}').otherwise("{}"), "a bigint")["a"]
    return e.select("event_id", "k", F.coalesce(flag, F.lit(-1)).alias("with_default"), F.col("p.h5_member").alias("member"),
                    F.col("p.velocity_stats.median").alias("median"), F.col("q.n_time_steps").alias("n_time_steps"))


@query("json_flatten_hits", """with e as (select *, case when event_id % 9 = 0 then '' else concat('q', event_id) end as query_id from events where event_type <> 'error'),
       h as (select event_id, query_id, user_id, event_type, unnest(range(1, 1 + event_id % 4)) as i from e)
       select query_id, concat('aoi', user_id) as aoi_id, event_type as query_kind, case when i = 2 then '' else concat('f', event_id, '_', i) end as filename, i * 100 as filesize,
         case when i <> 2 and query_id <> '' then concat('https://host.example/download/f', event_id, '_', i, '?id=', query_id) else '' end as download_url from h""",
       ints="filesize")
def json_flatten_hits(spark, d):
    """Search results as JSON text: hits are exploded, malformed results are skipped."""
    i = F.col("event_id")
    hits = F.transform(F.sequence(F.lit(1).cast("bigint"), i % 4), lambda k: F.struct(
        F.when(k == 2, "").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit("_"), k.cast("string"))).alias("filename"), (k * 100).alias("filesize")))
    hits = F.when(i % 4 > 0, hits).otherwise(F.array().cast("array<struct<filename:string,filesize:bigint>>"))
    good = F.to_json(F.struct(
        F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("q"), i.cast("string"))).alias("query_id"), F.concat(F.lit("aoi"), F.col("user_id").cast("string")).alias("aoi_id"),
        F.col("event_type").alias("query_kind"), F.struct(hits.alias("hits")).alias("result")))
    docs = V.table(spark, d, "events").select(F.when(F.col("event_type") == "error", '{"query_id": "bad", "result": "timeout"}').otherwise(good).alias("doc"))
    r = docs.select(F.from_json("doc", X.HITS_SCHEMA).alias("r")).filter("r.result.hits is not null")
    flat = r.select("r.query_id", "r.aoi_id", "r.query_kind", F.explode("r.result.hits").alias("h")).select("query_id", "aoi_id", "query_kind", "h.filename", "h.filesize")
    return flat.withColumn("download_url", X.download_url("https://host.example", "filename", "query_id"))


@query("json_extract_urls", """with p as (select page_id, url from pages)
       select page_id, 1 as position, url from p union all select page_id, 2, concat(url, '&v=2') from p where page_id % 3 <> 0""", ints="position")
def json_extract_urls(spark, d):
    """Links at any depth under keys that name one; other texts and repeats are left out."""
    esc = lambda c: F.replace(c, F.lit("/"), F.lit("\\/"))
    u = F.col("url")
    tail = F.when(F.col("page_id") % 3 == 0, u).otherwise(F.concat(u, F.lit("&v=2")))
    doc = F.concat(F.lit('{"title":"http://not-a-link","Self_HREF":"'), u, F.lit('","items":[{"note":"see url","deep":{"downloadUrl":"'), esc(tail),
                   F.lit('"}},{"url":5},{"url":"'), u, F.lit('"},{"url":"ftp://x"}]}'))
    urls = V.table(spark, d, "pages").select("page_id", X.json_urls(doc).alias("urls"))
    return urls.select("page_id", F.posexplode("urls").alias("p", "url")).select("page_id", (F.col("p") + 1).alias("position"), "url")


@query("html_table_rows", """with r as (select page_id, regexp_extract_all(html, '<li><a href="[^"]+">([^<]+)</a></li>', 1) as cells from pages),
       l as (select page_id, cells, unnest(range(1, len(cells) + 1)) as i from r)
       select page_id, 1989 + i as year, cells[i] as value, 1989 + len(cells) as latest_year, cells[-1] as latest_value from l""", ints="year latest_year")
def html_table_rows(spark, d):
    """Row values of a page become a year series; the last one is the latest."""
    cells = X.html_rows("html", '<li><a href="[^"]+">([^<]+)</a></li>', 1)
    p = V.table(spark, d, "pages").select("page_id", cells.alias("cells")).filter(F.size("cells") > 0)
    last = (F.lit(1989) + F.size("cells")).alias("latest_year")
    return p.select("page_id", F.posexplode("cells").alias("i", "value"), last, F.element_at("cells", -1).alias("latest_value")).withColumn(
        "year", F.lit(1990) + F.col("i")).drop("i")


@query("tag_category", "select category, count(*) as n from fx_category group by category", "fx_category")
def tag_category(spark, d):
    return V.way_tags(spark, d).groupBy(X.transport_category(F.col("tags")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("sci_scalars", """select point_id, ln(weight + 1e0) as log_x, exp(-weight / 10e0) as exp_x, ln(1e0 + weight) as log1p_x, sqrt(weight) as sqrt_x, cast(floor(velocity_mm_yr) as bigint) as floor_x,
       cast(ceil(velocity_mm_yr) as bigint) as ceil_x, round_even(velocity_mm_yr * 2e0, 0) as rint_x, radians(lat) as rad_x, sin(radians(lat)) as sin_x, cos(radians(lat)) as cos_x, asin(lat / 90e0) as asin_x,
       abs(velocity_mm_yr) as abs_x, greatest(-2e0, least(2e0, velocity_mm_yr)) as clip_x from fx_points""", "fx_points",
       "log_x exp_x log1p_x sqrt_x rint_x rad_x sin_x cos_x asin_x abs_x clip_x")
def sci_scalars(spark, d):
    v, w, lat = F.col("velocity_mm_yr"), F.col("weight"), F.col("lat")
    return V.points(spark, d).select(
        "point_id", F.log(w + 1.0).alias("log_x"), F.exp(-w / 10.0).alias("exp_x"), F.log1p(w).alias("log1p_x"), F.sqrt(w).alias("sqrt_x"), F.floor(v).alias("floor_x"),
        F.ceil(v).alias("ceil_x"), F.rint(v * 2.0).alias("rint_x"), F.radians(lat).alias("rad_x"), F.sin(F.radians(lat)).alias("sin_x"),
        F.cos(F.radians(lat)).alias("cos_x"), F.asin(lat / 90.0).alias("asin_x"), F.abs(v).alias("abs_x"),
        F.greatest(F.lit(-2.0), F.least(F.lit(2.0), v)).alias("clip_x"))
