"""Grid-shaped inputs derived from the given tables, as DataFrames and as SQL text.

The two forms are written separately: the SQL is only used to check results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..functions.numeric import haldane_or, woolf_variance
from ..operators import exposure, observe

TARGET = Grid(100.0, 15.0, 0.01, 0.01, width=128)
SOURCE = Grid(99.995, 15.005, 0.013, 0.013, width=50)
N_PAIRS = 7
THRESHOLD = 0.3
SLACK = 1e-9  # the coherence of the fixtures is a product, which may fall short of a threshold by rounding
STRONG = 5.0


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table with its stated schema, so that no job is spent on inferring it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Target cells from orders alone: position, velocity, land cover."""
    o = table(spark, d, "orders")
    code = (
        F.when(F.col("o_orderpriority") == "1-URGENT", 40).when(F.col("o_orderpriority") == "2-HIGH", 50)
        .when(F.col("o_orderpriority") == "3-MEDIUM", 80).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 10).otherwise(60)
    )
    cents = F.round(F.col("o_totalprice") * 100.0).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("cell_id"), F.floor(F.col("o_orderkey") / 128.0).alias("cell_row"),
        (F.col("o_orderkey") % 128).alias("cell_col"), ((cents % 2500).cast("double") / 100.0 - 20.0).alias("vlm_mm_yr"),
        code.alias("landcover_code"), "o_custkey", "o_orderstatus",
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("pair_id")
    ).agg((F.max("l_discount") * 10.0).alias("coherence"))


def cell_measures(spark: SparkSession, d: str, thresholds: dict[str, float]) -> DataFrame:
    """Exposure and observation counts of each cell in one pass over lineitem."""
    per_pair = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), "l_linenumber").agg(
        (F.max("l_discount") * 10.0).alias("coherence"), F.sum("l_quantity").alias("_q"),
        F.sum("l_extendedprice").alias("_x"), F.count(F.lit(1)).alias("_n"),
    )
    return per_pair.groupBy("cell_id").agg(
        F.sum("_q").alias("population"), F.sum("_x").alias("builtup_m2"),
        F.least(F.lit(1.0), F.sum("_n") / 7.0).alias("cover_fraction"),
        *[F.count_if(observe.coherent("coherence", t, SLACK)).alias(n) for n, t in thresholds.items()],
        F.count(F.lit(1)).alias("n_seen"),
    )


def placed(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    """Add region and nation through the customer of each cell."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    out = df.join(c, df["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.withColumnsRenamed({"n_regionkey": "region_id", "n_nationkey": "nation_id"}).drop("c_custkey", "c_nationkey")


def flags(spark: SparkSession, d: str, region: bool = True, thresholds: dict[str, float] | None = None,
          require_exposure: tuple[str, ...] = ("population", "builtup_m2")) -> DataFrame:
    """Cells with exposure, counts, observability flags and the deformation screen."""
    names = thresholds or {"n_obs": THRESHOLD}
    cells = grid(spark, d).join(cell_measures(spark, d, names), "cell_id", "left")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in [*names, "n_seen"]}
    cells = cells.withColumns(zero).withColumn("inside_any", F.col("n_seen") > 0)
    if region:
        cells = placed(spark, d, cells)
    flagged = observe.observability_flags(cells, N_PAIRS, next(iter(names)))
    return observe.screen(flagged, "vlm_mm_yr", STRONG, require_exposure)


def raster_headers(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue of the pair rasters: grids of different origins, pixels and extents; the last one lies elsewhere."""
    p = F.col("raster_id")
    pairs = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("raster_id")).distinct()
    size = F.lit(0.008) + F.lit(0.002) * (p % 3)
    return pairs.select(
        "raster_id", F.when(p == 7, F.lit(150.0)).otherwise(F.lit(99.9935) + 0.05 * p).alias("tie_lon"), (F.lit(15.0065) - 0.03 * p).alias("tie_lat"),
        size.alias("px"), (size + 0.001).alias("py"), (F.lit(70) + 10 * p).cast("bigint").alias("width"), (F.lit(40) * p).cast("bigint").alias("height"),
        F.when(p % 2 == 0, F.lit(0.1)).alias("nodata"), F.when(p == 3, F.lit(10.0)).alias("value_scale"),
    )


def raster_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Sparse pixels of the pair rasters."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").alias("raster_id"), F.floor(F.col("l_orderkey") / 97.0).alias("row"), (F.col("l_orderkey") % 97).alias("col")
    ).agg((F.max("l_discount") * 10.0).alias("value"))


def source_grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("src_id"), F.floor(F.col("p_partkey") / 50.0).alias("src_row"),
        (F.col("p_partkey") % 50).alias("src_col"), F.col("p_retailprice").alias("src_value"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("point_id"), (F.lit(100.0) + (F.col("event_id") % 1000) / 1000.0).alias("lon"),
        (F.lit(15.0) - (F.col("user_id") % 100) / 100.0).alias("lat"), (F.lit(5.0) - F.col("value") / 10.0).alias("velocity_mm_yr"),
        F.col("value").alias("weight"), "props",
    )


def ways(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("seq")).agg(
        (F.lit(100.0) + (F.max("l_partkey") % 1280) / 1000.0).alias("lon"),
        (F.lit(15.0) - (F.max("l_suppkey") % 100) / 100.0).alias("lat"),
    )


def way_tags(spark: SparkSession, d: str) -> DataFrame:
    """Free-form tags of each way, from the order behind it."""
    s = F.col("o_orderstatus")
    pr = F.lower(F.col("o_orderpriority"))
    tags = F.when(s == "F", F.create_map(F.lit("railway"), F.lit("rail"), F.lit("highway"), pr)).when(
        s == "O", F.create_map(F.lit("highway"), pr)
    ).otherwise(F.create_map(F.lit("waterway"), F.lit("canal")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("way_id"), tags.alias("tags"))


def studies(spark: SparkSession, d: str) -> DataFrame:
    """One study per nation: log odds ratio of hidden by strong, with its Woolf variance."""
    t = flags(spark, d).filter("base").groupBy("region_id", "nation_id").agg(
        *exposure.contingency(), F.count(F.lit(1)).alias("n_cells"), F.count_if("strong").alias("strong_cells"),
        F.sum(F.when(F.col("strong"), F.col("population"))).alias("strong_pop"),
    )
    return t.select(
        "region_id", "nation_id", "n_cells", "strong_cells", "strong_pop", "a", "b", "c", "d",
        F.log(haldane_or("a", "b", "c", "d")).alias("log_or"), woolf_variance("a", "b", "c", "d").alias("var"),
    )


def model_cells(spark: SparkSession, d: str) -> DataFrame:
    """Usable cells with failure counts and land-cover group, for the binomial models."""
    f = observe.with_landcover(flags(spark, d)).filter("base")
    return f.withColumn("failure_count", F.lit(N_PAIRS) - F.col("n_obs")).withColumn("n_pairs", F.lit(N_PAIRS))


# ---------------------------------------------------------------------------------------------
# SQL text: name -> (views it builds on, query)
# ---------------------------------------------------------------------------------------------
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_grid": ([], """
        select o_orderkey as cell_id, cast(floor(o_orderkey / 128e0) as bigint) as cell_row, o_orderkey % 128 as cell_col,
          cast(cast(round(o_totalprice * 100e0) as bigint) % 2500 as double) / 100e0 - 20e0 as vlm_mm_yr,
          case o_orderpriority when '1-URGENT' then 40 when '2-HIGH' then 50 when '3-MEDIUM' then 80
            when '4-NOT SPECIFIED' then 10 else 60 end as landcover_code, o_custkey, o_orderstatus
        from orders"""),
    "fx_exposure": ([], """
        select l_orderkey as cell_id, sum(l_quantity) as population, sum(l_extendedprice) as builtup_m2,
          least(1e0, count(*) / 7e0) as cover_fraction from lineitem group by l_orderkey"""),
    "fx_cells": (["fx_grid", "fx_exposure"], """
        select g.*, n.n_regionkey as region_id, n.n_nationkey as nation_id, e.population, e.builtup_m2, e.cover_fraction
        from fx_grid g join customer c on g.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
        left join fx_exposure e on e.cell_id = g.cell_id"""),
    "fx_obs": ([], """
        select l_orderkey as cell_id, l_linenumber as pair_id, max(l_discount) * 10e0 as coherence
        from lineitem group by l_orderkey, l_linenumber"""),
    "fx_counts": (["fx_obs"], """
        select cell_id, count(*) as n_seen, count(*) filter (where coherence >= 0.3e0 - 1e-9) as n_obs,
          count(*) filter (where coherence >= 0.2e0 - 1e-9) as n_obs_20,
          count(*) filter (where coherence >= 0.4e0 - 1e-9) as n_obs_40
        from fx_obs group by cell_id"""),
    "fx_flags": (["fx_cells", "fx_counts"], """
        select *, base and vlm_mm_yr <= -5e0 as strong, base and not (vlm_mm_yr <= -5e0) as nonstrong from (
          select c.*, coalesce(k.n_seen, 0) as n_seen, coalesce(k.n_obs, 0) as n_obs, coalesce(k.n_obs_20, 0) as n_obs_20,
            coalesce(k.n_obs_40, 0) as n_obs_40, coalesce(k.n_obs, 0) / 7e0 as obs_fraction, coalesce(k.n_obs, 0) >= 1 as any_obs,
            coalesce(k.n_obs, 0) >= 4 as majority, coalesce(k.n_obs, 0) >= 6 as stable75, coalesce(k.n_obs, 0) < 2 as low25,
            coalesce(k.n_seen, 0) > 0 as inside_any,
            coalesce(k.n_seen, 0) > 0 and coalesce(c.population >= 0, false) and coalesce(c.builtup_m2 >= 0, false) as base
          from fx_cells c left join fx_counts k on k.cell_id = c.cell_id)"""),
    "fx_src": ([], """
        select p_partkey as src_id, cast(floor(p_partkey / 50e0) as bigint) as src_row, p_partkey % 50 as src_col,
          p_retailprice as src_value from part"""),
    "fx_rasters": ([], """
        select p as raster_id, case when p = 7 then 150e0 else 99.9935e0 + 0.05e0 * p end as tie_lon, 15.0065e0 - 0.03e0 * p as tie_lat, 0.008e0 + 0.002e0 * (p % 3) as px,
          (0.008e0 + 0.002e0 * (p % 3)) + 0.001e0 as py, 70 + 10 * p as width, 40 * p as height, case when p % 2 = 0 then 0.1e0 end as nodata, case when p = 3 then 10e0 end as value_scale
        from (select distinct l_linenumber as p from lineitem)"""),
    "fx_pixels": ([], """
        select l_linenumber as raster_id, cast(floor(l_orderkey / 97e0) as bigint) as row, l_orderkey % 97 as col, max(l_discount) * 10e0 as value
        from lineitem group by 1, 2, 3"""),
    "fx_points": ([], """
        select event_id as point_id, 100e0 + (event_id % 1000) / 1000e0 as lon, 15e0 - (user_id % 100) / 100e0 as lat,
          5e0 - value / 10e0 as velocity_mm_yr, value as weight, props from events"""),
    "fx_ways": ([], """
        select l_orderkey as way_id, l_linenumber as seq, 100e0 + (max(l_partkey) % 1280) / 1000e0 as lon,
          15e0 - (max(l_suppkey) % 100) / 100e0 as lat from lineitem group by l_orderkey, l_linenumber"""),
    "fx_category": ([], """
        select o_orderkey as way_id, case o_orderstatus when 'F' then 'railway' when 'O' then 'major_road' end as category,
          lower(o_orderpriority) as highway from orders"""),
    "fx_segments": (["fx_ways"], """
        select way_id, seq, lon, lat, lon2, lat2, 2e0 * 6371e0 * asin(least(1e0, sqrt(
            pow(sin(radians(lat2 - lat) / 2e0), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2e0), 2)))) as seg_km
        from (select *, lead(lon) over w as lon2, lead(lat) over w as lat2 from fx_ways window w as (partition by way_id order by seq))
        where lon2 is not null"""),
    "fx_studies": (["fx_flags"], """
        select *, ln((a + 0.5e0) * (d + 0.5e0) / ((b + 0.5e0) * (c + 0.5e0))) as log_or,
          1e0 / (a + 0.5e0) + 1e0 / (b + 0.5e0) + 1e0 / (c + 0.5e0) + 1e0 / (d + 0.5e0) as var
        from (select region_id, nation_id, count(*) as n_cells, count(*) filter (where strong) as strong_cells,
            sum(population) filter (where strong) as strong_pop,
            count(*) filter (where strong and not majority) as a, count(*) filter (where strong and majority) as b,
            count(*) filter (where nonstrong and not majority) as c, count(*) filter (where nonstrong and majority) as d
          from fx_flags where base group by region_id, nation_id)"""),
    "fx_land": ([], """
        select * from (values (10, 'vegetation_non_crop'), (20, 'vegetation_non_crop'), (30, 'vegetation_non_crop'),
          (100, 'vegetation_non_crop'), (40, 'cropland'), (50, 'built_up'), (60, 'bare_sparse'), (80, 'water_wetland_mangrove'),
          (90, 'water_wetland_mangrove'), (95, 'water_wetland_mangrove')) t(landcover_code, landcover_group)"""),
    "fx_model": (["fx_flags", "fx_land"], """
        select f.*, coalesce(l.landcover_group, 'other') as landcover_group, 7 - f.n_obs as failure_count, 7 as n_pairs
        from fx_flags f left join fx_land l on l.landcover_code = f.landcover_code where f.base"""),
}
