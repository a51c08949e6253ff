"""Left, fallback, semi, anti and spec joins; set operations; unions and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, ordering
from ..runtime import explode_specs
from . import views as V
from .models_shared import evidence, EVIDENCE_SQL, EVIDENCE_VIEWS
from .registry import query


@query("join_left_lookup", """select c.c_custkey, n.n_name, n.n_regionkey, r.r_name as n_name_region, s.n as n_stations from customer c left join nation n on c.c_nationkey = n.n_nationkey
       left join region r on r.r_regionkey = n.n_regionkey left join (select s_nationkey, count(*) as n from supplier group by s_nationkey) s on s.s_nationkey = c.c_nationkey""")
def join_left_lookup(spark, d):
    """Merges where the right side repeats a column name."""
    c = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = V.table(spark, d, "nation")
    r = V.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"))
    s = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_stations"))
    out = joins.left_lookup(joins.left_lookup(c, n, "n_nationkey", "_nation"), r, "n_regionkey", "_region")
    return joins.left_lookup(out, s, "n_nationkey", "_s").drop("n_nationkey")


@query("join_fallback_keys", """with e as (select case when s_nationkey % 3 = 0 then n_name else concat('avg_effect:', n_name) end as effect, sum(s_acctbal) as v from supplier
         join nation on n_nationkey = s_nationkey group by s_nationkey, n_name having sum(s_acctbal) > 15000e0)
       select n.n_name, coalesce(a.v, b.v, -1e0) as value from nation n left join e a on a.effect = n.n_name left join e b on b.effect = concat('avg_effect:', n.n_name)""", rnd="value:4")
def join_fallback_keys(spark, d):
    """Effects stored under a plain or a prefixed name; regions without one get the default."""
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    s = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("v"))
    k = F.col("n_nationkey")
    e = s.filter("v > 15000").join(n, "n_nationkey").select(
        F.when(k % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("avg_effect:"), "n_name")).alias("effect"), "v")
    return joins.fallback_lookup(n.select("n_name"), e, "n_name", "effect", "v", "avg_effect:", -1.0, "value")


@query("join_semi", """select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)""")
def join_semi(spark, d):
    allowed = V.table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return V.table(spark, d, "documents").select("doc_id", "source").join(allowed, "doc_id", "left_semi")


@query("join_anti", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_custkey is not null)")
def join_anti(spark, d):
    used = V.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").select("c_custkey", "c_name").join(used, "c_custkey", "left_anti")


@query("join_cross_spec", """with s as (select * from (values (0.2e0, 3e0), (0.2e0, 5e0), (0.3e0, 3e0), (0.3e0, 5e0)) t(threshold, strong_threshold))
       select threshold, strong_threshold, count(*) as n_cells, count(*) filter (where vlm_mm_yr <= -strong_threshold and (case when threshold = 0.2e0 then n_obs_20 else n_obs end) < 4) as hidden_cells
       from fx_flags, s where base group by threshold, strong_threshold""", "fx_flags")
def join_cross_spec(spark, d):
    """A short list of specs repeats each row without a join."""
    f = V.flags(spark, d, region=False, thresholds={"n_obs": 0.3, "n_obs_20": 0.2}).filter("base")
    specs = [{"threshold": t, "strong_threshold": s} for t in (0.2, 0.3) for s in (3.0, 5.0)]
    long = explode_specs(f.select("vlm_mm_yr", "n_obs", "n_obs_20"), specs)
    n = F.when(F.col("threshold") == 0.2, F.col("n_obs_20")).otherwise(F.col("n_obs"))
    return long.groupBy("threshold", "strong_threshold").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if((F.col("vlm_mm_yr") <= -F.col("strong_threshold")) & (n < 4)).alias("hidden_cells"))


@query("join_loo_theta", """select a.nation_id, sum(b.log_or / b.var) / sum(1e0 / b.var) as fixed_without, count(*) as k from fx_studies a join fx_studies b on a.nation_id <> b.nation_id group by a.nation_id""",
       "fx_studies", "fixed_without")
def join_loo_theta(spark, d):
    """Each study against all others, as totals less its own terms."""
    from ..runtime import with_scalars

    s = V.studies(spark, d).select("nation_id", (1.0 / F.col("var")).alias("w"), (F.col("log_or") / F.col("var")).alias("wy"))
    t = with_scalars(s, s.agg(F.sum("w").alias("tw"), F.sum("wy").alias("twy"), F.count(F.lit(1)).alias("n")))
    return t.select("nation_id", ((F.col("twy") - F.col("wy")) / (F.col("tw") - F.col("w"))).alias("fixed_without"), (F.col("n") - 1).alias("k"))


@query("union_tables", "select 'customer' as origin, c_custkey as id, c_acctbal as balance, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, s_acctbal, cast(null as varchar) from supplier", rnd="balance:2")
def union_tables(spark, d):
    c = V.table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = V.table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return ordering.union_all([c, s])


@query("union_panels", """select 'A' as panel, cast(nation_id as varchar) as region, exp(log_or) as estimate, exp(log_or - 1.96e0 * sqrt(var)) as low, exp(log_or + 1.96e0 * sqrt(var)) as high, n_cells from fx_studies
       union all select 'B', concat('without ', a.nation_id), exp(sum(b.log_or / b.var) / sum(1e0 / b.var)), null, null, null from fx_studies a join fx_studies b on a.nation_id <> b.nation_id group by a.nation_id
       union all select 'C', event_type, avg(case when value < 50e0 then 1e0 else 0e0 end), null, null, count(*) from events group by event_type""", "fx_studies", "estimate low high", "n_cells")
def union_panels(spark, d):
    """Three tables of different shape in one panel schema."""
    s = V.studies(spark, d)
    se = F.sqrt("var")
    a = s.select(F.lit("A").alias("panel"), F.col("nation_id").cast("string").alias("region"), F.exp("log_or").alias("estimate"),
                 F.exp(F.col("log_or") - 1.96 * se).alias("low"), F.exp(F.col("log_or") + 1.96 * se).alias("high"), "n_cells")
    b = join_loo_theta(spark, d).select(F.lit("B").alias("panel"), F.concat(F.lit("without "), F.col("nation_id").cast("string")).alias("region"), F.exp("fixed_without").alias("estimate"))
    c = V.table(spark, d, "events").groupBy(F.col("event_type").alias("region")).agg(
        F.avg((F.col("value") < 50).cast("double")).alias("estimate"), F.count(F.lit(1)).alias("n_cells")).withColumn("panel", F.lit("C"))
    return ordering.union_all([a, b, c])


@query("unpivot_shares", """with t as (select region_id, count(*) filter (where strong) / cast(count(*) as double) as strong_share, count(*) filter (where not majority) / cast(count(*) as double) as hidden_share,
         count(*) filter (where low25) / cast(count(*) as double) as low_share from fx_flags where base group by region_id)
       unpivot (select region_id, strong_share * 100e0 as strong_share, hidden_share * 100e0 as hidden_share, low_share * 100e0 as low_share from t) on strong_share, hidden_share, low_share into name share_metric value share_percent""",
       "fx_flags", "share_percent")
def unpivot_shares(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    t = V.flags(spark, d).filter("base").groupBy("region_id").agg(
        share(F.col("strong")).alias("strong_share"), share(~F.col("majority")).alias("hidden_share"), share(F.col("low25")).alias("low_share"))
    long = t.unpivot("region_id", ["strong_share", "hidden_share", "low_share"], "share_metric", "share_percent")
    return long.withColumn("share_percent", F.col("share_percent") * 100.0)


@query("set_overlap", """with a as (select cell_id from fx_flags where strong), b as (select cell_id from fx_flags where base and not majority)
       select 'overlap' as part, count(*) as n from (select * from a intersect select * from b) union all select 'a_only', count(*) from (select * from a except select * from b)
       union all select 'b_only', count(*) from (select * from b except select * from a)""", "fx_flags")
def set_overlap(spark, d):
    """Intersection and differences of two cell lists."""
    f = V.flags(spark, d, region=False).filter("base")
    a, b = f.filter("strong").select("cell_id"), f.filter("not majority").select("cell_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
    return ordering.union_all([n(a.intersect(b), "overlap"), n(a.exceptAll(b), "a_only"), n(b.exceptAll(a), "b_only")])


@query("dedupe_ordered", """select text, min(doc_id) as doc_id, arg_min(source, doc_id) as source, count(*) as copies from documents group by text""")
def dedupe_ordered(spark, d):
    """First occurrence of each whole text; digests are grouped, and only the first texts are fetched."""
    docs = V.table(spark, d, "documents")
    keyed = docs.withColumn("digest", F.sha2("text", 256))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.count(F.lit(1)).alias("copies"))
    # by digest and id, of which a repeated row is one, and NULL meets NULL
    texts = keyed.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), "text")
    found = first.join(texts, F.col("digest").eqNullSafe(F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return found.dropDuplicates(["digest", "doc_id"]).select("text", "doc_id", "source", "copies")


@query("region_evidence", EVIDENCE_SQL, EVIDENCE_VIEWS, "adjusted_or boot_q025 boot_q975 bias_or_minus_one_proxy dominant_landcover_fraction cropland_fraction built_up_fraction "
       "water_wetland_mangrove_fraction max_failure_rate station_median_up", "n_cells station_count n_pairs")
def region_evidence(spark, d):
    return evidence(spark, d)
