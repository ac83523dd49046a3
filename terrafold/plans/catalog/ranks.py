"""Queries for ranks, order statistics, hash order and the block bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.grid import with_blocks
from ...operators import bootstrap, order_stats
from ...operators.quality import duplicate_members
from .expressions import BLOCK_SQL
from .registry import LINES, OBS, lines, obs, r6, register, s6, table


def _residuals(spark, sf_dir):
    return lines(spark, sf_dir).select("l_returnflag", r6(F.abs(F.col("prediction") - F.col("truth"))).alias("residual"))


RESIDUALS = f"{LINES}, res as (select l_returnflag, round(abs(prediction - truth), 6) + 0e0 as residual from lines)"

register(
    "rank_duplicate_members",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(
        duplicate_members(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"]),
    "select l_orderkey, l_linenumber, l_partkey, members from (select *, count(*) over (partition by l_orderkey, l_linenumber) as members "
    "from lineitem) where members > 1",
)
register(
    "rank_average",
    lambda s, d: order_stats.average_ranks(_residuals(s, d), "residual", ["l_returnflag"]).select(
        "l_returnflag", "residual", "n", "avg_rank"),
    f"{RESIDUALS} select l_returnflag, residual, count(*) as n, avg(rn) as avg_rank from (select *, row_number() over "
    "(partition by l_returnflag order by residual) as rn from res) group by 1, 2",
)
register(
    "rank_conformal_radius",
    lambda s, d: order_stats.conformal_radius(_residuals(s, d), "residual", 0.1, 20).select("n_calibration", "k", "radius", "bounded"),
    f"{RESIDUALS}, k as (select count(*) as n, cast(ceil((count(*) + 1) * (1 - 1e-1)) as bigint) as k from res) select n as n_calibration, k, "
    "residual as radius, true as bounded from (select *, row_number() over (order by residual) as rn from res), k where rn = k",
)
register(
    "rank_conformal_unbounded",
    lambda s, d: order_stats.conformal_radius(table(s, d, "region").select((F.col("r_regionkey") / 10.0).alias("residual")), "residual", 0.1, None)
    .unionByName(order_stats.conformal_radius(_residuals(s, d), "residual", 0.1, 10**9)).select("n_calibration", "k", "radius", "bounded"),
    f"{RESIDUALS} select count(*) as n_calibration, cast(ceil((count(*) + 1) * (1 - 1e-1)) as bigint) as k, cast('inf' as double) as radius, "
    "false as bounded from region union all select count(*), cast(ceil((count(*) + 1) * (1 - 1e-1)) as bigint), cast('inf' as double), false from res",
)
register(
    "rank_kth_by_group",
    lambda s, d: order_stats.kth_smallest(_residuals(s, d), "residual", F.floor(F.col("n_total") / 3) + 1, ["l_returnflag"]),
    f"{RESIDUALS} select l_returnflag, residual from (select *, row_number() over (partition by l_returnflag order by residual) as rn, "
    "count(*) over (partition by l_returnflag) as n from res) where rn = cast(floor(n / 3e0) as bigint) + 1",
)
register(
    "rank_disagreement_threshold",
    lambda s, d: order_stats.disagreement_threshold(obs(s, d), "direct_core", "component_utci_c", "development_oof").withColumn(
        "threshold_c", r6("threshold_c")),
    f"{OBS}, g as (select abs(direct_core - component_utci_c) as gap from obs where isfinite(direct_core) and component_utci_c is not null), "
    "r as (select gap, row_number() over (order by gap) as rn, count(*) over () as n from g) "
    f"select {s6('gap', 'threshold_c')}, n as n_pairs, n >= 20 as enough_pairs from r where rn = cast(ceil(95e-2 * (n - 1)) as bigint) + 1",
)
register(
    "rank_hash_order",
    lambda s, d: order_stats.hash_ranks(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("g")), "g", 42, "final_spatial")
    .join(F.broadcast(table(s, d, "customer").agg(F.ceil(F.lit(0.15) * F.count(F.lit(1))).alias("share")))).filter("hash_rank < share").drop("share"),
    "select g, cast(hash_rank as bigint) as hash_rank from (select cast(c_custkey as varchar) as g, row_number() over (order by "
    "sha256(concat('42|final_spatial|', cast(c_custkey as varchar)))) - 1 as hash_rank from customer) where hash_rank < (select ceil(15e-2 * count(*)) from customer)",
)
register(
    "rank_linear_quantiles",
    lambda s, d: order_stats.linear_quantiles(_residuals(s, d), "residual", [0.02, 0.5, 0.98], ["l_returnflag"]).select(
        "l_returnflag", *[r6(f"q{i}").alias(f"q{i}") for i in range(3)]),
    f"{RESIDUALS} select l_returnflag, " + ", ".join(s6(f"quantile_cont(residual, {p})", f"q{i}") for i, p in enumerate((0.02, 0.5, 0.98)))
    + " from res group by 1",
)


def _column_medians(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    df = table(spark, sf_dir, "lineitem")
    found = order_stats.column_quantiles(df, columns, 0.5)
    return df.groupBy("l_returnflag").agg(*[F.count_if(F.col(c) < found[c]).alias(f"{c}_below") for c in columns],
                                          *[F.max(F.lit(round(found[c], 6))).alias(f"{c}_median") for c in columns])


register(
    "rank_column_medians", _column_medians,
    "with m as (select median(l_quantity) as a, median(l_extendedprice) as b, median(l_discount) as c from lineitem) select l_returnflag, "
    "count(*) filter (where l_quantity < a) as l_quantity_below, count(*) filter (where l_extendedprice < b) as l_extendedprice_below, "
    "count(*) filter (where l_discount < c) as l_discount_below, round(any_value(a), 6) as l_quantity_median, round(any_value(b), 6) as "
    "l_extendedprice_median, round(any_value(c), 6) as l_discount_median from lineitem, m group by 1",
)
register(
    "rank_tree_count",
    lambda s, d: order_stats.selected_tree_count(
        table(s, d, "orders").select("o_orderstatus", (F.col("o_custkey") % 1700).alias("trees")), "trees", 300, 1500, ["o_orderstatus"]),
    "select o_orderstatus, least(1500, greatest(300, cast(floor(median(o_custkey % 1700) + 5e-1) as bigint))) as tree_count from orders group by 1",
)
register(
    "rank_hash_sample",
    lambda s, d: order_stats.hash_sample(obs(s, d), 200, 7).select("sample_id", "site_id"),
    f"{OBS} select sample_id, site_id from obs order by sha256(concat('7|sample|', sample_id)) limit 200",
)
register(
    "rank_dense_index",
    lambda s, d: order_stats.dense_index(table(s, d, "orders").withColumn("k", F.col("o_orderkey").cast("string")), "k"),
    "select cast(o_orderkey as varchar) as k, row_number() over (order by cast(o_orderkey as varchar)) - 1 as position from orders",
)

# ------------------------------------------------------------------------------ bootstrap

REPLICATES, SEED = 2000, 2026


def _bootstrap(location, weighting, metric):
    def run(spark, sf_dir):
        df = with_blocks(obs(spark, sf_dir))
        out = bootstrap.block_bootstrap(df, "calculated_utci_c", "direct_core", "background_air_temperature_c", [location, "date"],
                                        metric, weighting, REPLICATES, 0.95, SEED)
        return out.select("metric", "weighting", *[r6(c).alias(c) for c in ("point", "lower", "upper")],
                          "n_bootstrap", "n_observations", "n_blocks")

    return run


def _loss(prefix, metric, n):
    return f"({prefix}_abs / {n})" if metric == "mae" else f"sqrt({prefix}_sq / {n})"


def bootstrap_sql(location, weighting, metric):
    gain = f"{_loss('base', metric, 'n')} - {_loss('model', metric, 'n')}"
    blocks = (
        f"{OBS}, b as (select concat({location}, '|', date) as k, count(*) as n, sum(abs(direct_core - calculated_utci_c)) as model_abs, "
        "sum(abs(background_air_temperature_c - calculated_utci_c)) as base_abs, sum(pow(direct_core - calculated_utci_c, 2)) as model_sq, "
        "sum(pow(background_air_temperature_c - calculated_utci_c, 2)) as base_sq from obs where isfinite(direct_core) group by 1), "
        "numbered as (select *, row_number() over (order by k) - 1 as position from b), size as (select count(*) as nb from b), "
        "drawn as (select r.replicate, d.draw, sha256(concat('2026|', cast(r.replicate as varchar), '|', cast(d.draw // 4 as varchar))) as h, nb from "
        f"(select unnest(range({REPLICATES})) as replicate) r, (select unnest(range((select nb from size))) as draw) d, size), "
        "picked as (select replicate, cast(concat('0x', substr(h, cast(1 + 15 * (draw % 4) as int), 15)) as bigint) % nb as position from drawn)"
    )
    if weighting == "block_balanced":
        samples = f"select replicate, avg({gain}) as g from picked join numbered using (position) group by 1"
        point = f"select avg({gain}) as point, sum(n) as no from b"
    else:
        total = gain.replace("model_", "sum(model_").replace("base_", "sum(base_").replace("abs /", "abs) /").replace("sq /", "sq) /").replace("/ n)", "/ sum(n))")
        samples = f"select replicate, {total} as g from picked join numbered using (position) group by 1"
        point = f"select {total} as point, sum(n) as no from b"
    return (
        f"{blocks}, samples as ({samples}), p as ({point}) select '{metric}' as metric, '{weighting}' as weighting, {s6('any_value(point)', 'point')}, "
        f"{s6('quantile_cont(g, 0.025)', 'lower')}, {s6('quantile_cont(g, 0.975)', 'upper')}, count(*) as n_bootstrap, "
        "cast(any_value(no) as bigint) as n_observations, (select nb from size) as n_blocks from samples, p"
    )


for _name, _location, _sql_location in (("spatial_day", "spatial_block_id", BLOCK_SQL), ("site_day", "site_id", "site_id")):
    for _weighting in ("observation_weighted", "block_balanced"):
        register(f"bootstrap_{_name}_{_weighting}", _bootstrap(_location, _weighting, "mae"), bootstrap_sql(_sql_location, _weighting, "mae"))
register("bootstrap_site_day_rmse", _bootstrap("site_id", "observation_weighted", "rmse"), bootstrap_sql("site_id", "observation_weighted", "rmse"))
