"""Queries for one-to-one joins, set differences and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import digests, joins
from ...operators.folds import shared_keys
from .registry import OBS, obs, r6, register, s6, table


def _manifest(spark, sf_dir):
    """Orders with an assignment; the last fold value depends on the priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("spatial_block_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("development")).otherwise(F.lit("embargo")).alias("split_role"),
        (F.col("o_custkey") % 5).cast("int").alias("outer_fold"), F.lit("1.0").alias("manifest_version"))


MANIFEST = (
    "manifest as (select cast(o_orderkey as varchar) as sample_id, o_orderpriority as spatial_block_id, "
    "cast(cast(o_orderdate as date) as varchar) as date, case when o_orderstatus = 'F' then 'development' else 'embargo' end as split_role, "
    "cast(o_custkey % 5 as int) as outer_fold from orders)"
)


def _data(spark, sf_dir, shift=0):
    """The same orders as observations. A shift renames ids; dates of large orders differ."""
    o = table(spark, sf_dir, "orders")
    late = F.when(F.col("o_totalprice") > 400000, F.date_add(F.col("o_orderdate").cast("date"), 1)).otherwise(F.col("o_orderdate").cast("date"))
    return o.select((F.col("o_orderkey") + shift).cast("string").alias("sample_id"), F.col("o_orderpriority").alias("spatial_block_id"),
                    late.cast("string").alias("date"), "o_totalprice")


def data_sql(shift):
    return (f"data as (select cast(o_orderkey + {shift} as varchar) as sample_id, o_orderpriority as spatial_block_id, "
            "cast(cast(o_orderdate as date) + case when o_totalprice > 400000 then 1 else 0 end as varchar) as date, o_totalprice from orders)")


register(
    "join_attach_manifest",
    lambda s, d: joins.attach_manifest(_data(s, d).drop("spatial_block_id"), _manifest(s, d)).withColumn("o_totalprice", r6("o_totalprice")),
    f"with {MANIFEST}, {data_sql(0)} select d.sample_id, d.date, {s6('o_totalprice', 'o_totalprice')}, m.spatial_block_id, m.split_role, "
    "m.outer_fold from data d left join manifest m on d.sample_id = m.sample_id",
)
register(
    "join_unassigned_rows",
    lambda s, d: joins.unassigned_rows(joins.reindex(_manifest(s, d), _data(s, d, 7)),
                                       ["split_role", "outer_fold"]),
    f"with {MANIFEST}, {data_sql(7)} select count(*) filter (where m.split_role is null) as split_role, count(*) filter "
    "(where m.outer_fold is null) as outer_fold from data d left join manifest m on d.sample_id = m.sample_id",
)
register(
    "join_attachment_faults",
    lambda s, d: joins.attachment_faults(_data(s, d, 7), _manifest(s, d).unionByName(_manifest(s, d))),
    f"with {MANIFEST}, {data_sql(7)} select 0 as repeated_data_ids, (select count(*) from manifest) as repeated_manifest_ids, "
    "count(*) filter (where m.sample_id is null) as unassigned_ids from data d left join manifest m on d.sample_id = m.sample_id",
)
register(
    "join_id_mismatches",
    lambda s, d: joins.id_mismatches(_manifest(s, d), _data(s, d, 7), compare=["spatial_block_id", "date"]),
    f"with {MANIFEST}, {data_sql(7)} select 0 as left_duplicates, 0 as right_duplicates, count(*) filter (where d.sample_id is null) as left_only, "
    "count(*) filter (where m.sample_id is null) as right_only, count(*) filter (where m.sample_id is not null and d.sample_id is not null and "
    "m.spatial_block_id <> d.spatial_block_id) as differing_spatial_block_id, count(*) filter (where m.date <> d.date) as differing_date "
    "from manifest m full join data d on m.sample_id = d.sample_id",
)
register(
    "join_align_manifest",
    lambda s, d: joins.align(_manifest(s, d), _data(s, d, 7)).drop("manifest_version"),
    f"with {MANIFEST}, {data_sql(7)} select * from manifest where sample_id in (select sample_id from data)",
)


def _stored(spark, sf_dir):
    """Stored predictions of the rows that have a component estimate; some labels moved."""
    moved = F.col("calculated_utci_c") + F.when(F.col("canopy_fraction") > 0.97, F.lit(0.01)).otherwise(F.lit(0.0))
    return obs(spark, sf_dir).filter("component_utci_c is not null").select(
        "sample_id", "component_utci_c", moved.alias("calculated_utci_c"))


STORED = (f"{OBS}, stored as (select sample_id, component_utci_c, calculated_utci_c + case when canopy_fraction > 97e-2 then 1e-2 else 0e0 end "
          "as calculated_utci_c from obs where component_utci_c is not null)")
register(
    "join_reindex_predictions",
    lambda s, d: joins.reindex(_stored(s, d).select("sample_id", "component_utci_c"), obs(s, d)).withColumn("component_utci_c", r6("component_utci_c")),
    f"{STORED} select o.sample_id, {s6('t.component_utci_c', 'component_utci_c')} from obs o left join stored t on o.sample_id = t.sample_id",
)
register(
    "join_label_differences",
    lambda s, d: joins.label_differences(_stored(s, d), obs(s, d), "calculated_utci_c"),
    f"{STORED} select count(*) as matched, count(*) filter (where abs(t.calculated_utci_c - o.calculated_utci_c) > 1e-8 + 1e-5 * "
    "abs(o.calculated_utci_c)) as differing from stored t join obs o on t.sample_id = o.sample_id",
)
register(
    "join_predictions",
    lambda s, d: joins.join_predictions(
        obs(s, d).select("sample_id", "direct_core", "calculated_utci_c"), obs(s, d).select("sample_id", "site_id", "calculated_utci_c"),
        label="calculated_utci_c").select("sample_id", "site_id", r6(F.nanvl("direct_core", F.lit(-1.0))).alias("direct_core"),
                                          r6("calculated_utci_c").alias("calculated_utci_c")),
    f"{OBS} select sample_id, site_id, {s6('case when isnan(direct_core) then -1 else direct_core end', 'direct_core')}, "
    f"{s6('calculated_utci_c', 'calculated_utci_c')} from obs",
)


def _merge(spark, sf_dir):
    o = obs(spark, sf_dir)
    core = o.filter("background_air_temperature_c < 35").select("sample_id", "calculated_utci_c", F.col("satellite_lst_c").alias("baseline_lst"))
    extra = o.filter("satellite_lst_c is not null").select("sample_id", "canopy_fraction", F.col("satellite_lst_c").alias("baseline_lst"))
    merged = joins.merge_predictions(core, extra)
    return merged.select("sample_id", *[r6(c).alias(c) for c in ("calculated_utci_c", "baseline_lst", "canopy_fraction")])


register(
    "join_merge_predictions", _merge,
    f"{OBS}, a as (select * from obs where background_air_temperature_c < 35), b as (select * from obs where satellite_lst_c is not null) "
    f"select coalesce(a.sample_id, b.sample_id) as sample_id, {s6('a.calculated_utci_c', 'calculated_utci_c')}, "
    f"{s6('coalesce(a.satellite_lst_c, b.satellite_lst_c)', 'baseline_lst')}, {s6('b.canopy_fraction', 'canopy_fraction')} "
    "from a full join b on a.sample_id = b.sample_id",
)


def _sides(spark, sf_dir):
    o = obs(spark, sf_dir)
    return o.filter("calculated_utci_c >= 45"), o.filter("calculated_utci_c < 25")


register(
    "join_shared_keys",
    lambda s, d: shared_keys(*_sides(s, d), {"block": "site_id", "date": "date", "event": "weather_event_id", "id": "sample_id"}),
    f"{OBS}, a as (select * from obs where calculated_utci_c >= 45), b as (select * from obs where calculated_utci_c < 25) "
    + " union all ".join(
        f"select '{n}' as key_type, count(*) as shared from (select distinct {c} as v from a where {c} is not null intersect select distinct {c} from b)"
        for n, c in (("block", "site_id"), ("date", "date"), ("event", "weather_event_id"), ("id", "sample_id"))),
)
register(
    "join_only_in_first",
    lambda s, d: joins.only_in_first(table(s, d, "customer").withColumnRenamed("c_custkey", "k"),
                                     table(s, d, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "k"), "k"),
    "select distinct c_custkey as k from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
)
register(
    "join_in_both",
    lambda s, d: joins.in_both(table(s, d, "customer").withColumnRenamed("c_custkey", "k"),
                               table(s, d, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "k"), "k"),
    "select c_custkey as k from customer intersect select o_custkey from orders where o_orderstatus = 'F'",
)

# ------------------------------------------------------------------------------- digests

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _piece(c):
    return f"coalesce(concat(cast(length(cast({c} as varchar)) as varchar), ':', cast({c} as varchar)), '-')"


def digest_sql(columns, source, keys=""):
    """Digest of the named columns of a relation."""
    text = "concat_ws('|', " + ", ".join(_piece(c) for c in sorted(columns)) + ")"
    sums = ", ".join(f"sum(cast(concat('0x', substr(h, {1 + 15 * i}, 15)) as hugeint)) as s{i}" for i in range(4))
    head = f"{keys}, " if keys else ""
    group = f" group by {keys}" if keys else ""
    return (f"select {head}n_rows, sha256(concat_ws('|', cast(n_rows as varchar), " + ", ".join(f"cast(s{i} as varchar)" for i in range(4))
            + f")) as digest from (select {head}count(*) as n_rows, {sums} from (select {head}sha256({text}) as h from {source}){group})")


register("digest_table", lambda s, d: digests.table_digest(table(s, d, "orders"), ORDER_COLUMNS), digest_sql(ORDER_COLUMNS, "orders"))
register(
    "digest_by_key", lambda s, d: digests.table_digest(table(s, d, "orders"), ORDER_COLUMNS, ["o_orderstatus"]),
    digest_sql(ORDER_COLUMNS, "orders", "o_orderstatus"),
)


def _named(spark, sf_dir, changed):
    """Digests of three inputs; orders change in one cell when asked."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    if changed:
        orders = orders.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") == 1, F.lit(1)).otherwise(F.lit(0)))
    parts = {"dataset": orders, "sites": table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
             "blocks": table(spark, sf_dir, "nation").select("n_nationkey", "n_name")}
    out = None
    for name, df in parts.items():
        one = digests.table_digest(df).select(F.lit(name).alias("name"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


_CHANGED = ("(select o_orderkey, o_custkey + case when o_orderkey = 1 then 1 else 0 end as o_custkey, o_orderstatus, o_orderpriority from orders)")
register(
    "digest_differences",
    lambda s, d: digests.digest_differences(_named(s, d, False), _named(s, d, True)),
    f"select 'dataset' as name, a.digest as expected, b.digest as observed from ({digest_sql(ORDER_COLUMNS, 'orders')}) a, "
    f"({digest_sql(ORDER_COLUMNS, _CHANGED)}) b where a.digest <> b.digest",
)
register(
    "digest_files",
    lambda s, d: digests.file_digests(s, f"{d}/orders.parquet").select("length", F.length("digest").alias("digest_length")),
)
