"""Queries for fold assignment, embargo, roles and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.grid import with_blocks
from ...functions.heat import heat_category
from ...functions.physics import heat_index
from ...operators import folds, manifest, metrics, roles
from ...session import materialise
from .expressions import BLOCK_SQL, HEAT_INDEX_SQL, TIME_GROUP_SQL, category_sql
from .registry import LINES, OBS, lines, obs, r6, register, s6

SEED = 42
SPLIT = folds.SplitDesign(n_folds=5, seed=SEED)
KEYED = f"{OBS}, src as (select *, {BLOCK_SQL} as block, date as day, weather_event_id as event, {TIME_GROUP_SQL} as time_key from obs)"


def _blocked(spark, sf_dir):
    return with_blocks(obs(spark, sf_dir))


# ------------------------------------------------------------------------ SQL of the splitter


def greedy_sql(name: str, source: str, key: str, n: int, seed: int, salt: str) -> str:
    """CTEs that end in ``name(g, n, fold)``: the sequential rule as a recursion."""
    totals = [f"t{i}" for i in range(n)]
    pick = f"case when o.rn <= {n} then o.rn - 1 "
    for i in range(n - 1):
        rest = ", ".join(f"p.{t}" for t in totals[i + 1:])
        pick += f"when p.t{i} <= least({rest}) then {i} " if i < n - 2 else f"when p.t{i} <= p.t{i + 1} then {i} "
    pick += f"else {n - 1} end"
    return (
        f"{name}_g as (select {key} as g, count(*) as n from {source} group by 1), "
        f"{name}_o as (select *, row_number() over (order by sha256(concat('{seed}|{salt}|', g))) as rn from {name}_g), "
        f"{name}_r as (select cast(0 as bigint) as rn, cast(null as varchar) as g, cast(-1 as bigint) as fold, "
        + ", ".join(f"cast(0 as bigint) as {t}" for t in totals)
        + " union all select rn, g, fold, "
        + ", ".join(f"t{i} + case when fold = {i} then n else 0 end" for i in range(n))
        + f" from (select o.rn, o.g, o.n, {pick} as fold, " + ", ".join(f"p.{t}" for t in totals)
        + f" from {name}_r p join {name}_o o on o.rn = p.rn + 1)), "
        f"{name} as (select o.g, o.n, cast(r.fold as int) as fold from {name}_r r join {name}_o o on o.g = r.g)"
    )


def split_sql(name: str, source: str, n: int, seed: int, keep: str = "sample_id", days: int = 0) -> str:
    """CTEs that end in ``name(keep, fold, part)`` over a source with block, day, event, time_key."""
    choose = ", ".join(f"p{i}.v as p{i}" for i in range(n))
    perms = " cross join ".join(f"(select unnest(range({n})) as v) p{i}" for i in range(n))
    distinct = " and ".join(f"p{i}.v <> p{j}.v" for i in range(n) for j in range(i))
    sizes = ", ".join(
        f"coalesce((select c.n from {name}_c c where c.bf = {i} and c.tf = p{i}), 0) as s{i}" for i in range(n)
    )
    low = "least(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    high = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    order = ", ".join([f"{low} desc", f"{low} - {high} desc", *[f"s{i}" for i in range(n)], *[f"p{i}" for i in range(n)]])
    pairs = " union all ".join(f"select {i} as f, p{i} as tf from {name}_best" for i in range(n))
    held_days = (
        f"select distinct fold, day from {name}_v" if not days else
        f"select distinct fold, cast(cast(day as date) + cast(x as int) as varchar) as day from {name}_v, (select unnest(range({-days}, {days + 1})) as x)"
    )
    return (
        greedy_sql(f"{name}_b", source, "block", n, seed, "spatial_block") + ", "
        + greedy_sql(f"{name}_t", source, "time_key", n, seed, "weather_event") + ", "
        f"{name}_k as (select s.*, b.fold as bf, t.fold as tf from {source} s join {name}_b b on s.block = b.g join {name}_t t on s.time_key = t.g), "
        f"{name}_c as (select bf, tf, count(*) as n from {name}_k group by 1, 2), "
        f"{name}_perm as (select {choose} from {perms} where {distinct}), "
        f"{name}_best as (select * from (select *, {sizes} from {name}_perm) order by {order} limit 1), "
        f"{name}_pair as ({pairs}), "
        f"{name}_m as (select k.*, case when p.tf is not null then k.bf end as fold from {name}_k k left join {name}_pair p on k.bf = p.f and k.tf = p.tf), "
        f"{name}_v as (select * from {name}_m where fold is not null), "
        f"{name}_hb as (select distinct fold, block from {name}_v), {name}_hd as ({held_days}), "
        f"{name}_he as (select distinct fold, event from {name}_v where event is not null), "
        f"{name} as (select m.{keep.replace(', ', ', m.')}, cast(f.f as int) as fold, case when m.fold = f.f then 'validation' "
        "when hb.fold is not null or hd.fold is not null or he.fold is not null then 'embargo' else 'train' end as part "
        f"from {name}_m m cross join (select unnest(range({n})) as f) f left join {name}_hb hb on hb.fold = f.f and hb.block = m.block "
        f"left join {name}_hd hd on hd.fold = f.f and hd.day = m.day left join {name}_he he on he.fold = f.f and he.event = m.event)"
    )


def recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


# ------------------------------------------------------------------------------- assignment

register(
    "split_balanced_groups",
    lambda s, d: folds.balanced_folds(lines(s, d), "site", 5, SEED, "space"),
    recursive(f"{LINES}, {greedy_sql('a', 'lines', 'site', 5, SEED, 'space')} select g as \"group\", n as rows, fold from a"),
)


def _row_folds(spark, sf_dir):
    """Rows per fold and day after the group folds are looked up."""
    assigned = materialise(folds.balanced_folds(lines(spark, sf_dir), "site", 5, SEED, "space"), "assigned")
    rows = folds.join_lookup(lines(spark, sf_dir), assigned.select(F.col("group").alias("site"), "fold"), ["site"], "inner")
    return rows.groupBy("fold", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


register(
    "split_group_lookup", _row_folds,
    recursive(f"{LINES}, {greedy_sql('a', 'lines', 'site', 5, SEED, 'space')} select fold, l_returnflag, count(*) as n from lines l join a on a.g = l.site "
              "group by 1, 2"),
)


def _contingency(spark, sf_dir):
    df = _blocked(spark, sf_dir)
    cells = folds.cells_of(df, SPLIT)
    return folds.contingency(folds.folded_cells(cells, SPLIT, "weather_event"))


register(
    "split_contingency", _contingency,
    recursive(f"{KEYED}, {greedy_sql('b', 'src', 'block', 5, SEED, 'spatial_block')}, {greedy_sql('t', 'src', 'time_key', 5, SEED, 'weather_event')} "
              "select b.fold as block_fold, t.fold as time_fold, count(*) as rows from src join b on src.block = b.g join t on src.time_key = t.g group by 1, 2"),
)


def _pairing(spark, sf_dir):
    cells = folds.cells_of(_blocked(spark, sf_dir), SPLIT)
    folded = folds.folded_cells(cells, SPLIT, "weather_event").filter("fold is not null")
    return folded.groupBy("block_fold", "time_fold").agg(F.sum("rows").alias("rows"))


_SPLIT = split_sql("sp", "src", 5, SEED)
register("split_pairing", _pairing,
         recursive(f"{KEYED}, {_SPLIT} select bf as block_fold, tf as time_fold, count(*) as rows from sp_v group by 1, 2"))
register("split_with_embargo", lambda s, d: folds.split_with_embargo(_blocked(s, d), SPLIT), recursive(f"{KEYED}, {_SPLIT} select * from sp"))
register(
    "split_embargo_days",
    lambda s, d: folds.split_with_embargo(_blocked(s, d), folds.SplitDesign(n_folds=5, seed=SEED, embargo_days=1)),
    recursive(f"{KEYED}, {split_sql('sp', 'src', 5, SEED, days=1)} select * from sp"),
)


def _labels(spark, sf_dir):
    df = _blocked(spark, sf_dir)
    rows = folds.with_parts(df, folds.dual_blocked_parts(df, SPLIT), SPLIT)
    return materialise(rows.withColumn("outer_fold", F.coalesce(folds.validation_fold(), F.lit(-1))).drop("folds"), "labels")


register("split_frozen_folds", lambda s, d: folds.frozen_folds(_labels(s, d), SPLIT), recursive(f"{KEYED}, {_SPLIT} select * from sp"))


def _overlaps(spark, sf_dir):
    df = _blocked(spark, sf_dir)
    return folds.fold_overlaps(df, folds.split_with_embargo(df, SPLIT), SPLIT)


_KEY_ROWS = " union all ".join(
    f"select fold, part, '{n}' as key_type, s.{c} as v from sp join src s on s.sample_id = sp.sample_id where s.{c} is not null and part <> 'embargo'"
    for n, c in (("block", "block"), ("date", "day"), ("event", "event"))
)
register(
    "split_fold_overlaps", _overlaps,
    recursive(f"{KEYED}, {_SPLIT}, kr as ({_KEY_ROWS}), g as (select fold, key_type, v, count(distinct part) as sides from kr group by 1, 2, 3) "
              "select fold, key_type, count(*) filter (where sides = 2) as shared from g group by 1, 2"),
)


def _cell_overlaps(spark, sf_dir):
    return folds.part_overlaps(folds.dual_blocked_parts(_blocked(spark, sf_dir), SPLIT))


register(
    "split_cell_overlaps", _cell_overlaps,
    recursive(f"{KEYED}, {_SPLIT}, kr as ({_KEY_ROWS}), g as (select fold, key_type, v, count(distinct part) as sides from kr group by 1, 2, 3) "
              "select fold, key_type, count(*) filter (where sides = 2) as shared from g group by 1, 2"),
)


def _nested(spark, sf_dir):
    df = _blocked(spark, sf_dir)
    design = folds.SplitDesign(n_folds=2, seed=SEED)
    rows = folds.with_parts(df, folds.dual_blocked_parts(df, design), design)
    return folds.nested_folds(rows, design, 2)


_INNER = ", ".join(
    f"in{f} as (select s.* from src s join sp on sp.sample_id = s.sample_id where sp.fold = {f} and sp.part = 'train'), "
    + split_sql(f"n{f}", f"in{f}", 2, SEED + 10007) for f in range(2)
)
register(
    "split_nested", _nested,
    recursive(f"{KEYED}, {split_sql('sp', 'src', 2, SEED)}, {_INNER} " + " union all ".join(
        f"select sample_id, {f} as outer_fold, fold, part from n{f}" for f in range(2))),
)

# ------------------------------------------------------------------------------------ roles


def _first(name: str, source: str, key: str, count: str, salt: str) -> str:
    return (f"{name} as (select {key} from (select {key}, row_number() over (order by sha256(concat('{SEED}|{salt}|', {key}))) as rn from {source}) "
            f"where rn <= {count})")


ROLES = (
    f"{KEYED}, bl as (select distinct block from src), nb as (select count(*) as n from bl), "
    "ti as (select time_key, max(case when calculated_utci_c >= 32 then 1 else 0 end) as hot from src group by 1), nt as (select count(*) as n, "
    "sum(hot) as h from ti), "
    + _first("fb", "bl", "block", "(select greatest(4, ceil(n * 15e-2)) from nb)", "final_spatial") + ", "
    "rb as (select * from bl where block not in (select block from fb)), "
    + _first("cb", "rb", "block", "(select greatest(1, ceil(n * 15e-2)) from nb)", "calibration_spatial") + ", "
    "ho as (select * from ti where hot = 1), " + _first("fh", "ho", "time_key", "2", "final_hot_time") + ", "
    "rt as (select * from ti where time_key not in (select time_key from fh)), "
    + _first("fo", "rt", "time_key", "(select greatest(ceil(n * 15e-2), 2) - (select count(*) from fh) from nt)", "final_time") + ", "
    "ft as (select * from fh union all select * from fo), ct0 as (select * from ti where time_key not in (select time_key from ft)), "
    + _first("ct", "ct0", "time_key", "(select greatest(1, ceil(n * 15e-2)) from nt)", "calibration_time") + ", "
    "roled as (select src.*, case when block in (select block from fb) then 'final_test' when block in (select block from cb) then 'calibration' "
    "else 'development' end as br, case when time_key in (select time_key from ft) then 'final_test' when time_key in (select time_key from ct) then "
    "'calibration' else 'development' end as tr from src), assigned as (select *, case when br = tr then br else 'embargo' end as split_role from roled)"
)
register("role_assignment", lambda s, d: roles.assign_roles(_blocked(s, d), SPLIT).select("sample_id", "split_role"),
         f"{ROLES} select sample_id, split_role from assigned")


def _supplied(spark, sf_dir):
    """Roles by site number and day, with a few leaks for the checks to find."""
    site, day = F.col("site_id").cast("int") % 10, F.dayofmonth(F.col("date").cast("date"))
    role = (
        F.when((site < 2) & (day <= 5), F.lit("final_test")).when((site == 2) & (day.between(6, 9)), F.lit("calibration"))
        .when((site > 2) & (day > 8), F.lit("development")).when((site == 1) & (day == 20), F.lit("development")).otherwise(F.lit("embargo"))
    )
    return _blocked(spark, sf_dir).withColumn("split_role", role)


SUPPLIED = (
    f"{KEYED}, sup as (select *, case when cast(site_id as int) % 10 < 2 and day(cast(date as date)) <= 5 then 'final_test' when cast(site_id as int) % 10 = 2 "
    "and day(cast(date as date)) between 6 and 9 then 'calibration' when cast(site_id as int) % 10 > 2 and day(cast(date as date)) > 8 then 'development' "
    "when cast(site_id as int) % 10 = 1 and day(cast(date as date)) = 20 then 'development' else 'embargo' end as split_role from src)"
)
_PAIRS = (("calibration", "development"), ("final_test", "development"), ("calibration", "final_test"))
register(
    "role_overlaps", lambda s, d: roles.role_overlaps(_supplied(s, d), SPLIT),
    f"{SUPPLIED} " + " union all ".join(
        f"select '{n}' as key_type, '{a}' as left_role, '{b}' as right_role, count(*) as shared from (select {c} from sup where split_role = '{a}' and {c} is not null "
        f"intersect select {c} from sup where split_role = '{b}')"
        for n, c in (("block", "block"), ("date", "day"), ("event", "event")) for a, b in _PAIRS),
)
register(
    "role_final_design", lambda s, d: roles.final_design(_supplied(s, d), SPLIT),
    f"{SUPPLIED}, f as (select * from sup where split_role = 'final_test'), hd as (select distinct day from f where calculated_utci_c >= 32), c as ("
    "select 'final_sites' as requirement, count(distinct site_id) as observed, 4 as required from f union all select 'final_blocks', count(distinct block), 4 from f "
    "union all select 'hot_dates', count(*), 1 from hd union all select 'reused_final_sites', count(*), 0 from (select site_id from f intersect select site_id from sup "
    "where split_role in ('development', 'calibration')) union all select 'partly_final_hot_dates', count(*), 0 from (select distinct day from sup where split_role not in "
    "('final_test', 'embargo') and day in (select day from hd))) select *, case when required > 0 then observed >= required else observed = 0 end as passed from c",
)
register(
    "role_rows", lambda s, d: roles.role_rows(_supplied(s, d), "final_test").select("sample_id"),
    f"{SUPPLIED} select sample_id from sup where split_role = 'final_test' and lower(trim(quality_flag)) = 'pass'",
)
register(
    "role_distinct_counts",
    lambda s, d: roles.distinct_counts(_supplied(s, d), SPLIT),
    f"{SUPPLIED} select split_role, count(distinct site_id) as sites, count(distinct block) as blocks, count(distinct day) filter "
    "(where calculated_utci_c >= 32) as hot_dates from sup group by 1",
)

# --------------------------------------------------------------------------------- manifest

_DEV = "dev as (select * from assigned where split_role = 'development')"
MANIFEST_SQL = recursive(f"{ROLES}, {_DEV}, {split_sql('sp', 'dev', 5, SEED)}")
register(
    "manifest_create", lambda s, d: manifest.create_manifest(_blocked(s, d), SPLIT).select("sample_id", "spatial_block_id", "split_role", "outer_fold"),
    f"{MANIFEST_SQL} select a.sample_id, a.block as spatial_block_id, a.split_role, coalesce(v.fold, -1) as outer_fold from assigned a left join sp_v v "
    "on v.sample_id = a.sample_id",
)


def _findings(spark, sf_dir):
    """A manifest checked against a table in which some ids and dates changed."""
    df = _blocked(spark, sf_dir)
    stored = materialise(manifest.create_manifest(df, SPLIT), "manifest")
    renamed = F.when(F.col("canopy_fraction") > 0.98, F.concat(F.lit("x"), F.col("sample_id"))).otherwise(F.col("sample_id"))
    moved = F.when(F.col("canopy_fraction") < 0.02, F.lit("2000-01-01")).otherwise(F.col("date"))
    return manifest.manifest_findings(stored, df.withColumns({"sample_id": renamed, "date": moved}), SPLIT)


register(
    "manifest_findings", _findings,
    # A renamed row has no measured value, so the final design is judged without it.
    f"{ROLES}, c as (select count(*) filter (where canopy_fraction > 98e-2) as r, count(*) filter (where canopy_fraction < 2e-2) as m from obs), "
    "f as (select * from assigned where split_role = 'final_test'), hd as (select distinct day from f where calculated_utci_c >= 32 and "
    "coalesce(canopy_fraction, 0) <= 98e-2), others as (select * from assigned where split_role in ('development', 'calibration')) "
    "select 'left_duplicates' as check_name, 0 as failures from c union all select 'right_duplicates', 0 from c union all select 'left_only', r from c "
    "union all select 'right_only', r from c union all select 'differing_spatial_block_id', 0 from c union all select 'differing_date', m from c "
    "union all select 'unknown_roles', 0 from c union all select 'keys_shared_by_roles', 0 from c union all select 'keys_shared_by_folds', 0 from c "
    "union all select 'final_design_final_sites', case when count(distinct site_id) >= 4 then 0 else 1 end from f "
    "union all select 'final_design_final_blocks', case when count(distinct block) >= 4 then 0 else 1 end from f "
    "union all select 'final_design_hot_dates', case when count(*) >= 1 then 0 else 1 end from hd "
    "union all select 'final_design_reused_final_sites', case when count(*) = 0 then 0 else 1 end from (select site_id from f intersect select site_id from others) "
    "union all select 'final_design_partly_final_hot_dates', case when count(*) = 0 then 0 else 1 end from (select day from others intersect select day from hd)",
)

# --------------------------------------------------------------------------------- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, dual-blocked folds, heat-index prediction of every validation row, error by category."""
    df = _blocked(spark, sf_dir)
    rows = folds.with_parts(df, folds.dual_blocked_parts(df, SPLIT), SPLIT)
    held = rows.withColumn("fold", folds.validation_fold()).filter("fold is not null").withColumn(
        "heat_index", heat_index("background_air_temperature_c", "background_relative_humidity_pct"))
    long = metrics.long_predictions(held, "calculated_utci_c", ["heat_index"], ["fold"])
    keyed = long.withColumn("category", heat_category("truth"))
    report = metrics.regression_report(keyed, ["fold", "category"], with_spearman=False)
    return report.select("fold", "category", "n", "n_omitted", *[r6(c).alias(c) for c in ("mae", "rmse", "mean_bias")])


register(
    "fold_error_by_category", flagship,
    recursive(f"{KEYED}, {_SPLIT}, h as ({HEAT_INDEX_SQL}), e as (select v.fold, {category_sql('v.calculated_utci_c')} as category, "
              "(h.hf - 32) * 5 / 9e0 - v.calculated_utci_c as d from sp_v v join h on h.sample_id = v.sample_id) select fold, category, count(d) as n, "
              f"count(*) - count(d) as n_omitted, {s6('avg(abs(d))', 'mae')}, {s6('sqrt(avg(d * d))', 'rmse')}, {s6('avg(d)', 'mean_bias')} from e group by 1, 2"),
)
