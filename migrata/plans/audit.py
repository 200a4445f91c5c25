"""Output audits and score tables (A1-A10).

* ``output_summary`` (A1) and ``shotgun`` (A2) are one aggregate per table.
* ``partition_ablation`` (A3) stores the check table and reads the narrow rows of the located join
  that the checks stored, each evaluated once, takes per-sub-table partial sums of every axis from them and recombines
  these for each scenario (all, none, each sub removed, each sub alone) through a small join on
  the sub name; no scenario is regraded.
* Score tables over a ``runs`` frame (A4-A9) are grouped aggregates; ranking uses the
  skew-safe ``rank_within`` so a tier holding most runs is still split across tasks.
* ``fingerprint`` (A10) is an order-insensitive sum of SHA-256 row hashes plus a count.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import rank_within
from ..spec import ALPHA, WEIGHTS
from ..functions.fields import field_map, id_value
from .verify import AXES, Verifier, union_all


# ---------------------------------------------------------------------------
# A1 / A2
# ---------------------------------------------------------------------------
def output_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A1: rows, unique ids (a null id counts as one value) and duplicates per table."""
    parts = []
    for name in sorted(tables):
        df = tables[name]
        idc = id_value(field_map(df.schema).get("id"))
        agg = df.select(idc.alias("__id")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.count_distinct("__id") + F.max(F.when(F.col("__id").isNull(), 1).otherwise(0))).alias("unique_ids"))
        parts.append(agg.select(F.lit(name).alias("table_name"), "n_rows",
                                F.coalesce(F.col("unique_ids"), F.lit(0)).cast("bigint").alias("unique_ids"),
                                (F.col("n_rows") - F.coalesce(F.col("unique_ids"), F.lit(0))).cast("bigint")
                                .alias("duplicates")))
    spark = next(iter(tables.values())).sparkSession
    return union_all(spark, parts, "table_name string, n_rows bigint, unique_ids bigint, duplicates bigint")


def shotgun(source: Mapping[str, DataFrame], dest: Mapping[str, DataFrame]) -> DataFrame:
    """A2: dest tables not in the source whose row count equals all source rows together."""
    spark = next(iter(dest.values())).sparkSession
    src_parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("__source").alias("table_name"), "n",
                                                              F.lit(True).alias("is_src")) for df in source.values()]
    dst_parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n",
                                                             F.lit(t in source).alias("is_src"))
                 for t, df in sorted(dest.items())]
    allp = union_all(spark, src_parts + dst_parts, "table_name string, n bigint, is_src boolean")
    # a window over the small table of per-table counts carries the source total to every row
    total = F.sum(F.when(F.col("table_name") == "__source", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    out = allp.withColumn("source_rows", total).filter(F.col("table_name") != "__source")
    return out.select("table_name", F.col("n").alias("n_rows"), "source_rows",
                      ((~F.col("is_src")) & (F.col("n") == F.col("source_rows"))).alias("shotgun"))


# ---------------------------------------------------------------------------
# A3 partition ablation
# ---------------------------------------------------------------------------
def partition_ablation(v: Verifier, entity: str) -> DataFrame:
    """A3: scores with each sub-table removed, each alone, all and none (one row per scenario)."""
    part = v.ctx.partition_of[entity]
    subs = part.subs
    spark = v.spark
    checks = v.store_parts().checks()
    dep = ((F.col("entity") == entity) & F.col("check").isin(
        "v_cov_part_recall", "v_cov_part_false_pos", "v_fid_partition", "v_rel_refs")) | (
        F.col("check").isin("v_str_jaccard", "v_type") & F.col("entity").isin(*subs))
    short = dict(zip(AXES, ("cov", "fid", "rel", "typ", "str")))
    base = checks.filter(~dep).agg(*[
        F.coalesce(F.sum(F.when(F.col("axis") == ax, F.col(c))), F.lit(0.0)).alias(f"{short[ax]}_{c[0]}_k")
        for ax in AXES for c in ("hits", "total")])
    # per-sub partial sums from the located join, as the checks stored it
    refs = v.schema.refs(entity)
    i1 = lambda c: F.when(c, 1).otherwise(0)
    rows = v.located_rows(entity)
    per = rows.select("sub", i1(F.col("x")).alias("n_x"), i1(F.col("x") & F.col("d")).alias("rec_h"),
                      i1(F.col("d") & ~F.col("x")).alias("fp"), "fid_t", "fid_h")
    m = per.groupBy("sub").agg(*[F.sum(c).cast("double").alias(c) for c in ("n_x", "rec_h", "fp", "fid_t", "fid_h")])
    if "cands" in rows.columns:
        c = rows.select("sub", F.explode("cands").alias("c"))
        c = c.groupBy("sub", F.col("c.target").alias("target"), F.col("c.value").alias("value")).agg(
            F.count(F.lit(1)).alias("n"))
        ids = v.target_ids([t for _, t in refs]).select(F.col("target").alias("__t"), F.col("id").alias("__tid"))
        rh = c.join(ids, (c["target"] == ids["__t"]) & (c["value"] == ids["__tid"]), "inner").groupBy(
            F.col("sub").alias("rsub")).agg(F.sum("n").cast("double").alias("rel_h"))
        m = m.join(rh, m["sub"].eqNullSafe(rh["rsub"]), "left").drop("rsub")
    else:
        m = m.withColumn("rel_h", F.lit(0.0))
    types = checks.filter((F.col("check") == "v_type") & F.col("entity").isin(*subs)).select(
        F.col("entity").alias("tsub"), F.col("hits").alias("type_h"), F.col("total").alias("type_t"))
    m = m.join(types, m["sub"] == types["tsub"], "left").drop("tsub")
    ids = v._id_sets(rows).groupBy(F.col("sub").alias("isub")).agg(*[
        F.sum(F.when(c, 1.0).otherwise(0.0)).alias(k) for k, c in
        (("j_a", F.col("x") & F.col("d")), ("j_b", F.col("x") | F.col("d")), ("j_c", F.col("x")), ("j_d", F.col("d")))])
    m = m.join(ids, m["sub"].eqNullSafe(ids["isub"]), "left").drop("isub")
    n_refs = float(len(refs))
    # a sub with no row in the join (nothing expected, nothing written) has zeros; rows of no sub stay under null
    known = spark.createDataFrame([(s,) for s in subs] + [(None,)], "ksub string")
    m = known.join(m, known["ksub"].eqNullSafe(m["sub"]), "left").drop("sub").withColumnRenamed("ksub", "sub")
    m = m.fillna(0.0, [c for c in m.columns if c != "sub"])
    m = m.select(
        "sub",
        F.coalesce("rec_h", F.lit(0.0)).alias("cov_h_k"), (F.col("n_x") + F.col("fp")).alias("cov_t_k"),
        F.lit(0.0).alias("cov_h_r"), F.col("n_x").alias("cov_t_r"),
        F.col("fid_h").alias("fid_h_k"), F.when(F.col("sub").isNull(), 0.0).otherwise(F.col("fid_t")).alias("fid_t_k"),
        F.lit(0.0).alias("fid_h_r"), F.when(F.col("sub").isNull(), 0.0).otherwise(F.col("n_x")).alias("fid_t_r"),
        F.coalesce("rel_h", F.lit(0.0)).alias("rel_h_k"), (F.col("n_x") * F.lit(n_refs)).alias("rel_t_k"),
        F.lit(0.0).alias("rel_h_r"), (F.col("n_x") * F.lit(n_refs)).alias("rel_t_r"),
        F.coalesce("type_h", F.lit(0.0)).alias("typ_h_k"), F.coalesce("type_t", F.lit(0.0)).alias("typ_t_k"),
        F.lit(0.0).alias("typ_h_r"), F.lit(0.0).alias("typ_t_r"),
        F.when(F.col("sub").isNull(), 0.0).when(F.col("j_c") == 0, F.when(F.col("j_d") == 0, 1.0).otherwise(0.0))
        .otherwise(F.col("j_a") / F.col("j_b")).alias("str_h_k"),
        F.when(F.col("sub").isNull(), 0.0).otherwise(F.lit(1.0)).alias("str_t_k"),
        F.when(F.col("sub").isNull(), 0.0).when(F.col("n_x") == 0, 1.0).otherwise(0.0).alias("str_h_r"),
        F.when(F.col("sub").isNull(), 0.0).otherwise(F.lit(1.0)).alias("str_t_r"),
    )
    # base row (everything that does not depend on the partition) kept in every scenario
    base_row = base.select(F.lit("__base").alias("sub"), *[
        F.col(f"{ax}_{hc}_k").alias(f"{ax}_{hc}_{kr}") for ax in ("cov", "fid", "rel", "typ", "str")
        for kr in ("k", "r") for hc in ("h", "t")])
    # rows of no sub-table count in every scenario, like the base
    m = m.unionByName(base_row).withColumn("sub", F.coalesce("sub", F.lit("__base")))
    scen = [("all", s, True) for s in subs] + [("none", s, False) for s in subs]
    for s0 in subs:
        scen += [(f"without_{s0}", s, s != s0) for s in subs] + [(f"only_{s0}", s, s == s0) for s in subs]
    names = sorted({n for n, _, _ in scen})
    scen += [(n, "__base", True) for n in names]
    sc = spark.createDataFrame(scen, "scenario string, sub string, kept boolean")
    jm = sc.join(m.withColumnRenamed("sub", "msub"), F.col("sub") == F.col("msub"), "inner")
    pick = {f"{ax}_{hc}": F.when(F.col("kept"), F.col(f"{ax}_{hc}_k")).otherwise(F.col(f"{ax}_{hc}_r"))
            for ax in ("cov", "fid", "rel", "typ", "str") for hc in ("h", "t")}
    sums = jm.groupBy("scenario").agg(*[F.sum(c).alias(k) for k, c in pick.items()])
    ratio = {ax: F.when(F.col(f"{ax}_t") == 0, 1.0).otherwise(F.col(f"{ax}_h") / F.col(f"{ax}_t"))
             for ax in ("cov", "fid", "rel", "typ", "str")}
    base_score = (ratio["cov"] * WEIGHTS["coverage"] + ratio["fid"] * WEIGHTS["field_fidelity"]
                  + ratio["rel"] * WEIGHTS["relationship_integrity"] + ratio["typ"] * WEIGHTS["type_correctness"])
    mult = (F.lit(ALPHA) + F.lit(1.0 - ALPHA) * ratio["str"]) if v.ctx.has_structural else F.lit(1.0)
    return sums.select("scenario", ratio["cov"].alias("coverage"), ratio["fid"].alias("field_fidelity"),
                       ratio["rel"].alias("relationship_integrity"), ratio["typ"].alias("type_correctness"),
                       ratio["str"].alias("structural"), (base_score * mult * 100.0).alias("total"))


# ---------------------------------------------------------------------------
# Score tables over runs
# ---------------------------------------------------------------------------
def group_stats(runs: DataFrame, keys: Sequence[str] = ("model", "tier"), score: str = "total") -> DataFrame:
    """A4/A5: mean / min / max / count of scores per group; failed (null) scores are skipped."""
    return runs.groupBy(*keys).agg(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"), F.coalesce(F.min(score), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max"), F.count(score).alias("n"))


def ranking(runs: DataFrame, score: str = "total", group: str = "tier", seq: str = "seq") -> DataFrame:
    """Failed runs removed, rank 1.. by score descending (ties keep input order by ``seq``), plus the gap
    of the first over the second within each group that has two runs or more.

    The ranks are stored once (``rank_within``), so the runner-up is one row per group of a second read."""
    ok = runs.filter(F.col(score).isNotNull()).withColumn("__neg", -F.col(score))
    ranked = rank_within(ok, [group], ["__neg", seq], "rank").drop("__neg")
    second = ranked.where("rank = 2").select(F.col(group).alias("__g"), F.col(score).alias("__second"))
    out = ranked.join(second, ranked[group].eqNullSafe(second["__g"]), "left")
    return out.select(*[ranked[c] for c in ranked.columns],
                      F.when(ranked["rank"] == 1, ranked[score] - F.col("__second")).alias("gap_to_next"))


def score_pivot(runs: DataFrame, tiers: Sequence, score: str = "total", error: str = "error") -> DataFrame:
    """One row per model, mean score per tier (failed runs left out) and error count."""
    ok = runs.withColumn("__s", F.when(~F.col(error), F.col(score)))
    p = ok.groupBy("model").pivot("tier", list(tiers)).agg(F.avg("__s"))
    errs = runs.groupBy(F.col("model").alias("__m")).agg(F.count_if(F.col(error)).alias("errors"),
                                                         F.avg(F.when(~F.col(error), F.col(score))).alias("overall"))
    p = p.select("model", *[F.col(f"`{t}`").alias(f"tier_{t}") for t in tiers])
    return p.join(errs, p["model"] == errs["__m"]).drop("__m")


def metric_pivot(runs: DataFrame, metrics: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Metrics as rows, models as columns (mean per model); a metric that no run has is left out."""
    long = runs.unpivot(["model"], list(metrics), "metric", "value").where("value is not null")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.avg("value"))


def reward_variance(runs: DataFrame, task: str = "task_id", score: str = "total") -> DataFrame:
    """Population variance of rewards per task and whether the task's rewards vary."""
    return runs.groupBy(task).agg(F.var_pop(score).alias("variance"), F.count_distinct(score).alias("n_distinct"),
                                  F.count(score).alias("n")).withColumn("varies", F.col("n_distinct") > 1)


def any_variance(runs: DataFrame, task: str = "task_id", score: str = "total") -> DataFrame:
    """A9 over all tasks: how many tasks vary, and whether any does (one row)."""
    return reward_variance(runs, task, score).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if("varies").alias("n_varying"),
        F.coalesce(F.bool_or("varies"), F.lit(False)).alias("any_varies"))


def canonical_text(columns: Sequence[str]) -> Column:
    """All values of a row as one text, in the order given: ``length:value`` for a value, ``n`` for a null.

    The length ahead of each value makes the text injective: no value can look like the end of another.
    """
    def one(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        return F.when(v.isNull(), F.lit("n")).otherwise(F.concat(F.char_length(v).cast("string"), F.lit(":"), v))
    return F.concat(*[one(c) for c in columns])


def fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A10: per table, row count and an order-insensitive sum of SHA-256 row hashes.

    Columns enter in sorted-name order with marks for nulls; the first 60 bits of each digest are summed as
    DECIMAL(38,0), so duplicate rows add up instead of cancelling.
    """
    parts = []
    for name in sorted(tables):
        df = tables[name]
        digest = F.sha2(canonical_text(sorted(df.columns)), 256)
        h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)")
                            .alias("row_hash_sum")).select(F.lit(name).alias("table_name"), "n_rows", "row_hash_sum"))
    spark = next(iter(tables.values())).sparkSession
    return union_all(spark, parts, "table_name string, n_rows bigint, row_hash_sum decimal(38,0)")
