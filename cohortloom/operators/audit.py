"""Availability, coverage, integrity, provenance, leakage and evidence audits."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.names import set_digest

from . import ordered

# The repeated run schedule of the flight task, (difficulty level, run).
EXPECTED_SCHEDULE = [
    ("01B", "001"), ("01B", "007"), ("01B", "012"), ("02B", "003"), ("02B", "008"), ("02B", "010"),
    ("03B", "002"), ("03B", "005"), ("03B", "011"), ("04B", "004"), ("04B", "006"), ("04B", "009"),
]
# The schedule of each task.
TASK_SCHEDULES = {"rest": [("000", "001"), ("000", "002")], "ils": EXPECTED_SCHEDULE}


def availability(df: DataFrame, keys: Sequence[str], modality: str, modalities: Sequence[str]) -> DataFrame:
    """One row per run: has_<modality> flags, the sorted list and its length."""
    flags = [F.bool_or(F.col(modality) == m).alias(f"has_{m}") for m in modalities]
    g = df.groupBy(*keys).agg(*flags, F.array_sort(F.collect_set(modality)).alias("_m"))
    return g.select(*keys, *[f"has_{m}" for m in modalities], F.array_join("_m", ";").alias("modalities"), F.size("_m").cast("long").alias("n"))


def coverage(avail: DataFrame, modalities: Sequence[str], core: Sequence[str]) -> DataFrame:
    """Per modality: available, missing and percent of runs, beside the complete-run counts."""
    has = {m: F.col(f"has_{m}") for m in modalities}
    strict = reduce(lambda a, b: a & b, has.values())
    core_ok = reduce(lambda a, b: a & b, [has[m] for m in core])
    g = avail.agg(
        F.count(F.lit(1)).alias("runs"), F.count(F.when(strict, 1)).alias("strict_complete"), F.count(F.when(core_ok, 1)).alias("core_complete"),
        *[F.count(F.when(c, 1)).alias(m) for m, c in has.items()],
    )
    long = g.unpivot(["runs", "strict_complete", "core_complete"], list(modalities), "modality", "available")
    return long.select(
        "modality", "runs", "available", (F.col("runs") - F.col("available")).alias("missing"),
        (F.col("available") * 100.0 / F.col("runs")).alias("percent"), "strict_complete", "core_complete",
    )


def distribution(df: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    g = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def missingness(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(value).isNull(), 1)).alias("missing_count"))
    return g.select(*keys, "rows", "missing_count", (F.col("missing_count") / F.col("rows")).alias("missing_ratio"), (F.col("rows") == F.col("missing_count")).alias("fully_missing"))


def constant_features(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All-missing, single-valued or varied; lowest = highest replaces a distinct count."""
    g = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    status = F.when(F.col("_lo").isNull(), "all_missing").when(one, "single_value").otherwise("varied")
    return g.select(*keys, status.alias("status"), F.when(one, F.col("_lo")).alias("constant_value"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def integrity(df: DataFrame, keys: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row of counts: keys, repeated keys, NULL or blank keys, rows with an infinite number."""
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    infinite = reduce(lambda a, b: a | b, [F.coalesce(F.abs(c) == float("inf"), F.lit(False)) for c in numeric])
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(blank, 1)).alias("_blank"), F.count(F.when(infinite, 1)).alias("_inf")
    )
    twice = F.col("_n") > 1
    return per.agg(
        F.count(F.lit(1)).alias("keys"), F.count(F.when(twice, 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(twice, F.col("_n"))), F.lit(0)).alias("rows_in_duplicates"),
        F.sum("_blank").alias("null_keys"), F.sum("_inf").alias("infinite_rows"),
    )


def efficiency(df: DataFrame, keys: Sequence[str], cost: str, work: str) -> DataFrame:
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.sum(cost).alias("total"), F.avg(cost).alias("mean"), F.max(cost).alias("max"),
        F.try_divide(F.sum(work), F.sum(cost)).alias("throughput"),
    )
    q = ordered.exact_quantiles(df, keys, cost, [0.5], "_q")
    return ordered.key_join(g, q, keys).withColumn("median", F.get("_q", F.lit(0))).drop("_q")


def audit_files(files: DataFrame, keys: Sequence[str], stem: str) -> DataFrame:
    """Per (run, stem): data/header pairing with abnormality codes.

    ``files`` columns: kind ('dat'/'hea'), id_ok, data_rows, sample_count, effective_rate.  Pairing
    is a grouping on the stem, so each file is shuffled once and never joined to its siblings.
    """
    is_dat, is_hea = F.col("kind") == "dat", F.col("kind") == "hea"
    g = files.groupBy(*keys, stem).agg(
        F.max(F.when(is_dat, 1)).alias("_dat"), F.max(F.when(is_hea, 1)).alias("_hea"), F.bool_and("id_ok").alias("_ok"),
        F.max(F.when(is_dat, F.col("data_rows"))).alias("_rows"), F.max(F.when(is_hea, F.col("sample_count"))).alias("_count"),
        F.max(F.when(is_hea, F.col("effective_rate"))).alias("_rate"),
    )
    dat, hea = F.col("_dat").isNotNull(), F.col("_hea").isNotNull()
    count, rate = F.col("_count"), F.col("_rate")
    rules: Mapping[str, Column] = {
        "identifier_mismatch": ~F.col("_ok"),
        "no_data_rows": dat & (F.col("_rows") == 0),
        "invalid_sample_count": hea & (count.isNull() | (count <= 0)),
        "invalid_effective_rate": hea & (rate.isNull() | (rate <= 0)),
        "short_stream_metadata": hea & (count > 0) & (rate > 0) & (count / rate < 30),
        "placeholder_data_with_zero_samples": dat & hea & (count == 0) & (F.col("_rows") > 0),
        "missing_paired_header": dat & ~hea,
        "missing_paired_data": hea & ~dat,
    }
    codes = F.array_sort(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))
    verified = dat & (F.col("_rows") > 0) & ~F.coalesce(hea & (count == 0), F.lit(False))
    return g.select(*keys, stem, F.array_join(codes, ";").alias("codes"), F.size(codes).cast("long").alias("code_count"), verified.alias("verified"))


def audit_runs(file_audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    return file_audit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("streams"), F.count(F.when(F.col("verified"), 1)).alias("verified_streams"),
        F.sum("code_count").alias("abnormal_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("codes", ";"))))), ";").alias("codes"),
    )


def discrepancies(prior: DataFrame, verified: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Flags that changed between two availability tables, as one row per change with a severity."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *flags).unpivot(list(keys), list(flags), "flag", name)

    j = long(prior, "prior").join(long(verified, "verified"), [*keys, "flag"], "full_outer")
    a, b = F.col("prior"), F.col("verified")
    change = (
        F.when(a.isNull(), "run_added").when(b.isNull(), "run_removed").when(~a & b, "added").when(a & ~b, "removed")
    )
    out = j.select(*keys, "flag", change.alias("change")).where(F.col("change").isNotNull())
    return out.withColumn("severity", F.when(F.col("change").isin("removed", "run_removed"), "high").otherwise("medium"))


def schedule_variance(runs: DataFrame, subject: str, level: str, run: str, schedule: Sequence[tuple[str, str]] = EXPECTED_SCHEDULE) -> DataFrame:
    """Scheduled (level, run) pairs a subject lacks and pairs outside the schedule.

    A lacking pair whose run number exists under another level is a mapping hole, otherwise the run
    is physically absent. Each subject carries its own small set; no subject x schedule grid is built.
    """
    return _variance(runs, [subject], level, run, _pairs(schedule))


def task_schedule_variance(
    runs: DataFrame, subject: str, task: str, level: str, run: str, schedules: Mapping[str, Sequence[tuple[str, str]]] = TASK_SCHEDULES
) -> DataFrame:
    """``schedule_variance`` of every subject and task by that task's schedule; all runs of a task without one are unexpected."""
    every = _pairs([pair for schedule in schedules.values() for pair in schedule])
    own = F.lit(None)
    for name, schedule in schedules.items():
        own = F.when(F.col(task) == name, _pairs(schedule)).otherwise(own)
    return _variance(runs, [subject, task], level, run, F.coalesce(own, F.filter(every, lambda _: F.lit(False))))


def _pairs(schedule: Sequence[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(l).alias("level"), F.lit(r).alias("run")) for l, r in schedule])


def _variance(runs: DataFrame, keys: Sequence[str], level: str, run: str, wanted: Column) -> DataFrame:
    pair = F.struct(F.col(level).alias("level"), F.col(run).alias("run"))
    s = runs.select(*keys, level, run).distinct().groupBy(*keys).agg(F.collect_set(pair).alias("_seen"))
    seen = F.col("_seen")

    def lacking(p: Column) -> Column:
        hole = F.exists(seen, lambda q: q["run"] == p["run"])
        return F.struct(p["level"].alias("level"), p["run"].alias("run"), F.when(hole, "schedule_mapping_hole").otherwise("physically_absent_run").alias("status"))

    extra = F.transform(F.array_except(seen, wanted), lambda p: F.struct(p["level"].alias("level"), p["run"].alias("run"), F.lit("unexpected").alias("status")))
    found = F.concat(F.transform(F.array_except(wanted, seen), lacking), extra)
    return s.select(*keys, F.explode(found).alias("_g")).select(*keys, "_g.*")


def reconcile_summary(summary: DataFrame, detail: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary keys against per-run keys: matched, only on one side, or repeated in the summary."""
    a = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    b = detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    j = a.join(b, list(keys), "full_outer")
    status = (
        F.when(F.col("_d").isNull(), "only_summary").when(F.col("_s").isNull(), "only_detail").when(F.col("_s") > 1, "duplicate_in_summary").otherwise("matched")
    )
    return j.select(*keys, status.alias("status"), F.coalesce("_d", F.lit(0)).alias("detail_rows"))


def mask_unavailable(long: DataFrame, available: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Blank every feature of a (run, modality) not listed as available; ``repaired`` marks the change."""
    flags = available.select(*keys).distinct().withColumn("_ok", F.lit(True))
    j = long.join(flags, list(keys), "left")
    changed = F.col("_ok").isNull() & F.col(value).isNotNull()
    return j.withColumn("repaired", changed).withColumn(value, F.when(F.col("_ok"), F.col(value))).drop("_ok")


def assert_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, allowed: DataFrame, allowed_keys: Sequence[str]) -> DataFrame:
    """Every cell's fate: unchanged, allowed (blanked where permitted) or a violation."""
    a = before.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ia"))
    b = after.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_ib"))
    j = a.join(b, list(keys), "full_outer").join(allowed.select(*allowed_keys).distinct().withColumn("_may", F.lit(True)), list(allowed_keys), "left")
    same = F.col("_a").eqNullSafe(F.col("_b"))
    fate = (
        F.when(F.col("_ia").isNull(), "violation_row_added").when(F.col("_ib").isNull(), "violation_row_removed").when(same, "unchanged")
        .when(F.col("_may") & F.col("_b").isNull(), "allowed_blanked").otherwise("violation_changed")
    )
    return j.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("cells"))


def provenance(long: DataFrame, feature: str, modality: str, source_column: str, statistic: str, groups: Mapping[str, str]) -> DataFrame:
    """Per feature: the modalities, source columns and statistics behind it and its rule-based group."""
    g = long.groupBy(feature).agg(*[
        F.array_join(F.array_sort(F.collect_set(c)), ";").alias(n)
        for c, n in ((modality, "modalities"), (source_column, "source_columns"), (statistic, "statistics"))
    ])
    rule = F.lit(None).cast("string")
    for prefix, group in reversed(list(groups.items())):
        rule = F.when(F.col(feature).startswith(prefix), group).otherwise(rule)
    return g.withColumn("feature_group", F.coalesce(rule, F.lit("unknown_features"))).withColumn(
        "provenance_status", F.when(F.instr("modalities", ";") > 0, "UNVERIFIED").otherwise("VERIFIED")
    )


def semantic_category(features: DataFrame, base: str, behavioural: Sequence[str], settings: Sequence[str]) -> DataFrame:
    """Behavioural response, task setting or ambiguous, from the base variable's terms alone."""
    def any_term(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(F.col(base)).contains(w) for w in words])

    b, s = any_term(behavioural), any_term(settings)
    return features.withColumn("category", F.when(b & ~s, "BEHAVIORAL_RESPONSE").when(s & ~b, "TASK_SETTING").otherwise("AMBIGUOUS"))


def leakage_decision(column_kind: Column, structurally_empty: Column, verified: Column, group: Column, outcome_group: str) -> Column:
    return (
        F.when(column_kind == "identifier_or_target", "EXCLUDE_ALL_MODEL_INPUTS")
        .when(structurally_empty, "EXCLUDE_ALL_DATASETS_STRUCTURALLY_UNUSABLE_ALL_NAN")
        .when(~verified, "EXCLUDE_PRIMARY_UNVERIFIED")
        .when(group == outcome_group, "EXCLUDE_PRIMARY_INCLUDE_AUXILIARY_AND_PERFORMANCE_ONLY")
        .otherwise("INCLUDE_PRIMARY")
    )


def target_functional(long: DataFrame, feature: str, value: str, target: str) -> DataFrame:
    """Is a feature a copy of the target, or fixed by it (one value per target, more than one overall)?"""
    per = long.groupBy(feature, target).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.when(F.col(value).isNull() | F.col(target).isNull(), 1)).alias("_gaps"),
        F.bool_and(F.col(value) == F.col(target)).alias("_copy"),
    )
    complete = F.sum("_gaps") == 0
    fixed = F.bool_and(F.col("_lo") == F.col("_hi")) & (F.min("_lo") < F.max("_lo"))
    return per.groupBy(feature).agg(
        F.coalesce(complete & F.bool_and("_copy"), F.lit(False)).alias("direct_copy"),
        F.coalesce(complete & fixed, F.lit(False)).alias("determined_by_target"),
    )


def cohort(df: DataFrame, level: str, included: Sequence[int], rest: int = 0) -> DataFrame:
    decision = F.when(F.col(level).isin(*included), "INCLUDE_TASK_COHORT").when(F.col(level) == rest, "EXCLUDE_REST_LEVEL").otherwise("EXCLUDE_UNPARSED_LEVEL")
    reason = F.when(F.col(level).isin(*included), "").when(F.col(level) == rest, "verified_rest_level").otherwise("no_valid_level")
    return df.withColumn("decision", decision).withColumn("reason", reason)


def select_features(long: DataFrame, feature_dim: DataFrame, feature: str, include: Sequence[str], group: str = "feature_group") -> DataFrame:
    """Rows of the features whose group is included."""
    return long.join(feature_dim.where(F.col(group).isin(*include)).select(feature), feature, "left_semi")


def row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def table_hash(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content hash: row count with the xor and the modular sum of 60-bit row digests."""
    cols = [c for c in (columns or df.columns) if c not in keys]
    h = F.conv(F.substring(row_digest([*keys, *cols]), 1, 15), 16, 10).cast("long")
    g = df.select(*keys, h.alias("_h")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_h").alias("xor_hash"), (F.sum(F.pmod("_h", F.lit(1000000007)).cast("decimal(20,0)")) % 1000000007).cast("long").alias("sum_hash")
    )
    return g


def evidence_row(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """One index row for a table: rows, distinct keys, content hash and status."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))
    status = F.when(F.col("rows") == 0, "EMPTY").when(F.col("rows") > F.col("distinct_keys"), "DUPLICATE_KEYS").otherwise("PASS")
    return counts.select(F.lit(name).alias("artifact"), "rows", "distinct_keys", status.alias("status"))


def evidence_index(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def coverage_rollup(index: DataFrame, phase: str) -> DataFrame:
    return index.groupBy(phase).agg(
        F.count(F.lit(1)).alias("artifacts"), F.sum("rows").alias("rows"), F.sum("distinct_keys").alias("distinct_keys"),
        F.array_join(F.array_sort(F.collect_set("status")), ";").alias("statuses"),
    )


def gate_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One pass over the table; one row per named rule with its verdict. Rules are aggregate booleans."""
    wide = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    return wide.unpivot([], list(rules), "gate", "passed")


def assert_gates(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The same report, but the plan fails when any rule does."""
    report = gate_report(df, rules)
    fail = F.raise_error(F.concat(F.lit("gate failed: "), F.col("gate"))).cast("boolean")
    return report.where(F.when(F.col("passed"), F.lit(True)).otherwise(fail))


def metric_recheck(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float) -> DataFrame:
    """Largest absolute difference per metric between stored and recomputed tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", name)

    j = long(stored, "_a").join(long(recomputed, "_b"), [*keys, "metric"], "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    g = j.groupBy("metric").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("_a").isNull() != F.col("_b").isNull(), 1)).alias("unmatched"), F.max(gap).alias("max_abs_diff")
    )
    return g.withColumn("passed", (F.col("unmatched") == 0) & (F.col("max_abs_diff") <= tolerance))


def holdout_feasibility(df: DataFrame, group: str, unit: str, label: str, labels: int) -> DataFrame:
    """Can a grouping column be held out? Group count, units per group, label cover, nesting."""
    units = df.select(group, unit).distinct()
    per_group = units.groupBy(group).agg(F.count(F.lit(1)).alias("units"))
    lab = df.select(group, label).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("labels"))
    per_unit = units.groupBy(unit).agg(F.count(F.lit(1)).alias("groups"))
    g = per_group.join(lab, group).agg(
        F.count(F.lit(1)).alias("groups"), F.min("units").alias("min_units"), F.max("units").alias("max_units"),
        F.count(F.when(F.col("labels") == labels, 1)).alias("groups_with_every_label"), (F.max("labels") == 1).alias("determines_label"),
    )
    return g.withColumn("nested_in_unit", F.col("max_units") == 1).withColumn(
        "one_group_per_unit", per_unit.agg(F.max("groups") == 1).scalar()
    )


def condition_status(members: DataFrame, position: str, condition: str, feature: str, full: str) -> DataFrame:
    """Mark conditions that are empty, equal to the full set, or equal to an earlier condition.

    ``members`` has one row per (condition, feature); an empty condition has a NULL feature.
    """
    s = members.groupBy(position, condition).agg(F.collect_set(feature).alias("_s"))
    d = s.select(position, condition, F.size("_s").cast("long").alias("feature_count"), set_digest(F.col("_s")).alias("digest"))
    first = d.where("feature_count > 0").groupBy("digest").agg(F.min_by(condition, position).alias("_first"), F.max(F.when(F.col(condition) == full, 1)).alias("_is_full"))
    j = d.join(first, "digest", "left")
    other = F.when(F.col("_is_full") == 1, F.lit(full)).otherwise(F.col("_first"))
    alias = F.when(other != F.col(condition), other)
    status = F.when(F.col("feature_count") == 0, "EMPTY").when(F.col(condition) == full, "REFERENCE").when(alias.isNotNull(), "ALIAS").otherwise("UNIQUE")
    return j.select(condition, "feature_count", "digest", status.alias("status"), alias.alias("alias_of"))
