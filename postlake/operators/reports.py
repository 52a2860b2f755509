"""Reports: issue reports on postings, counters of matching and dedup stages, and the aggregate of a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import ordered

#: Types of issue reports, and the fields that each may have beside a note.
REPORT_FIELDS = {
    "missing_skills": ("skills",), "false_skills": ("skills",), "match_level": ("suggested_level",), "yoe": ("actual_yoe",), "wrong_gate": ("gate_name",), "salary": (), "other": (),
}
LEVELS = ("strong_match", "possible_match", "stretch_match", "weak_match")
GATES = ("yoe_gate", "salary_gate", "education_gate", "visa_gate", "language")


def report_error(kind: Column, detail: Column, gated: Column) -> Column:
    """Why a report is refused, or null. detail: JSON; gated: its posting failed a gate."""
    v = F.try_parse_json(detail)
    shape = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    there = lambda k: F.coalesce(shape(k) != "VOID", F.lit(False))
    allowed = F.coalesce(*[F.when(kind == k, F.array(*[F.lit(f) for f in (*own, "note")])) for k, own in REPORT_FIELDS.items()])
    skills = F.try_variant_get(v, "$.skills", "array<string>")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return ordered(
        [
            ("bad_type", ~kind.isin(*REPORT_FIELDS)), ("not_gated", (kind == "wrong_gate") & ~gated),
            ("unknown_key", F.size(F.array_except(F.map_keys(v.try_cast("map<string,variant>")), allowed)) > 0), ("note_too_long", F.length(text("note")) > 200),
            ("bad_skills", there("skills") & (skills.isNull() | (F.size(skills) > 10) | F.exists(skills, lambda s: F.length(s) > 50))),
            ("bad_level", there("suggested_level") & ~F.coalesce(text("suggested_level").isin(*LEVELS), F.lit(False))),
            ("bad_yoe", there("actual_yoe") & ~F.coalesce(shape("actual_yoe").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False))),
            ("bad_gate", there("gate_name") & ~F.coalesce(text("gate_name").isin(*GATES), F.lit(False))),
        ]
    )


def upsert_reports(stored: DataFrame, new: DataFrame) -> DataFrame:
    """At most one pending report of a posting and type: a new one's detail replaces that of the pending one, which keeps its id; others are added.

    Both: report_id, job_id, report_type, status, detail, created_at. Of several new ones of a key the last counts.
    """
    key = ["job_id", "report_type"]
    last = new.groupBy(*key).agg(F.max_by(F.struct("report_id", "status", "detail", "created_at"), F.struct("created_at", "report_id")).alias("new"))
    pending = stored.where("status = 'pending'").join(last, key, "full")
    own = lambda c: F.coalesce(c, f"new.{c}").alias(c)
    merged = pending.select(own("report_id"), *key, own("status"), F.coalesce("new.detail", "detail").alias("detail"), own("created_at"))
    return stored.where("status <> 'pending'").unionByName(merged)


def report_listing(reports: DataFrame, jobs: DataFrame, status: str = "pending", kind: str | None = None) -> DataFrame:
    """Reports with what is shown of their postings, newest first."""
    rows = reports if status == "all" else reports.where(F.col("status") == status)
    rows = rows if kind is None else rows.where(F.col("report_type") == kind)
    return rows.join(jobs, "job_id").orderBy(F.desc("created_at"), "report_id")


def report_stats(reports: DataFrame) -> DataFrame:
    """Pending reports by type, 0 for types without any."""
    kinds = reports.sparkSession.createDataFrame([(k,) for k in REPORT_FIELDS], "report_type string")
    counts = reports.where("status = 'pending'").groupBy("report_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "report_type", "left").select("report_type", F.coalesce("n", F.lit(0)).alias("pending"))


def with_report_flag(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Adds has_report: a pending report exists; one that was acted on or dismissed does not count."""
    pending = reports.where("status = 'pending'").select("job_id").distinct().withColumn("has_report", F.lit(True))
    return jobs.join(pending, "job_id", "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def dedup_status(df: DataFrame, status: str | None) -> DataFrame:
    """passed, removed or all; by default rows that dedup left in."""
    left_in, gate_ok = F.col("skip_reason").isNull(), F.col("match_skip_reason").isNull()
    return {"passed": df.where(left_in & gate_ok & ~F.col("dismissed")), "removed": df.where(~left_in | ~gate_ok | F.col("dismissed")), "all": df}.get(status, df.where(left_in))


def skipped_of_run(df: DataFrame, scan_run_id: str, limit: int = 25) -> DataFrame:
    """A run's rows that were skipped, newest first."""
    return df.where((F.col("scan_run_id") == scan_run_id) & F.col("skip_reason").isNotNull()).orderBy(F.desc("created_at"), "id").limit(limit)


def named_counts(df: DataFrame, *by: str) -> DataFrame:
    """One row: a map of counts by the first column, or a map of maps by two."""
    counts = df.where(" AND ".join(f"{c} IS NOT NULL" for c in by)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if len(by) == 1:
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by[0], "n")))).alias("counts"))
    inner = counts.groupBy(by[0]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by[1], "n")))).alias("own"))
    return inner.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by[0]), F.map_entries("own").alias("e"))))).alias("listed")).select(F.transform_values("listed", lambda _, e: F.map_from_entries(e)).alias("counts"))


def match_report(rows: DataFrame) -> DataFrame:
    """rows: gate, level, mode (cpu or llm), failed, fallback. The six totals and two maps of a matching stage, one row."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count("gate").alias("total_gate_skipped"), F.count_if(F.col("gate").isNull() & (F.col("mode") == "cpu") & ~F.col("failed")).alias("total_cpu_decided"),
        F.count_if(F.col("gate").isNull() & (F.col("mode") == "llm") & ~F.col("failed")).alias("total_llm_scored"), F.count_if("failed").alias("total_failed"), F.count_if("fallback").alias("total_cpu_fallback"),
    )
    levels, gates = named_counts(rows.where("gate IS NULL"), "level").withColumnRenamed("counts", "match_level_counts"), named_counts(rows, "gate").withColumnRenamed("counts", "gate_skip_counts")
    return totals.crossJoin(F.broadcast(levels)).crossJoin(F.broadcast(gates))  # one row each


def gate_metrics(rows: DataFrame, text_gates: tuple[str, ...], enabled: tuple[str, ...]) -> DataFrame:
    """rows: pass0, pass1 (the gate failed, or null), blank (no text), same, similar (copies). Of each gate, in order: rows checked, rows flagged. One pass.

    A gate checks the rows that no gate before has flagged. One that is off checks none, nor do gates of texts and the
    comparison of texts check a row without text.
    """
    place = F.array_position(F.array(*map(F.lit, text_gates)), F.col("pass1"))
    left = F.col("pass0").isNull()
    counts = {"pass_0": (F.lit(True), ~left)}
    for k, g in enumerate(text_gates):
        on = left & ~F.col("blank") if g in enabled else F.lit(False)
        counts[g] = (on & F.coalesce(place >= k + 1, F.lit(True)), on & F.coalesce(place == k + 1, F.lit(False)))
    left &= F.col("pass1").isNull()
    counts["hash_exact"] = (left, left & F.col("same"))
    left &= ~F.col("same")
    counts["cosine"] = (left & ~F.col("blank"), left & ~F.col("blank") & F.col("similar"))
    each = rows.agg(*[F.struct(F.count_if(c).alias("checked"), F.count_if(f).alias("flagged")).alias(g) for g, (c, f) in counts.items()])
    return each.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"{g}.checked").alias("checked"), F.col(f"{g}.flagged").alias("flagged")) for g in counts])).alias("g")).select("g.*")
