"""Matching of postings against a profile: extraction, hard gates, coverage, bands, routing and reconciliation.

Patterns are our own configuration; skills come from a table (``skills``). A model that extracts or re-scores can take the
place of ``extract`` by giving the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import quoted
from ..functions.tokens import lookup
from .corpus import DEDUP_REASONS
from .dedup import mentions
from .ingest import ordered

PER_YEAR = {"HOURLY": 2080, "DAILY": 260, "WEEKLY": 52, "MONTHLY": 12, "ANNUAL": 1}
DEGREES = ("none", "bachelor", "master", "phd")
#: Our own patterns of what a posting says; a text is lower-cased before.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
YEARS = rf"\b([0-9]{{1,2}}|{'|'.join(NUMBERS)})\s*(?:\+|(?:-|to)\s*[0-9]{{1,2}})?\s*(?:years|yrs)\b"
PAY = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)(k?)\s*(?:-|to)\s*\$?\s?([0-9][0-9,]*(?:\.[0-9]+)?)(k?)"
PAID = (("HOURLY", r"(per|an|/) ?(hour|hr)\b|hourly"), ("DAILY", r"(per|a|/) ?day\b"), ("WEEKLY", r"(per|a|/) ?week\b"), ("MONTHLY", r"(per|a|/) ?month\b"))
TITLES = (("phd", r"\b(phd|ph\.d|doctorate|doctoral)\b"), ("master", r"\b(masters?|master's|m\.?sc|mba)\b"), ("bachelor", r"\b(bachelors?|bachelor's|b\.?sc|b\.?eng|undergraduate degree)\b"))
FIELD = r"\b(?:degree|bachelor's|master's|phd|doctorate) in ([a-z]+(?: [a-z]+)?)"
NO_VISA = r"no (visa )?sponsorship|(unable|not able) to sponsor|without sponsorship|must be (a )?citizen|sponsorship is not"
VISA = r"sponsorship|will sponsor|visa support"


def extract(text: Column) -> dict[str, Column]:
    """yoe, salary_min, salary_max, salary_period, degree, field, visa, incomplete; null, none or unknown where the text does not say. Skills: ``skills.asked``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    years = F.regexp_extract(low, YEARS, 1)
    amount = lambda k: F.regexp_replace(F.regexp_extract(low, PAY, k), ",", "").try_cast("double") * F.when(F.regexp_extract(low, PAY, k + 1) == "k", 1000).otherwise(1)
    paid = F.regexp_extract(low, PAY + "([^\n]{0,20})", 5)
    return {
        "yoe": F.coalesce(years.try_cast("double"), *[F.when(years == w, float(k)) for k, w in enumerate(NUMBERS, 1)]), "salary_min": amount(1), "salary_max": amount(3),
        "salary_period": F.when(F.regexp_extract(low, PAY, 1) != "", ordered([(k, paid.rlike(p)) for k, p in PAID], "ANNUAL")),
        "degree": ordered([(d, low.rlike(p)) for d, p in TITLES], "none"), "field": F.nullif(F.regexp_extract(low, FIELD, 1), F.lit("")),
        "visa": ordered([("false", low.rlike(NO_VISA)), ("true", low.rlike(VISA))], "unknown"), "incomplete": F.length(F.trim(low)) < 20,
    }


def annual(amount: Column, period: Column) -> Column:
    """For comparing only; nothing stored is converted."""
    return amount * lookup({k: str(v) for k, v in PER_YEAR.items()}, period).cast("double")


def hard_gates(x: dict[str, Column], profile: dict) -> Column:
    """The first gate that fails, or null; what a posting does not say fails none."""
    rank = lambda d: F.array_position(F.expr(f"array({', '.join(map(quoted, DEGREES))})"), d)
    return ordered(
        [
            ("yoe_gate", x["yoe"] > profile["yoe"] + 1.0), ("salary_gate", annual(F.coalesce(x["salary_max"], x["salary_min"]), x["salary_period"]) < profile["salary_min"]),
            ("education_gate", (rank(x["degree"]) > DEGREES.index(profile["degree"]) + 1) | ~x["field"].isin(*profile["fields"])), ("visa_gate", (x["visa"] == "false") & F.lit(profile["needs_sponsorship"])),
        ]
    )


def coverage(wanted: Column, have: tuple[str, ...]) -> Column:
    own = F.expr(f"array({', '.join(map(quoted, have))})")
    return F.size(F.array_intersect(wanted, own)) / F.nullif(F.size(wanted), F.lit(0))


def prescore(required: Column, preferred: Column, have: tuple[str, ...], bonus: float = 0.1, strong: float = 0.85, middle: float = 0.5) -> dict[str, Column]:
    req, nice = coverage(required, have), F.coalesce(coverage(preferred, have), F.lit(0.0))
    fit = F.round(req + nice * bonus, 6)
    level = F.when(req.isNull(), "stretch_match").when(req == 0, "weak_match").when(fit >= strong, "strong_match").when(fit >= middle, "stretch_match").otherwise("weak_match")
    return {"req_coverage": F.round(req, 6), "fit_score": fit, "level": level}


def band(req: Column, strong: float = 0.85) -> Column:
    """matched, or why not."""
    return F.when(req.isNull(), "no_required_skills").when(req >= strong, "matched").when(req < 0.5, "low_coverage").otherwise("cpu_only_unresolved")


def blacklist(df: DataFrame, companies: tuple[str, ...], locations: tuple[str, ...], remote_only: bool, no_contract: bool, least_salary: float | None) -> Column:
    """The first rule that excludes a canonical row, or null. Null is never no: an unsaid remote, type or salary excludes nothing."""
    c = F.col
    rules = [("company", c("company").isin(*companies)), ("location", mentions(c("location_text"), locations))]
    if remote_only:
        rules.append(("remote_only", ~c("remote")))
    if no_contract:
        rules.append(("no_contract", c("employment_type").isin("CONTRACT", "TEMPORARY")))
    if least_salary is not None:
        rules.append(("salary_floor", c("salary_disclosed") & (annual(c("salary_max"), c("salary_period")) < least_salary)))
    return ordered(rules)


def gap(wanted: Column, have: tuple[str, ...]) -> Column:
    """What is required and not there."""
    return F.array_except(wanted, F.expr(f"array({', '.join(map(quoted, have))})"))


def stage_of(c: dict[str, Column]) -> dict[str, Column]:
    """Which stages a posting may enter, from the columns that earlier ones fill; all five conditions are of nulls and flags."""
    base, ok = c["skip_reason"].isNull() & ~c["dismissed"], c["match_skip_reason"].isNull()
    done = base & c["matched_at"].isNotNull()
    unsure = (c["match_level"].isin("stretch_match", "weak_match") & (c["fit_score"] > 0) & (c["fit_score"] < 0.85)) | c["jd_incomplete"]
    stages = {
        "cpu_work": base & c["matched_at"].isNull(), "llm_extraction": done & ok & c["match_level"].isNull(), "cpu_score": done & ok,
        "llm_score": done & ok & c["match_level"].isNotNull() & c["confidence"].isNull() & unsure, "extraction_only": c["skip_reason"].isNull(),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in stages.items()}


# Which columns each reset clears, and the gates that only a model's extraction decides.
_SCORES, _LLM = ("fit_score", "req_coverage", "match_level", "match_reason"), ("confidence", "blocking_gap", "gap_adjacency")
_EXTRACTED = ("extracted_yoe", "salary_min_extracted", "salary_max_extracted", "education_degree", "education_field", "visa_req", "required_skills", "nice_to_have_skills")
_ALL = ("match_skip_reason", "removal_stage", "matched_at", "matching_mode", "jd_incomplete", *_EXTRACTED, *_SCORES, *_LLM)
RESETS = {"gates": ("match_skip_reason",), "score": (*_SCORES, *_LLM), "undo_button1": _ALL, "undo_button2": (*_SCORES, *_LLM), "undo_button3": _SCORES, "undo_button4": _LLM, "all": _ALL}
MODEL_GATES = ("education_gate", "visa_gate")


def reset(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns of that reset cleared, so far as df has them, and reset: whether a row had anything to clear.

    Undoing the first button takes back what dedup decided as well; undoing the second takes back the gates that a
    model's extraction decided, and the mode becomes cpu again.
    """
    kinds, c = dict(df.dtypes), F.col
    change = {k: F.lit(None).cast(kinds[k]) for k in RESETS[kind] if k in kinds}
    had = [c(k).isNotNull() for k in change]
    if kind == "undo_button1" and "skip_reason" in kinds:
        own = c("skip_reason").isin(*DEDUP_REASONS)
        had.append(own)
        change |= {k: F.when(~F.coalesce(own, F.lit(False)), c(k)) for k in ("skip_reason", "original", "score") if k in kinds}
    if kind == "undo_button2":
        gate, mode = c("match_skip_reason").isin(*MODEL_GATES), c("matching_mode") == "llm"
        change |= {k: F.when(~F.coalesce(gate, F.lit(False)), c(k)) for k in ("match_skip_reason", "removal_stage") if k in kinds}
        had.append(gate)
        if "matching_mode" in kinds:
            change["matching_mode"] = F.when(mode, "cpu").otherwise(c("matching_mode"))
            had.append(mode)
    return df.withColumns(change | {"reset": F.coalesce(F.greatest(*had, F.lit(False)), F.lit(False))})


def may_dismiss(c: dict[str, Column]) -> Column:
    """dismissed, or why not: a posting that is neither scored nor gated cannot be dismissed; a null id is none."""
    return ordered([("not_found", c["id"].isNull()), ("not_decided", c["match_level"].isNull() & c["match_skip_reason"].isNull())], "dismissed")


def undismiss(df: DataFrame) -> DataFrame:
    """Takes a dismissal back; unless a gate had failed, extraction and scores go as well."""
    kinds = dict(df.dtypes)
    clear = F.col("dismissed") & F.col("match_skip_reason").isNull()
    return df.withColumns({k: F.when(~clear, F.col(k)) for k in (*_EXTRACTED, *_SCORES, *_LLM, "matched_at") if k in kinds} | {"dismissed": F.lit(False)})


def field_gates(c: dict[str, Column], titles: tuple[str, ...], industries: tuple[str, ...], languages: tuple[str, ...], degrees: tuple[str, ...]) -> Column:
    """The first field that rules a posting out, or null; what is not said rules nothing out. Rules on industry and degree are our own."""
    has = lambda col, words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower(col).contains(w))
    return ordered(
        [
            ("title", ~has(c["title"], titles)), ("industry", has(c["industry"], industries)), ("experience", has(c["experience_level"], ("5+ years",))),
            ("language", ~c["language"].isin(*languages)), ("education", has(c["education_requirements"], degrees)),
        ]
    )


# Why a posting is filtered, and which verdicts each type takes.
FILTER_TYPES = {
    "field_gate": ("title", "industry", "experience", "language", "education"), "cpu_gate": ("jd_incomplete", "extraction_failed", "yoe_gate", "salary_gate", "visa_gate"),
    "llm_gate": ("llm_yoe_gate", "llm_salary_gate", "llm_visa_gate", "llm_education_gate"), "coverage": ("low_coverage", "no_required_skills", "cpu_only_unresolved"), "llm_reject": ("llm_no",),
    "dedup": ("cross_post", "repost"),
}


def routed_tables(df: DataFrame, keys: list[str], now: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(matched_jobs with their expiry, filtered_jobs with type, reason and detail); every row with a verdict is in one of them.

    detail, JSON: of coverage the coverage and what is missing, of dedup the row kept, the similarity and the kind; df has
    required_coverage, missing_required, original and score, null where they do not apply.
    """
    kind = ordered([(k, F.col("verdict").isin(*own)) for k, own in FILTER_TYPES.items()], "cpu_gate")
    detail = F.when(kind == "coverage", F.to_json(F.struct("required_coverage", "missing_required"))).when(
        kind == "dedup", F.to_json(F.struct(F.col("original").alias("kept_scraped_job_id"), F.col("score").alias("similarity"), F.col("verdict").alias("match_kind")))
    )
    matched = df.where("verdict = 'matched'").select(*keys, (F.to_timestamp(F.lit(now)) + F.make_dt_interval(F.lit(days))).alias("expires_at"))
    return matched, df.where("verdict <> 'matched'").select(*keys, kind.alias("filter_type"), F.col("verdict").alias("reason"), detail.alias("detail"))


def skill_counts(df: DataFrame, required: str = "required", preferred: str = "preferred") -> DataFrame:
    """skill, n, n_required, n_preferred over all extracted rows, filtered later or not."""
    each = df.select(F.explode(F.concat(F.transform(required, lambda s: F.struct(s.alias("skill"), F.lit(1).alias("r"))), F.transform(preferred, lambda s: F.struct(s.alias("skill"), F.lit(0).alias("r"))))).alias("e"))
    return each.groupBy("e.skill").agg(F.count(F.lit(1)).alias("n"), F.sum("e.r").alias("n_required"), F.sum(1 - F.col("e.r")).alias("n_preferred"))


def upsert_expiring(old: DataFrame, new: DataFrame, keys: list[str], now: str, days: int, drop: Column) -> DataFrame:
    """old with new over it: new rows replace theirs and expire ``days`` later; a new row for which drop holds removes its old one."""
    fresh = new.withColumn("expires_at", F.to_timestamp(F.lit(now)) + F.make_dt_interval(F.lit(days)))
    stay = old.where(F.col("expires_at") > F.to_timestamp(F.lit(now))).join(new.select(*keys), keys, "left_anti")
    return stay.unionByName(fresh.where(~F.coalesce(drop, F.lit(False))).select(*old.columns))
