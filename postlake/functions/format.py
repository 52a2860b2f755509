"""Display strings and classifiers, each an ordered case over its inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ingest import ordered
from .tokens import lookup, present, stripped

ABSENT = "—"
# Suffixes of periods and symbols of currencies.
SUFFIX = {"HOURLY": "/hr", "DAILY": "/day", "WEEKLY": "/wk", "MONTHLY": "/mo", "ANNUAL": "/yr"}
SYMBOL = {"USD": "$", "CAD": "$", "EUR": "€", "GBP": "£"}


def amount(c: Column) -> Column:
    """Text as a number; blank or not finite is null."""
    n = F.nullif(stripped(c), F.lit("")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def money(value: Column, currency: Column) -> Column:
    number = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    code = F.nullif(currency, F.lit(""))
    return F.concat(F.coalesce(lookup(SYMBOL, code), F.concat(code, F.lit(" ")), F.lit("")), number)


def salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """A range, From, Up to, or a dash; the period as given, never converted."""
    a, b, suffix = amount(low), amount(high), F.coalesce(lookup(SUFFIX, period), F.lit(""))
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(money(a, currency), F.lit("–"), money(b, currency), suffix))
        .when(a.isNotNull(), F.concat(F.lit("From "), money(a, currency), suffix))
        .when(b.isNotNull(), F.concat(F.lit("Up to "), money(b, currency), suffix))
        .otherwise(ABSENT)
    )


def remote(c: Column) -> Column:
    return F.when(c, "Remote").when(~c, "On-site").otherwise(ABSENT)


def heartbeat(age_s: Column) -> Column:
    """never, fresh (the future too), aging or stale."""
    return F.when(age_s.isNull(), "never").when(age_s < 90, "fresh").when(age_s < 300, "aging").otherwise("stale")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("long").cast("string"), 2, "0")


def duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(ms.isNull() | (ms < 0), ABSENT)
        .when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("long").cast("string"), F.lit("ms")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), _two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), _two(s % 60), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def age(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds.isNull(), "never").when(s < 60, part(1, "s")).when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def since_start(ms: Column) -> Column:
    s = ms / 1000
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.format_string("%.1fs", s)).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), _two(F.floor(s % 60)), F.lit("s")))


# How a scan that stopped early is recorded.
OUTCOMES = {
    "backend_unavailable": ("Backend was unavailable during scan; please retry", "backend_unavailable", "transient"),
    "sw_died": ("Service worker died during scan; please retry", "sw_died", "transient"),
    "stop_requested": ("Scan stopped by user", "user_stopped", "coordination"),
    "session": ("Session expired during scan", "session_expired", "persistent"),
    "captcha": ("CAPTCHA challenge during scan", "captcha", "persistent"),
    "rate_limited": ("Rate limited during scan", "rate_limited", "transient"),
}


def scan_outcome(reason: Column) -> dict[str, Column]:
    out = {k: lookup({r: v[i] for r, v in OUTCOMES.items()}, reason) for i, k in enumerate(("error_message", "failure_reason", "failure_category"))}
    return {"status": F.when(out["failure_reason"].isNotNull(), "failed").otherwise("completed")} | out


def setup_error(message: Column) -> Column:
    m = F.lower(message)
    return ordered([(w, m.contains(w)) for w in ("config", "popup", "timeout", "permission", "run_log_update")], "unknown")


def session_probe(url: Column, status: Column, body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 8192))
    marked = head.rlike("captcha|verify you are human|challenge")
    return ordered(
        [
            ("captcha", F.lower(url).rlike("captcha|challenge|checkpoint")), ("expired", F.lower(url).rlike("/login|/signin|/authwall")), ("rate_limited", status == 429),
            ("captcha", (status == 403) & marked), ("expired", status == 403), ("captcha", status.between(200, 299) & marked), ("live", status.between(200, 299)),
            ("unknown_treat_as_live", status.isNull() | (status >= 500)),
        ],
        "unknown",
    )


def card_result(response: Column, error: Column, rejected: Column, existing: Column, duplicate: Column) -> Column:
    return ordered([("no_response", ~response), ("error", error), ("rejected", rejected), ("existing", existing), ("content_duplicate", duplicate)], "new")


def match_results(results: Column, notes: Column) -> Column:
    """Counts first, then a retired claim, then notes; a claim summary of JSON null counts as none."""
    v = F.try_parse_json(results)
    summary = F.try_variant_get(v, "$.claim_summary", "map<string,long>")
    total = F.aggregate(F.map_values(summary), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(summary.isNotNull(), F.concat(total.cast("string"), F.lit(" claimed"))).when(F.try_variant_get(v, "$.claim_retired", "boolean"), "claim retired").otherwise(F.coalesce(F.nullif(notes, F.lit("")), F.lit(ABSENT)))


def placeholder(c: Column, text: str = "(setup pending)") -> Column:
    return F.when(present(c), c).otherwise(text)


def error_text(body: Column) -> Column:
    """One message from the shapes an error's detail may have: text, list of {msg}, object with message or error, or none."""
    v = F.try_parse_json(body)
    d = F.try_variant_get(v, "$.detail", "variant")
    kind = F.schema_of_variant(d)
    listed = F.array_join(F.transform(d.try_cast("array<variant>"), lambda x: F.try_variant_get(x, "$.msg", "string")), "; ")
    return F.when(kind == "STRING", F.try_variant_get(v, "$.detail", "string")).when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(d, "$.message", "string"), F.try_variant_get(d, "$.error", "string"))).otherwise("unexpected response")


def window_seconds(hours_since: Column, bound: Column) -> Column:
    """How far a search looks back: null without a bound; the whole bound at first or right after a run; an hour at least."""
    back = F.when(hours_since < 0.5, bound.cast("double")).otherwise(F.least(hours_since, bound.cast("double")))
    seconds = F.when(hours_since.isNull(), bound * 3600).otherwise(F.greatest(F.round(back * 3600), F.lit(3600)))
    return F.when(bound > 0, F.concat(F.lit("r"), seconds.cast("long").cast("string")))


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(30000.0))
