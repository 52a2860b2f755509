"""Settings, configuration and profile: reading with defaults, merging, and writing in one step."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

# Keys that a merge drops, and the profile of nobody.
LEGACY_KEYS = ("fit_score_req_weight", "fit_score_nth_weight")
EMPTY_PROFILE = {
    "personal": {"name": "", "email": "", "phone": None, "location": "", "urls": []}, "education": [], "work_experience": [], "projects": [], "other": [], "extra_skills": [],
    "_extracted": {"yoe": None, "skills": [], "extraction_mode": None, "extracted_at": None},
}


def shelf_life_days(value: Column, default: int = 7) -> Column:
    """A whole number of days, 1 at least; null or anything else is the default."""
    days = F.regexp_replace(value, r"^\s+|\s+$", "").try_cast("int")
    return F.when(days >= 1, days).otherwise(default)


def merged(existing: Column, updates: Column) -> Column:
    """Two maps as one, the second's values first, without legacy keys. A null value of the second is a value: it was given."""
    kept = F.map_filter(existing, lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    return F.map_filter(F.map_concat(kept, updates), lambda k, _: ~k.isin(*LEGACY_KEYS))


def profile_or_empty(raw: Column) -> Column:
    """The profile, or that of nobody where the text is missing, malformed or no object."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return F.when(kind.startswith("OBJECT"), raw).otherwise(F.lit(json.dumps(EMPTY_PROFILE)))


def _text(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path, wholetext=True).first()[0]  # one small file


def read_config(spark: SparkSession, path: str) -> dict:
    """A missing file is no setting at all; a malformed one is an error."""
    raw = _text(spark, path)
    return {} if raw is None else json.loads(raw)


def read_profile(spark: SparkSession, path: str) -> dict:
    raw = _text(spark, path)
    try:
        found = json.loads(raw or "")
    except ValueError:
        found = None
    return found if isinstance(found, dict) else EMPTY_PROFILE


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    """Written beside and renamed, so that a reader sees the old file or the new one."""
    spark.createDataFrame([(json.dumps(data, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.building")
    store.move(spark, f"{path}.building", path)


def update_config(spark: SparkSession, path: str, updates: dict) -> dict:
    """A shallow merge of what is there with the updates, without legacy keys."""
    data = {k: v for k, v in (read_config(spark, path) | updates).items() if k not in LEGACY_KEYS}
    write_json(spark, path, data)
    return data


def publish_updates(stream: DataFrame, path: str, checkpoint: str):
    """Run-log updates for listeners, without the large trace: pruned before anything is written, a folder for each batch."""
    pruned = stream.drop("debug_log")

    def publish(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={batch}")

    return pruned.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()
