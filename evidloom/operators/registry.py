"""The asset registry: lookups, the state of the whole, and joins by asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import extension, frame_name, iso_stamp, preview_path


def global_state(assets: DataFrame, current: str | None = None, uploading: str = "Uploading", status: str = "status") -> DataFrame:
    """One row: the number of assets and ``state``: Handling while one is worked on, else Uploading, else Waiting."""
    state = F.when(F.lit(current).isNotNull(), "Handling").when(F.coalesce(F.bool_or(F.col(status) == uploading), F.lit(False)), "Uploading").otherwise("Waiting")
    return assets.agg(F.count(F.lit(1)).alias("n_assets"), state.alias("state"))


def sessions_state(sessions: DataFrame, status: str = "status") -> DataFrame:
    """One row: the number of sessions and Querying while one isn't idle, failed ones included, else Idle."""
    return sessions.agg(F.count(F.lit(1)).alias("n_sessions"), F.when(F.coalesce(F.bool_or(F.col(status) != "Idle"), F.lit(False)), "Querying").otherwise("Idle").alias("state"))


def lookup(rows: DataFrame, id_col: str, value=None) -> DataFrame:
    """The row with that id, or all rows without one."""
    return rows if value is None else rows.filter(F.col(id_col) == F.lit(value))


def queued(assets: DataFrame) -> DataFrame:
    """Ids that wait, each once, in order of arrival."""
    return assets.filter(F.col("status") == "Raw").groupBy("asset_id").agg(F.min("created_at").alias("created_at")).orderBy("created_at", "asset_id")


def structure_state(assets: DataFrame) -> DataFrame:
    return assets.select("asset_id", F.when(F.col("status") == "Ready", "ready").otherwise("processing").alias("structure"))


def normalised(assets: DataFrame, now: Column | None = None) -> DataFrame:
    """Assets as they are shown, empty fields read as missing: (id, name, type, status, created_at, asset_processed_path, progress)."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    status = F.coalesce(given("status"), F.lit("Raw"))
    kind = F.coalesce(given("asset_type"), F.when(F.endswith("asset_id", F.lit(".pdf")), "pdf").otherwise("video"))
    stamp = iso_stamp(F.current_timestamp() if now is None else now)
    return assets.select(F.col("asset_id").alias("id"), F.col("asset_id").alias("name"), kind.alias("type"), status.alias("status"), F.coalesce(given("created_at"), stamp).alias("created_at"), "asset_processed_path", F.when(status == "Ready", 100).otherwise(0).alias("progress"))


def previews(assets: DataFrame) -> DataFrame:
    return assets.select("asset_id", preview_path(F.col("asset_raw_path")).alias("raw_path"), F.col("asset_type").alias("type"))


def present(visuals: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Pictures and videos whose file exists, with what they are by extension; others are skipped."""
    kind = F.when(extension(F.col(key)).isin("jpg", "jpeg", "png", "webp"), "image").when(extension(F.col(key)).isin("mp4", "avi", "mov", "mkv"), "video")
    return visuals.join(files.select(key), key, "left_semi").withColumn("kind", kind).filter("kind is not null")


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: later ones replace."""
    value = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("row")).select(*keys, "row.*")


def with_assets(evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """Evidence with the path of its asset; evidence of unknown assets leads nowhere and is left out."""
    return evidence.join(assets.select(F.col("asset_id").alias("asset_name"), "asset_processed_path"), "asset_name")


def with_frames(evidence: DataFrame, frames: DataFrame) -> DataFrame:
    """Evidence with the frame of its asset and second, by the frame's name; without one, null."""
    return evidence.withColumn("name", frame_name(F.col("timestamp"))).join(frames.select("asset_name", "name", "path"), ["asset_name", "name"], "left")


def merged(own: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Own rows with what the server has of them; what it hasn't stays."""
    more = [c for c in server.columns if c != key and c in own.columns]
    other = server.select(F.col(key).alias("_key"), F.struct(*more).alias("_row"))
    joined = own.join(other, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(F.col("_row")[c], F.col(c)).alias(c) if c in more else F.col(c) for c in own.columns))


def overlaid(defaults: Column, given: Column) -> Column:
    """A map with another laid over it."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)


def instructions(rows: DataFrame, table: dict[str, str], key: str = "strategy", default: str = "scene_description") -> DataFrame:
    """Rows with the instruction of their strategy, the default's for unknown ones."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return rows.withColumn("instruction", F.coalesce(F.try_element_at(known, F.col(key)), F.lit(table.get(default))))
