"""Context registry and context-level operators: S9, S10, S13, A3, F8, P5, P15."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.functions.text import context_slug, omit_list


def contexts_from_names(names: DataFrame, name_col: str = "display_name", omit_col: str | None = None) -> DataFrame:
    """Registry rows ``context_id, display_name, omit_keywords`` from display names.

    Names whose slug is empty are rejected (the reference raises on them).  A ``seq`` column, where there is one, passes through."""
    omit = omit_list(F.col(omit_col)) if omit_col else F.lit(None).cast("array<string>")
    return (names.select(context_slug(F.col(name_col)).alias("context_id"), F.col(name_col).alias("display_name"),
                         omit.alias("omit_keywords"), *(["seq"] if "seq" in names.columns else []))
                 .where("context_id IS NOT NULL"))


def upsert_contexts(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """S13 write: add or overwrite entries by ``context_id`` (anti-join + union; an empty display
    name is rejected). Within ``updates`` the last row per id wins when ``seq`` is given."""
    u = updates.where(F.coalesce(F.col("display_name"), F.lit("")) != "")
    if "seq" in u.columns:
        u = (u.groupBy("context_id")
              .agg(F.max_by(F.struct("display_name", "omit_keywords"), F.col("seq")).alias("v"))
              .select("context_id", "v.display_name", "v.omit_keywords"))
    return (registry.join(u.select("context_id"), "context_id", "left_anti")
                    .unionByName(u.select("context_id", "display_name", "omit_keywords")))


def lookup_context(registry: DataFrame, names: DataFrame) -> DataFrame:
    """S13 read: display name → first matching entry (smallest context id)."""
    return (names.join(registry, names["name"] == registry["display_name"])
                 .groupBy("name")
                 .agg(F.min_by(F.struct("context_id", "omit_keywords"), F.col("context_id")).alias("c"))
                 .select("name", "c.context_id", F.coalesce("c.omit_keywords", F.array().cast("array<string>"))
                         .alias("omit_keywords")))


def delete_contexts(registry: DataFrame, names: DataFrame) -> DataFrame:
    """S13 delete: drop the entries whose display name is listed."""
    return registry.join(names.select(F.col("name").alias("display_name")), "display_name", "left_anti")


def context_has_sources(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """F8: does each context have loaded sources? (left semi on the partition key, as a flag)."""
    present = chunks.select("context_id").distinct().withColumn("has_sources", F.lit(True))
    return (registry.select("context_id", "display_name").join(present, "context_id", "left")
                    .select("context_id", "display_name", F.coalesce("has_sources", F.lit(False)).alias("has_sources")))


def context_subjects(chunks: DataFrame) -> DataFrame:
    """A3: one subject per context (the one of its smallest chunk id) and its chunk count."""
    return chunks.groupBy("context_id").agg(F.min_by("subject", F.col("chunk_id")).alias("subject"),
                                            F.count(F.lit(1)).alias("n_chunks"))


def drop_context(chunks: DataFrame, context_ids: DataFrame) -> DataFrame:
    """S10 as a DataFrame operation: every row outside the dropped contexts."""
    return chunks.join(context_ids.select("context_id"), "context_id", "left_anti")
