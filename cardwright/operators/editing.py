"""Row edits as DataFrame plans: patches with the original kept, resets, overrides and reviews."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import norm

#: Fields that a patch may change. Fixed values.
FIELDS = {
    "variables": ("symbol", "name", "meaning", "unit", "role", "source_quote", "confidence"), "parameters": ("symbol", "name", "value", "unit", "source_quote", "confidence"),
    "equations": ("label", "latex", "plaintext", "meaning", "source_quote", "confidence"), "assumptions": ("text", "source_quote", "confidence"),
}


def described() -> Column:
    """``[label] meaning (plaintext)`` of what is there; the plain text is left out where it equals the meaning."""
    part = lambda c, a, b: F.when(norm(c) != "", F.concat(F.lit(a), F.trim(c), F.lit(b)))
    return F.concat_ws(" ", part("label", "[", "]"), part("meaning", "", ""), F.when(F.coalesce("plaintext", F.lit("")) != F.coalesce("meaning", F.lit("")), part("plaintext", "(", ")")))


def patch(rows: DataFrame, patches: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """``rows`` with the fields that ``patches`` (key and some of ``fields``, null for no change) gives.

    A patched row is marked edited_by_user; the first edit keeps the whole row as JSON in original_value, later ones leave
    that as it is. Equations get their description anew.
    """
    given = [f for f in fields if f in patches.columns]
    p = patches.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in given), F.lit(True).alias("_hit"))
    joined = rows.join(p, rows[key] == p["_key"], "left")
    hit = F.col("_hit").isNotNull()
    snapshot = F.to_json(F.struct(*(c for c in rows.columns if c not in ("original_value", "edited_by_user"))), {"ignoreNullFields": "false"})
    changed = {"original_value": F.when(hit & ~F.coalesce("edited_by_user", F.lit(False)), snapshot).otherwise(F.col("original_value")), "edited_by_user": hit | F.coalesce("edited_by_user", F.lit(False))}
    changed |= {f: F.coalesce(f"_{f}", f) for f in given}
    out = joined.withColumns(changed)
    if "description" in rows.columns and "plaintext" in rows.columns:
        out = out.withColumn("description", F.when(hit, described()).otherwise(F.col("description")))
    return out.select(rows.columns)


def reset(rows: DataFrame, ids: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """``rows`` with the named ones as they were before their first edit; never edited ones stay as they are.

    A field comes back if the snapshot holds it with the right type, else the current value stays.
    """
    wanted = ids.select(F.col(key).alias("_key"), F.lit(True).alias("_hit")).distinct()
    kinds = dict(rows.dtypes)
    restored = [f for f in (*fields, "description") if f in rows.columns]
    shape = ", ".join(f"`{f}` {kinds[f]}" for f in restored)
    joined = rows.join(wanted, rows[key] == wanted["_key"], "left")
    act = F.col("_hit").isNotNull() & F.coalesce("edited_by_user", F.lit(False)) & F.col("original_value").isNotNull()
    old = F.from_json("original_value", shape)
    out = joined.withColumn("_old", old).withColumns({f: F.when(act, F.coalesce(F.col("_old")[f], F.col(f))).otherwise(F.col(f)) for f in restored} | {"_act": act})
    out = out.withColumns({"edited_by_user": F.when(F.col("_act"), F.lit(False)).otherwise(F.col("edited_by_user")), "original_value": F.when(~F.col("_act"), F.col("original_value"))})
    return out.select(rows.columns)


def override_type(extractions: DataFrame, changes: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(extractions, rejected): model_type_override set, or cleared by null; unknown types are rejected with 400, absent ids with 404."""
    good = F.col("model_type_override").isNull() | F.col("model_type_override").isin(*allowed)
    p = changes.where(good).select(F.col("id").alias("_id"), F.col("model_type_override").alias("_new"), F.lit(True).alias("_hit"))
    out = extractions.join(p, extractions["id"] == p["_id"], "left").withColumn("model_type_override", F.when(F.col("_hit").isNotNull(), F.col("_new")).otherwise(F.col("model_type_override")))
    bad = changes.where(~good).select("id", F.lit(400).alias("status_code"))
    absent = changes.where(good).join(extractions.select("id"), "id", "left_anti").select("id", F.lit(404).alias("status_code"))
    return out.select(extractions.columns), bad.unionByName(absent)


def set_visibility(projects: DataFrame, ids: DataFrame, visibility: str, now: Column) -> DataFrame:
    hit = ids.select(F.col("id").alias("_id")).distinct()
    out = projects.join(hit, projects["id"] == hit["_id"], "left")
    chosen = F.col("_id").isNotNull()
    return out.withColumns({"visibility": F.when(chosen, visibility).otherwise(F.col("visibility")), "updated_at": F.when(chosen, now).otherwise(F.col("updated_at"))}).select(projects.columns)


def open_issues(reviews: DataFrame, defaults: DataFrame) -> DataFrame:
    """(extraction_id, issues): names of unchecked review items, underscores as spaces; ``checks`` maps lie over the defaults' map."""
    # the stored checks lie over the defaults: of equal keys the stored one
    merged = defaults.crossJoin(reviews) if "extraction_id" not in defaults.columns else reviews.join(defaults, "extraction_id")
    base = F.map_filter("default_checks", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("checks"), k), F.lit(False)))
    all_checks = F.map_concat(base, F.coalesce("checks", F.expr("map()").cast("map<string,boolean>")))
    return merged.select("extraction_id", F.array_sort(F.transform(F.map_keys(F.map_filter(all_checks, lambda _, v: ~v)), lambda k: F.replace(k, F.lit("_"), F.lit(" ")))).alias("issues"))
