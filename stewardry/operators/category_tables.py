"""Business categories of files where the catalog is a table of any size.

The same rules as :func:`governance.resolve_categories`: the proposed ids count, else the single one,
else the tags that name a category. Ids meet the catalog by a join, one row per proposal, and are put
together again in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .governance import UNCATEGORIZED


def resolve_category_table(
    files: DataFrame,
    catalog: DataFrame,
    mode: str = "multi",
    key: str = "path",
    category_ids: str = "proposed_ids",
    category_id: str = "proposed_id",
    tags: str = "model_tags",
) -> DataFrame:
    """``key, ids, labels, needs_review`` of every row of ``files``; ``catalog(ord, id, label)``.

    Known ids appear once, where they come first; every unknown one turns into its own
    ``uncategorized``. ``labels`` goes with ``ids``. Of catalog rows with one id the first counts.
    """
    known = (
        catalog.withColumn("id", strip("id")).filter(F.coalesce("id", F.lit("")) != "")
        .groupBy("id").agg(F.min_by("label", "ord").alias("label"))
        .select("id", F.coalesce(F.nullif(strip("label"), F.lit("")), "id").alias("label"), F.lit(True).alias("known"))
    )
    entry = lambda kind: lambda x: F.struct(strip(x).alias("id"), F.lit(kind).alias("kind"))
    filled = lambda a: F.filter(a, lambda e: e["id"] != "")
    proposed = filled(F.transform(category_ids, entry("id")))
    single = filled(F.array(entry("id")(F.col(category_id))))
    named = F.transform(
        F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip),
        lambda t: F.when(t.startswith("cat:"), entry("id")(F.substring(t, F.lit(5), F.length(t)))).otherwise(entry("tag")(t)),
    )
    chosen = F.when(F.size(proposed) > 0, proposed).when(F.size(single) > 0, single).otherwise(F.filter(named, lambda e: e["id"].isNotNull()))
    each = files.select(key, F.posexplode_outer(chosen).alias("at", "e")).select(key, "at", "e.id", "e.kind").join(known, "id", "left")
    is_known = F.coalesce("known", F.lit(False)) | (F.col("id") == UNCATEGORIZED)
    # A tag that is no category is no proposal.
    counts = F.col("id").isNotNull() & ((F.col("kind") == "id") | (F.coalesce("known", F.lit(False)) & (F.col("id") != UNCATEGORIZED)))
    mapped = F.when(is_known, F.col("id")).otherwise(UNCATEGORIZED)
    rows = each.select(key, "at", mapped.alias("id"), F.coalesce("label", F.lit(UNCATEGORIZED)).alias("label"), (~is_known).alias("unknown"), counts.alias("counts"))
    # One row per file and id: the first place, and the places of unknown ones besides.
    places = F.array_sort(F.collect_list(F.when(F.col("counts"), F.struct("at", "unknown"))))
    merged = rows.groupBy(key, "id").agg(places.alias("places"), F.min("label").alias("label"))
    kept = F.filter("places", lambda p, i: (i == 0) | p["unknown"])
    lists = merged.select(key, "id", "label", F.transform(kept, lambda p: p["at"]).alias("ats"))
    ordered = F.array_sort(F.flatten(F.collect_list(F.transform("ats", lambda a: F.struct(a.alias("at"), F.col("id").alias("id"), F.col("label").alias("label"))))))
    found = lists.groupBy(key).agg(ordered.alias("found"))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(UNCATEGORIZED).alias("id"), F.lit(UNCATEGORIZED).alias("label")))
    whole = F.when(F.size("found") > 0, F.col("found")).otherwise(none)
    shown = whole if mode.strip().lower() == "multi" else F.slice(whole, 1, 1)
    return found.select(key, shown.alias("found")).select(
        key, F.transform("found", lambda e: e["id"]).alias("ids"), F.transform("found", lambda e: e["label"]).alias("labels")
    ).withColumn("needs_review", F.array_contains("ids", UNCATEGORIZED))
