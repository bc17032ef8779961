"""Consistency checks of the governance tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import clean_level
from ..functions.text import basename, strip
from ..session import cut_lineage


def _record_findings(files: DataFrame) -> DataFrame:
    """Checks that look at one record: four conditions, one pass."""
    model, level = clean_level("model_security_level"), clean_level("security_level")
    sha = F.coalesce("sha256", F.lit(""))
    name = basename("path")

    def finding(code: str, when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.col("path").alias("path"), message.alias("message")))

    bad = F.coalesce("bad_meta", F.lit(False)) if "bad_meta" in files.columns else F.lit(False)
    mismatch = (
        (model != "") & (level != "") & (model != level)
        & ~F.coalesce("owner_override", F.lit(False))
        & (F.coalesce("rule_floor", F.lit("")) == "")
    )
    checks = F.array(
        finding("bad_meta", bad, F.concat(F.lit("not an object: "), F.col("path"))),
        finding("empty_summary", ~bad & (strip(F.coalesce("summary", F.lit(""))) == ""), name),
        finding("level_mismatch", ~bad & mismatch, F.concat(F.lit("model="), model, F.lit(" effective="), level, F.lit(": "), name)),
        finding("bad_sha", ~bad & (sha != "") & (F.length(sha) != 64), F.concat(name, F.lit(" sha256 length="), F.length(sha).cast("string"))),
    )
    return files.select(F.explode(F.array_compact(checks)).alias("f")).select("f.*")


def _audit_text() -> Column:
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file", "sha256", "level", "tags", "source", "note")])


def _grams(text: Column, size: int) -> Column:
    count = F.length(text) - (size - 1)
    return F.array_distinct(
        F.when(
            count >= 1,
            F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))
    )


def named_nowhere(names: DataFrame, audit: DataFrame, gram: int = 4) -> DataFrame:
    """``names(name)`` that occur in no audit row, not even inside another word.

    Names equal to an audited file name are settled by an equi-join. The few that are left look
    for rows that hold their rarest piece of ``gram`` characters, and only those are compared.
    """
    left = names.join(audit.select(F.col("file").alias("name")).distinct(), "name", "left_anti")
    left = left.filter(F.col("name") != "").distinct().withColumn("piece", F.least(F.length("name"), F.lit(gram)))
    left = cut_lineage(left)
    # At most ``gram`` piece lengths; those below it occur only with names that short.
    sizes = [r.piece for r in left.select("piece").distinct().collect()]
    if not sizes:
        return left.select("name")
    texts = cut_lineage(audit.select(_audit_text().alias("text")).distinct().withColumn("row", F.monotonically_increasing_id()))
    # Postings carry the number of a row; its text is fetched for the rows that a name points to.
    postings = reduce(
        DataFrame.unionByName,
        [texts.select("row", F.lit(n).alias("piece"), F.explode(_grams(F.col("text"), n)).alias("g")) for n in sizes],
    )
    frequency = postings.groupBy("piece", "g").agg(F.count(F.lit(1)).alias("n"))
    pieces = reduce(
        DataFrame.unionByName,
        [
            left.filter(F.col("piece") == n).select("name", "piece", F.explode(_grams(F.col("name"), n)).alias("g"))
            for n in sizes
        ],
    )
    rarest = (
        pieces.join(frequency, ["piece", "g"], "left")
        .groupBy("name", "piece")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r"))
        .select("name", "piece", F.col("r.g").alias("g"))
    )
    pointed = rarest.join(postings, ["piece", "g"]).select("name", "row")
    found = pointed.join(texts, "row").filter(F.col("text").contains(F.col("name"))).select("name").distinct()
    return left.select("name").join(found, "name", "left_anti")


def audit_gaps(files: DataFrame, audit: DataFrame, match: str = "basename") -> DataFrame:
    """P1 and P2 files the audit log does not name. ``match="substring"`` accepts the name anywhere
    in a row, ``"basename"`` only as the row's file."""
    if match not in ("basename", "substring"):
        raise ValueError(f"unknown match {match!r}")
    level = clean_level("security_level")
    tracked = files.filter(level.isin("P1", "P2")).select("path", level.alias("level"), basename("path").alias("name"))
    tracked = tracked.filter(F.col("name") != "")
    if match == "substring":
        missing = named_nowhere(tracked.select("name").distinct(), audit)
        gaps = tracked.join(missing, "name", "left_semi")
    else:
        gaps = tracked.join(audit.select(F.col("file").alias("name")).distinct(), "name", "left_anti")
    return gaps.select(
        F.lit("audit_gap").alias("code"), "path", F.concat("level", F.lit(" not in audit log: "), "name").alias("message")
    )


def bundle_orphans(files: DataFrame, bundles: DataFrame) -> DataFrame:
    orphans = bundles.filter(F.coalesce(F.col("anchor_path"), F.lit("")) != "").join(
        files.select(F.col("path").alias("anchor_path")), "anchor_path", "left_anti"
    )
    return orphans.select(
        F.lit("bundle_orphan").alias("code"), F.col("anchor_path").alias("path"), basename("anchor_path").alias("message")
    )


def governance_lint(
    files: DataFrame, audit: DataFrame, bundles: DataFrame | None = None, match: str = "substring"
) -> DataFrame:
    """``code, path, message`` of every finding."""
    findings = _record_findings(files).unionByName(audit_gaps(files, audit, match))
    if bundles is not None:
        findings = findings.unionByName(bundle_orphans(files, bundles))
    return findings
