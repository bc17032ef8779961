"""Governance tables derived from the driver tables, each with the SQL that states the same.

``documents`` become a corpus of files, ``labels`` the owners' overrides, ``conversations`` files
with one version per turn, ``events`` file events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256_hex, strip
from ..operators.bundles import context_bundles
from ..operators.governance import (
    Catalog,
    Category,
    Rule,
    apply_governance,
    audit_note,
    build_audit_rows,
    match_rules,
    resolve_categories,
)
from ..operators.lineage import assign_components
from ..operators.routing import route, skip_events
from ..operators.versions import assign_file_ids, last_changes, self_changes
from ..sources.files import extract
from ..functions.times import as_timestamp
from ..session import cut_lineage, spread

RULES = (
    Rule("email", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", min_level="P1", hint="e-mail address"),
    Rule("card", r"[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}", min_level="P1", hint="card-like number"),
    Rule("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", min_level="P2", hint="network address"),
    Rule("license", keywords=("license", "licence"), min_level="P3"),
    Rule("broken", "(", keywords=("e",), min_level="P1"),
    Rule("question", keywords=("?",)),
)
CATALOG = Catalog((Category("en", "English"), Category("fr", "French"), Category("de", "German")), "multi")
ROOTS = ("/corpus",)
# The account of a file is its whole text with runs of blanks as one space; a space by itself is one already.
BLANKS = r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]"

ROUTE = {"extensions": (".txt", ".md", ".docx"), "min_bytes": 300, "max_bytes": 20_000}
SKIP_KEYWORDS = ("copy", "nf", "na")
SKIP_AT = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    group = F.floor(F.col("doc_id") / 4)
    suffix = (
        F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, " (1)").when(F.col("doc_id") % 4 == 2, " - copy").otherwise("_v2")
    )
    ext = F.when(group % 3 == 0, "txt").when(group % 3 == 1, "md").otherwise("docx")
    path = F.concat(
        F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/n"),
        F.substring(F.md5(group.cast("string")), 1, 8), suffix, F.lit("."), ext,
    )
    return docs.select(
        F.col("doc_id").alias("ord"),
        "text",
        "lang",
        "source",
        path.alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        sha256_hex("text").alias("sha256"),
        F.trim(F.regexp_replace("text", BLANKS, " ")).alias("summary"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("doc_id") * 60_000_000).alias("last_analyzed_utc"),
    ).withColumn("last_checked_utc", F.col("last_analyzed_utc"))


CORPUS_SQL = r"""
corpus AS (
  SELECT doc_id AS ord, text, lang, source,
    '/corpus/' || source || '/' || lang || '/n' || substr(md5(CAST(doc_id // 4 AS VARCHAR)), 1, 8)
      || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' (1)' WHEN 2 THEN ' - copy' ELSE '_v2' END
      || '.' || CASE (doc_id // 4) % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'docx' END AS path,
    strlen(text) AS length, sha256(text) AS sha256,
    trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')) AS summary,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS last_analyzed_utc
  FROM documents)"""

# File-name parts and the lineage key, on top of any table with a path.
NAME_SQL = r"""regexp_extract(path, '[^/]*$')"""
KEY_SQL = (
    r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)\.[^.]*$', 1), '\s*\(\d+\)\s*$', ''),"
    r" '(?i)\s*-\s*copy\s*$', ''), '(?i)\s*-\s*복사본\s*$', '') || regexp_extract(path, '\.[^.]*$'))"
)
FOLDER_SQL = r"regexp_replace(path, '/[^/]*$', '')"
TOKENS_SQL = r"list_sort(list_distinct(regexp_extract_all(lower(summary), '[\p{L}\p{N}_]{2,}')))"


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are set to P1, poor ones get a tag and an invalid level; half of the paths
    are written in capitals."""
    labels = table(spark, sf_dir, "labels")
    named = corpus(spark, sf_dir).select("ord", "path").join(labels, F.col("ord") == F.col("doc_id"))
    picked = named.filter((F.col("toxic") == 1) | (F.col("quality") == 0))
    return picked.select(
        F.when(F.col("ord") % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"),
        F.when((F.col("toxic") == 0) | (F.col("quality") == 0), F.array(F.lit(" low-quality "), F.lit(" "))).alias("tags"),
        F.when(F.col("toxic") == 1, "P1").otherwise("X9").alias("security_level"),
        "ord",
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with the model's answer and the rule hits."""
    source = (
        F.when(F.col("ord") % 4 == 0, "lite_rt").when(F.col("ord") % 4 == 1, "lm_studio").when(F.col("ord") % 4 == 2, "openai").otherwise("mock")
    )
    reason = F.when(F.col("ord") % 4 == 3, "no_scorer").when(F.col("ord") % 8 == 0, "retry_after_schema_fail").otherwise("")
    proposed = F.when(F.col("ord") % 3 == 0, F.array("lang", F.lit("en"), F.lit("zz")))
    return corpus(spark, sf_dir).select(
        "*",
        F.array("lang", "source").alias("model_tags"),
        F.when(F.col("ord") % 13 == 0, "P3").otherwise("P4").alias("model_security_level"),
        source.alias("inference_source"),
        reason.alias("inference_reason"),
        proposed.alias("proposed_ids"),
        F.when(F.col("ord") % 3 == 1, F.col("lang")).alias("proposed_id"),
        match_rules("text", RULES).alias("hits"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files_current``: governed files of the corpus (with their text). A level that is not the model's
    is the last change, and a copy is related to the file that it is named after."""
    governed = apply_governance(judged(spark, sf_dir), overrides(spark, sf_dir))
    chosen = resolve_categories(CATALOG, "proposed_ids", "proposed_id", "model_tags")
    raised, copied = F.col("security_level") != F.col("model_security_level"), F.col("ord") % 4 != 0
    return governed.select(
        "*",
        F.substring(F.sha2("path", 256), 1, 32).alias("file_id"),
        chosen["ids"].alias("category_ids"),
        chosen["needs_review"].alias("category_needs_review"),
        F.when(raised, F.concat(F.lit("level "), "model_security_level", F.lit(" -> "), "security_level")).alias("last_change_summary"),
        F.when(raised, F.col("last_analyzed_utc")).alias("last_change_utc"),
        F.when(copied, F.array(F.regexp_replace("path", r"(?: \(1\)| - copy|_v2)(\.[^.]*)$", "$1"))).alias("related_paths"),
    )


FILES_SQL = (
    CORPUS_SQL
    + r""",
hits AS (
  SELECT corpus.*,
    regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') AS h_email,
    regexp_matches(text, '[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}') AS h_card,
    regexp_matches(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}') AS h_ipv4,
    contains(lower(text), 'license') OR contains(lower(text), 'licence') AS h_license,
    contains(text, '?') AS h_question,
    CASE WHEN ord % 13 = 0 THEN 'P3' ELSE 'P4' END AS model_security_level,
    CASE ord % 4 WHEN 0 THEN 'lite_rt' WHEN 1 THEN 'lm_studio' WHEN 2 THEN 'openai' ELSE 'mock' END AS inference_source,
    CASE WHEN ord % 4 = 3 THEN 'no_scorer' WHEN ord % 8 = 0 THEN 'retry_after_schema_fail' ELSE '' END AS inference_reason
  FROM corpus),
floored AS (
  SELECT *, CASE WHEN h_email OR h_card THEN 'P1' WHEN h_ipv4 THEN 'P2' WHEN h_license THEN 'P3' ELSE '' END AS floor_level,
    concat_ws(',', CASE WHEN h_email THEN 'email' END, CASE WHEN h_card THEN 'card' END, CASE WHEN h_ipv4 THEN 'ipv4' END,
      CASE WHEN h_license THEN 'license' END, CASE WHEN h_question THEN 'question' END) AS rule_hits
  FROM hits),
owned AS (
  SELECT f.*, coalesce(l.toxic = 1 OR l.quality = 0, FALSE) AS owner_override,
    coalesce(l.quality = 0, FALSE) AS owner_tags, coalesce(l.toxic = 1, FALSE) AS owner_level
  FROM floored f LEFT JOIN labels l ON l.doc_id = f.ord),
files AS MATERIALIZED (SELECT *, CASE WHEN security_level <> model_security_level THEN 'level ' || model_security_level || ' -> ' || security_level END AS last_change_summary
  FROM (SELECT *,
    CASE WHEN owner_level THEN 'P1' WHEN owner_override OR floor_level = '' THEN model_security_level
         ELSE least(model_security_level, floor_level) END AS security_level,
    CASE WHEN owner_override OR floor_level = '' OR floor_level >= model_security_level THEN '' ELSE floor_level END AS rule_floor,
    CASE WHEN owner_tags THEN ['low-quality'] ELSE [lang, source] END AS tags,
    substr(sha256(path), 1, 32) AS file_id,
    CASE WHEN ord % 3 = 0 THEN list_concat(CASE WHEN lang = 'en' THEN ['en'] WHEN lang IN ('fr', 'de') THEN [lang, 'en'] ELSE ['uncategorized', 'en'] END, ['uncategorized'])
         WHEN lang IN ('en', 'fr', 'de') THEN [lang] ELSE ['uncategorized'] END AS category_ids
  FROM owned))"""
)


def stored(df: DataFrame) -> DataFrame:
    """Written out without its text, as a governance table that several operators read would be."""
    return cut_lineage(df.drop("text", "hits"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the component made of their copy key."""
    return assign_components(files(spark, sf_dir), "filename_key")


MEMBERS_SQL = (
    FILES_SQL
    + f""",
members AS MATERIALIZED (SELECT *, {KEY_SQL} AS group_key, {NAME_SQL} AS basename, {FOLDER_SQL} AS folder FROM files),
sizes AS (
  SELECT group_key, count(*) AS size, count(DISTINCT sha256) AS variants,
    arg_min(path, (last_analyzed_utc, lower(path))) AS label_path
  FROM members GROUP BY group_key),
multi AS (SELECT * FROM sizes WHERE size >= 2)"""
)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation is a version of one file."""
    turns = table(spark, sf_dir, "conversations")
    made = turns.select(
        F.concat(F.lit("/conv/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        sha256_hex("text").alias("sha256"),
        F.concat(F.size(F.split("text", "\n")).cast("string"), F.lit(" lines")).alias("summary"),
        "text",
        F.timestamp_micros(
            F.lit(1_704_067_200_000_000) + F.col("turn") * 1_800_000_000 + F.col("conv_id") * 1_000_000
        ).alias("last_analyzed_utc"),
    )
    return made


VERSIONS_SQL = r"""
versions AS (
  SELECT '/conv/c' || conv_id || '.md' AS path, conv_id * 1000 + turn AS ord, sha256(text) AS sha256,
    len(string_split(text, chr(10))) || ' lines' AS summary, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn * 30) + to_seconds(conv_id) AS last_analyzed_utc
  FROM conversations),
stepped AS (
  SELECT *, lag(sha256) OVER w AS prev_sha256, lag(summary) OVER w AS prev_summary
  FROM versions WINDOW w AS (PARTITION BY path ORDER BY last_analyzed_utc, ord)),
changes AS (
  SELECT *, prev_sha256 IS NOT NULL AND prev_sha256 <> sha256 AS changed,
    CASE WHEN prev_sha256 IS NOT NULL AND prev_sha256 <> sha256 THEN CASE WHEN prev_summary <> summary
      THEN 'summary: ' || substr(prev_summary, 1, 80) || ' -> ' || substr(summary, 1, 80) ELSE 'text' END END AS change_summary
  FROM stepped)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_changes(assign_file_ids(versions(spark, sf_dir)))


def told_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``changes``, the account of a version being its whole text, as in the corpus."""
    told = versions(spark, sf_dir).withColumn("summary", F.trim(F.regexp_replace("text", BLANKS, " ")))
    return self_changes(assign_file_ids(told))


TOLD_SQL = VERSIONS_SQL.replace(
    "len(string_split(text, chr(10))) || ' lines' AS summary", r"trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')) AS summary"
).replace("CASE WHEN prev_summary <> summary", "CASE WHEN prev_summary <> '' AND summary <> '' AND prev_summary <> summary")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current conversation files with their last change line."""
    from ..operators.versions import files_current

    steps = told_changes(spark, sf_dir)
    return files_current(steps.drop("change_summary")).join(last_changes(steps), "path", "left")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("-"),
            (F.col("event_id") % 3).cast("string"), F.lit(".log"),
        ).alias("path"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").alias("ord"),
    )


EVENTS_SQL = r"""
fs_events AS (
  SELECT '/u' || user_id || '/' || event_type || '-' || (event_id % 3) || '.log' AS path, '/u' || user_id AS folder,
    epoch_us(ts) AS us, event_id AS ord
  FROM events)"""


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path", F.col("last_analyzed_utc").alias("event_ts"), "ord")


DOCUMENT_EVENTS_SQL = (
    CORPUS_SQL
    + f""",
fs_events AS MATERIALIZED (SELECT path, {FOLDER_SQL} AS folder, epoch_us(last_analyzed_utc) AS us, ord FROM corpus)"""
)


def bundles_sql(window_minutes: int, max_bundles: int = 60) -> str:
    """Bundles over ``fs_events(path, folder, us, ord)``, one row per bundle in ``bundles``."""
    return f""",
near AS (
  SELECT a.path AS anchor_path, a.us AS anchor_us, a.ord AS ord, e.path AS path, min((e.us, e.ord)) AS seen
  FROM fs_events a JOIN fs_events e ON a.folder = e.folder AND a.path <> e.path
    AND e.us BETWEEN a.us - {window_minutes * 60_000_000} AND a.us + {window_minutes * 60_000_000}
  GROUP BY a.path, a.us, a.ord, e.path),
bundles AS MATERIALIZED (
  SELECT anchor_path, anchor_us, ord, list(path ORDER BY seen, path) AS related_paths,
    substr(sha256(anchor_path || '|' || printf('%.3f', anchor_us / 1e6) || '|' || string_agg(path, ',' ORDER BY seen, path)), 1, 12) AS bundle_id
  FROM near GROUP BY anchor_path, anchor_us, ord ORDER BY anchor_us DESC, ord DESC LIMIT {max_bundles})"""


def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = document_events(spark, sf_dir)
    return context_bundles(events, events, 120, 60)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as raw files whose text was read back; `.docx` has no extractor here."""
    raw = corpus(spark, sf_dir).select("path", "ord", "length", "sha256", F.col("text").cast("binary").alias("content"))
    return extract(raw).drop("content")


def blanked(texts: DataFrame) -> DataFrame:
    """Every 17th file has nothing but blanks in it."""
    return texts.withColumn("text", F.when(F.col("ord") % 17 == 0, F.regexp_replace("text", r"(?s).", " ")).otherwise(F.col("text")))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are known already, the toxic ones with another content."""
    labels = table(spark, sf_dir, "labels")
    known = (
        corpus(spark, sf_dir)
        .join(labels, F.col("ord") == F.col("doc_id"))
        .select("path", F.when(F.col("toxic") == 1, sha256_hex("path")).otherwise(F.col("sha256")).alias("sha256"))
    )
    return route(blanked(extracted(spark, sf_dir)), known, **ROUTE)


ROUTED_SQL = (
    CORPUS_SQL
    + r""",
routed AS (
  SELECT corpus.*, CASE
    WHEN length NOT BETWEEN 300 AND 20000 THEN 'skip_filter'
    WHEN path LIKE '%.docx' THEN 'skip_extract'
    WHEN ord % 17 = 0 THEN 'skip_empty'
    WHEN l.doc_id IS NOT NULL AND l.toxic <> 1 THEN 'skip_hash'
    ELSE 'classify' END AS outcome
  FROM corpus LEFT JOIN labels l ON l.doc_id = corpus.ord)"""
)


def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_events(routed(spark, sf_dir), as_timestamp(SKIP_AT), SKIP_KEYWORDS)


SKIPS_SQL = (
    ROUTED_SQL
    + f""",
skips AS (
  SELECT path, 'unsupported extension: .docx' AS reason, CASE WHEN contains({NAME_SQL}, 'copy') THEN 'copy'
    WHEN contains({NAME_SQL}, 'nf') THEN 'nf' WHEN contains({NAME_SQL}, 'na') THEN 'na' END AS keyword
  FROM routed WHERE outcome = 'skip_extract')"""
)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_of(files(spark, sf_dir))


def audit_of(governed: DataFrame) -> DataFrame:
    """Audit rows; those of files without a real model name a copy of the file."""
    note = audit_note(
        F.concat(F.lit("keep with\n"), F.col("lang")),
        F.when(F.col("security_level") == "P1", "redact_before_external").when(F.col("source") == "src1", "nowhere").otherwise("ok_external"),
    )
    rows = build_audit_rows(governed.withColumn("_note", note), "_note", {"P1": "Secret", "P2": "Sensitive"})
    copied = F.when(F.col("source") == "mock", F.concat(F.lit("copy of "), "file")).otherwise(F.col("file"))
    return rows.withColumn("file", copied)


AUDIT_SQL = (
    FILES_SQL
    + f""",
audit AS (
  SELECT last_analyzed_utc AS ts, CASE WHEN inference_source = 'mock' THEN 'copy of ' ELSE '' END || {NAME_SQL} AS file,
    sha256, CASE security_level WHEN 'P1' THEN 'Secret (P1)' ELSE 'Sensitive (P2)' END AS level,
    array_to_string(tags, ', ') AS tags, inference_source AS source,
    'keep with / ' || lang || ' [sharing: ' || CASE WHEN security_level = 'P1' THEN 'redact_before_external'
      WHEN source = 'src1' THEN 'internal_only' ELSE 'ok_external' END || ']' AS note
  FROM files WHERE security_level IN ('P1', 'P2'))"""
)
