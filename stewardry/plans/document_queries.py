"""Queries about single documents: names, routing, rules, owners, categories, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.levels import format_level, level_rank
from ..functions.paths import allowlist_roots, in_excluded_dir, is_unc, normalize_path, parent_depth, path_allowed
from ..functions.text import (
    basename,
    dirname,
    extension,
    label_safe,
    lineage_group_key,
    normalize_stem,
    sanitize_cell,
    sha_prefix,
    summary_tokens,
    tag_set,
    tags_cell,
)
from ..functions.times import as_timestamp, in_period, iso_utc, parse_utc, report_time
from ..operators.category_tables import resolve_category_table
from ..operators.classify import classify, extract_json, handling_hints, parse_handling, quality_flags, validate_classification
from ..operators.governance import (
    activity_rows,
    build_report,
    category_label,
    match_rules,
    report_tags,
    rule_hint_block,
    security_floor,
    sync_overrides,
)
from ..operators.rule_tables import match_rule_table
from ..operators.routing import batch_evaluation, checked, single_outcome, skip_notes, status_tally
from ..sources.files import scan_incremental
from ..sources.sinks import last_classification
from . import corpus as c
from .registry import query

AT = "2024-01-03 00:00:00"


def _text(ts: str) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


@query(
    "corpus_view",
    c.CORPUS_SQL,
    sql="SELECT ord, path, length, sha256, summary, strftime(last_analyzed_utc, '%Y-%m-%d %H:%M:%S') AS analyzed FROM corpus",
)
def corpus_view(spark: SparkSession, sf: str) -> DataFrame:
    return c.corpus(spark, sf).select("ord", "path", "length", "sha256", "summary", _text("last_analyzed_utc").alias("analyzed"))


@query(
    "path_parts",
    c.CORPUS_SQL,
    sql=rf"""SELECT path, {c.NAME_SQL} AS basename, {c.FOLDER_SQL} AS folder, regexp_extract(path, '\.[^.]*$') AS ext,
      {c.KEY_SQL} AS group_key,
      lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)\.[^.]*$', 1), ' \(1\)$', ''), ' - copy$', ''), '_v2$', '')) AS stem,
      substr(sha256, 1, 12) AS sha12, CAST(CASE WHEN source = 'src1' THEN 1 WHEN lang = 'fr' AND source = 'src2' THEN 0 ELSE 2 END AS BIGINT) AS depth, source = 'src1' AS excluded, lang IN ('en', 'fr') AS allowed
      FROM corpus""",
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    files = c.corpus(spark, sf)
    name = basename("path")
    return files.select(
        "path",
        name.alias("basename"),
        dirname("path").alias("folder"),
        extension(name).alias("ext"),
        lineage_group_key(name).alias("group_key"),
        normalize_stem(name).alias("stem"),
        sha_prefix("sha256").alias("sha12"),
        parent_depth("path", ["/corpus", "/corpus/src1/", "/corpus/src2/fr", "/elsewhere"]).cast("long").alias("depth"),
        in_excluded_dir("path", ["SRC1"]).alias("excluded"),
        (F.col("lang").isin("en", "fr") & path_allowed("path", ["/corpus"]) & ~path_allowed("path", ["/corp"])).alias("allowed"),
    )


@query(
    "normalized_paths",
    sql=r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS rest FROM pages)
      SELECT page_id, '/a/b' || regexp_replace(rtrim(rest, '/'), '/[^/]*$', '') || '/z' AS path,
        CASE WHEN page_id % 2 = 0 THEN '\\host\share' || replace(rtrim(rest, '/'), '/', '\') ELSE '/host/share' || rtrim(rest, '/') END AS share_path, page_id % 2 = 0 AS unc FROM p""",
)
def normalized_paths(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    share = F.concat(F.when(F.col("page_id") % 2 == 0, "//host/share").otherwise("/host/share"), rest)
    return c.table(spark, sf, "pages").select(
        "page_id",
        normalize_path(F.concat(F.lit(" /a/./b"), rest, F.lit("/../z"))).alias("path"),
        normalize_path(share).alias("share_path"),
        is_unc(share).alias("unc"),
    )


@query("summary_words", c.CORPUS_SQL, sql=f"SELECT ord, array_to_string({c.TOKENS_SQL}, ' ') AS words FROM corpus")
def summary_words(spark: SparkSession, sf: str) -> DataFrame:
    return c.corpus(spark, sf).select("ord", F.array_join(summary_tokens("summary"), " ").alias("words"))


@query(
    "display_cells",
    c.FILES_SQL,
    sql=r"""SELECT ord, trim(regexp_replace(replace(text, '|', '\|'), '\s+', ' ', 'g')) AS cell,
      CASE WHEN length(summary) > 80 THEN substr(translate(summary, chr(34) || chr(10) || '[]', chr(39) || ' ()'), 1, 77) || '...'
        ELSE translate(summary, chr(34) || chr(10) || '[]', chr(39) || ' ()') END AS label,
      array_to_string(tags, ', ') AS tags, array_to_string(list_transform(tags, lambda t: lower(trim(t))), '/') AS tag_set,
      CASE security_level WHEN 'P1' THEN 'Secret (P1)' ELSE security_level END AS level_name,
      CAST(4 - CAST(substr(security_level, 2) AS INTEGER) AS BIGINT) AS level_rank FROM files""",
)
def display_cells(spark: SparkSession, sf: str) -> DataFrame:
    labelled = format_level("security_level", {"P1": "Secret"})
    return c.files(spark, sf).select(
        "ord",
        sanitize_cell("text").alias("cell"),
        label_safe("summary").alias("label"),
        tags_cell("tags").alias("tags"),
        F.array_join(tag_set("tags"), "/").alias("tag_set"),
        F.when(F.col("security_level") == "P1", labelled).otherwise(F.col("security_level")).alias("level_name"),
        level_rank("security_level").cast("long").alias("level_rank"),
    )


@query(
    "time_parsing",
    sql="""SELECT event_id, epoch_us(ts) AS us, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' (UTC+00:00)' AS shown,
      date_trunc('week', ts) = DATE '2024-01-08' AS same_week, date_trunc('month', ts) = DATE '2024-01-01' AS same_month FROM events""",
)
def time_parsing(spark: SparkSession, sf: str) -> DataFrame:
    at = parse_utc(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return c.table(spark, sf, "events").select("event_id", at.alias("at")).select(
        "event_id",
        F.unix_micros("at").alias("us"),
        F.date_format("at", "yyyy-MM-dd").alias("day"),
        iso_utc("at").alias("iso"),
        report_time("at").alias("shown"),
        in_period("at", "2024-01-10 12:00:00", "weekly").alias("same_week"),
        in_period("at", "2024-01-10 12:00:00", "monthly").alias("same_month"),
    )


@query(
    "allowlist",
    sql="""SELECT '/corpus/' || source AS root, CAST(0 AS BIGINT) AS source, min(doc_id) AS ord FROM documents GROUP BY source
      UNION ALL SELECT '/out/' || lang, 1, min(doc_id) FROM documents GROUP BY lang""",
)
def allowlist(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.table(spark, sf, "documents")
    watched = docs.groupBy(F.concat(F.lit("/corpus/"), "source").alias("root")).agg(F.min("doc_id").alias("ord"))
    outputs = docs.groupBy(F.concat(F.lit("/out/"), "lang").alias("root")).agg(F.min("doc_id").alias("ord"))
    again = watched.select(F.upper("root").alias("root"), "ord")
    return allowlist_roots(watched, outputs, again).select("root", F.col("source").cast("long").alias("source"), "ord")


@query("routing", c.ROUTED_SQL, sql="SELECT path, outcome FROM routed")
def routing(spark: SparkSession, sf: str) -> DataFrame:
    return c.routed(spark, sf).select("path", "outcome")


@query(
    "routing_tally",
    c.ROUTED_SQL,
    sql="""SELECT CASE outcome WHEN 'skip_filter' THEN 'skipped_filter' WHEN 'skip_extract' THEN 'skipped_extract' WHEN 'skip_empty' THEN 'skipped_empty'
      WHEN 'skip_hash' THEN 'skipped_unchanged' ELSE 'analyzed' END AS outcome, count(*) AS n FROM routed GROUP BY 1""",
)
def routing_tally(spark: SparkSession, sf: str) -> DataFrame:
    return c.routed(spark, sf).groupBy(single_outcome(F.col("outcome")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "checked_unchanged",
    c.ROUTED_SQL,
    sql="SELECT path, sha256, '2024-01-03 00:00:00' AS checked FROM routed WHERE outcome = 'skip_hash'",
)
def checked_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return checked(c.routed(spark, sf), as_timestamp(AT)).select("path", "sha256", _text("checked_utc").alias("checked"))


@query(
    "changed_or_new",
    c.CORPUS_SQL,
    sql="""SELECT path, corpus.sha256 FROM corpus LEFT JOIN labels ON doc_id = ord WHERE doc_id IS NULL OR toxic = 1""",
)
def changed_or_new(spark: SparkSession, sf: str) -> DataFrame:
    files = c.corpus(spark, sf)
    labels = c.table(spark, sf, "labels")
    known = files.join(labels, F.col("ord") == F.col("doc_id")).select(
        "path", F.when(F.col("toxic") == 1, "").otherwise(F.col("sha256")).alias("sha256")
    )
    raw = files.select("path", F.col("text").cast("binary").alias("content"))
    return scan_incremental(raw, known).select("path", "sha256")


@query(
    "activity_log",
    c.ROUTED_SQL,
    sql="SELECT outcome AS prefix, '[' || outcome || '] ' || path AS line, '2024-01-03' AS day FROM routed",
)
def activity_log(spark: SparkSession, sf: str) -> DataFrame:
    return activity_rows(c.routed(spark, sf), as_timestamp(AT)).select("prefix", "line", F.col("day").cast("string").alias("day"))


@query(
    "skip_log",
    c.SKIPS_SQL,
    sql="""SELECT path, CASE WHEN keyword IS NULL THEN '' ELSE 'sensitive file name (' || keyword || '): ' END
      || reason || ' - `' || path || '`' AS note FROM skips""",
)
def skip_log(spark: SparkSession, sf: str) -> DataFrame:
    return skip_notes(c.skips(spark, sf)).select("path", "note")


_EVALUATED_SQL = (
    c.FILES_SQL
    + r""",
evaluated AS (
  SELECT path, substr(path, 9) AS rel_path, CASE WHEN length NOT BETWEEN 300 AND 20000 THEN 'filtered_out'
    WHEN path LIKE '%.docx' THEN 'extract_skip' WHEN ord % 17 = 0 THEN 'empty_text' WHEN source = 'src3' THEN 'infer_error' ELSE 'ok' END AS status,
    length, length(text) AS chars, * EXCLUDE (path, length)
  FROM files)"""
)


def _evaluate(spark: SparkSession, sf: str) -> DataFrame:
    answers = c.judged(spark, sf).select(
        "path",
        F.struct(F.col("model_tags").alias("tags"), F.col("model_security_level").alias("security_level")).alias("result"),
        "inference_source",
        "inference_reason",
        F.when(F.col("source") == "src3", "timed out").alias("infer_error"),
    )
    return batch_evaluation(c.blanked(c.extracted(spark, sf)).join(answers, "path"), "/corpus", **c.ROUTE)


@query(
    "batch_extraction",
    _EVALUATED_SQL,
    """,
past AS (SELECT path FROM evaluated WHERE status <> 'filtered_out' ORDER BY path LIMIT 1 OFFSET 60)""",
    sql="""SELECT rel_path, CASE WHEN status IN ('infer_error', 'ok') THEN 'extract_ok' ELSE status END AS status,
      CAST(CASE WHEN status IN ('extract_skip', 'empty_text') THEN 0 WHEN status <> 'filtered_out' THEN chars END AS BIGINT) AS extract_chars
      FROM evaluated WHERE path < coalesce((SELECT path FROM past), '~')""",
)
def extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Text extraction alone; the run ends at a number of files, which is what the limit is for."""
    texts = c.blanked(c.extracted(spark, sf))
    found = batch_evaluation(texts, "/corpus", **c.ROUTE, extract_only=True, limit=60)
    return found.select("rel_path", "status", F.col("extract_chars").cast("long").alias("extract_chars"))


@query(
    "batch_evaluation",
    _EVALUATED_SQL,
    sql="""SELECT path, rel_path, status, CASE WHEN status <> 'filtered_out' THEN length END AS file_size_bytes,
      CAST(CASE WHEN status IN ('extract_skip', 'empty_text') THEN 0 WHEN status <> 'filtered_out' THEN chars END AS BIGINT) AS extract_chars,
      CASE status WHEN 'extract_skip' THEN 'unsupported extension: .docx' WHEN 'infer_error' THEN 'timed out' ELSE '' END AS skip_or_error,
      CASE WHEN status = 'ok' THEN lang || ';' || source ELSE '' END AS infer_tags,
      CASE WHEN status = 'ok' THEN model_security_level ELSE '' END AS security_level,
      CASE WHEN status = 'ok' THEN inference_source ELSE '' END AS inference_source,
      CASE WHEN status = 'ok' THEN inference_reason ELSE '' END AS inference_reason,
      CASE WHEN status <> 'ok' THEN '' WHEN inference_source = 'mock' THEN 'true' ELSE 'false' END AS likely_mock,
      CASE status WHEN 'ok' THEN 'true' WHEN 'infer_error' THEN 'false' ELSE '' END AS shape_ok FROM evaluated""",
)
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluate(spark, sf).withColumn("extract_chars", F.col("extract_chars").cast("long"))


@query("batch_evaluation_tally", _EVALUATED_SQL, sql="SELECT status, count(*) AS n FROM evaluated GROUP BY status")
def evaluation_tally(spark: SparkSession, sf: str) -> DataFrame:
    return status_tally(_evaluate(spark, sf))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Raw scorer answers of several shapes, made of the documents."""
    body = F.to_json(
        F.struct(
            F.when(F.col("ord") % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" "), "lang"), "source", F.lit(""))).alias("tags"),
            F.when(F.col("ord") % 11 == 0, "p2").otherwise("P2").alias("security_level"),
            F.when(F.col("ord") % 17 == 0, " ").otherwise(F.col("summary")).alias("summary"),
            F.when(F.col("ord") % 3 == 0, F.array("lang", F.lit(" "))).alias("category_ids"),
        )
    )
    body = F.when(F.col("ord") % 19 == 0, F.regexp_replace(body, r'"tags":\[[^\]]*\]', '"tags":" one "')).otherwise(body)
    raw = (
        F.when(F.col("ord") % 5 == 0, F.concat(F.lit("Here {is}:\n```JSON\n"), body, F.lit("\n```\nthanks }")))
        .when(F.col("ord") % 5 == 1, F.concat(F.lit("Result: "), body, F.lit(" - done")))
        .when(F.col("ord") % 23 == 2, F.lit("no answer"))
        .when(F.col("ord") % 23 == 3, F.lit("{not json}"))
        .otherwise(body)
    )
    return c.corpus(spark, sf).select("*", raw.alias("raw"))


_ANSWERS_SQL = (
    c.CORPUS_SQL
    + """,
answers AS (
  SELECT *, CASE WHEN ord % 5 > 1 AND ord % 23 = 2 THEN 'no_json_object' WHEN ord % 5 > 1 AND ord % 23 = 3 THEN 'bad_json'
    WHEN ord % 7 = 0 AND ord % 19 <> 0 THEN 'tags_empty' WHEN ord % 11 = 0 THEN 'bad_security_level'
    WHEN ord % 17 = 0 THEN 'summary_empty' END AS error,
    CASE WHEN ord % 19 = 0 THEN 'one' ELSE lang || ',' || source END AS good_tags
  FROM corpus)"""
)


@query(
    "parsed_answers",
    _ANSWERS_SQL,
    sql="""SELECT ord, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN good_tags END AS tags,
      CASE WHEN error IS NULL THEN 'P2' END AS level, CASE WHEN error IS NULL THEN summary END AS summary,
      CASE WHEN error IS NULL AND ord % 3 = 0 THEN lang END AS categories FROM answers""",
)
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    check = validate_classification(extract_json("raw"))
    return _answers(spark, sf).withColumn("check", check).select(
        "ord",
        "check.valid",
        "check.error",
        F.array_join("check.result.tags", ",").alias("tags"),
        F.col("check.result.security_level").alias("level"),
        F.col("check.result.summary").alias("summary"),
        F.array_join("check.result.category_ids", ",").alias("categories"),
    )


@query(
    "handling_hints",
    c.CORPUS_SQL,
    sql="""SELECT ord, CASE WHEN ord % 4 <> 3 AND summary <> '' THEN summary END AS note, CASE WHEN ord % 4 <> 3 AND summary <> '' THEN
      CASE WHEN ord % 4 = 0 THEN 'ok_external' ELSE 'internal_only' END END AS sharing FROM corpus""",
)
def handling(spark: SparkSession, sf: str) -> DataFrame:
    share = F.when(F.col("ord") % 4 == 0, "ok_external").when(F.col("ord") % 4 == 1, "public")
    body = F.to_json(F.struct(F.col("summary").alias("handling_note"), share.alias("sharing")))
    raw = F.when(F.col("ord") % 4 == 3, "sorry").otherwise(F.concat(F.lit("ok "), body))
    return c.corpus(spark, sf).select("ord", parse_handling(raw).alias("h")).select(
        "ord", F.col("h.handling_note").alias("note"), F.col("h.sharing").alias("sharing")
    )


def note_scorer(texts: list[str], hints: list[str]) -> list[str]:
    """Stands for a model that writes handling notes."""
    share = lambda t: "redact_before_external" if "@" in t else "ok_external"
    return ['{"handling_note": "%d characters", "sharing": "%s"}' % (len(t), share(t)) for t in texts]


@query(
    "handling_notes",
    c.FILES_SQL,
    sql="""SELECT DISTINCT sha256, security_level, length(text) || ' characters' AS note,
      CASE WHEN contains(text, '@') THEN 'redact_before_external' ELSE 'ok_external' END AS sharing FROM files WHERE security_level IN ('P1', 'P2')""",
)
def handling_notes(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.files(spark, sf).select("sha256", "text", "security_level")
    found = handling_hints(docs, note_scorer, part_chars=10_000_000)
    return found.select("sha256", "security_level", F.col("handling.handling_note").alias("note"), F.col("handling.sharing").alias("sharing"))


def keyword_scorer(texts: list[str], hints: list[str]) -> list[str]:
    """Stands for a model: a level from one word, an answer in a fence, a refusal to answer the first time."""
    out = []
    for text, hint in zip(texts, hints):
        if "\t" in text and "JSON object" not in hint:
            out.append("I cannot")
        else:
            level = "P2" if "@" in text else "P4"
            out.append('```json\n{"tags": ["scored"], "security_level": "%s", "summary": "%d characters"}\n```' % (level, len(text)))
    return out


@query(
    "scored_documents",
    c.CORPUS_SQL,
    sql="""SELECT path, CASE WHEN contains(text, '@') THEN 'P2' ELSE 'P4' END AS level, length(text) || ' characters' AS summary,
      'lm_studio' AS source, CASE WHEN contains(text, chr(9)) THEN 'retry_after_schema_fail' ELSE '' END AS reason, FALSE AS likely_mock FROM corpus""",
)
def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = c.corpus(spark, sf).select("path", "sha256", "text", F.lit("").alias("hint"))
    scored = classify(docs, keyword_scorer, "lm_studio", part_chars=10_000_000)
    flags = quality_flags("inference_source", "result.tags", "result.security_level")
    return scored.select(
        "path",
        F.col("result.security_level").alias("level"),
        F.col("result.summary").alias("summary"),
        F.col("inference_source").alias("source"),
        F.col("inference_reason").alias("reason"),
        flags["likely_mock"].alias("likely_mock"),
    )


@query(
    "fallback_documents",
    c.CORPUS_SQL,
    sql="""SELECT path, 'P4' AS level, 'mock,prototype,fallback' AS tags, 'mock' AS source, TRUE AS likely_mock, TRUE AS shape_ok FROM corpus""",
)
def fallback_documents(spark: SparkSession, sf: str) -> DataFrame:
    scored = classify(c.corpus(spark, sf).select("path", "sha256", "text"))
    flags = quality_flags("inference_source", "result.tags", "result.security_level")
    return scored.select(
        "path",
        F.col("result.security_level").alias("level"),
        F.array_join("result.tags", ",").alias("tags"),
        F.col("inference_source").alias("source"),
        flags["likely_mock"].alias("likely_mock"),
        flags["shape_ok"].alias("shape_ok"),
    )


@query(
    "rule_hits",
    c.FILES_SQL,
    sql=r"""SELECT path, rule_hits, CASE WHEN floor_level = '' THEN model_security_level ELSE least(model_security_level, floor_level) END AS level,
      CASE WHEN floor_level <> '' AND floor_level < model_security_level THEN floor_level END AS floor,
      concat_ws(chr(10), CASE WHEN h_email THEN '{"rule":"email","at_least":"P1","hint":"e-mail address"}' END,
        CASE WHEN h_card THEN '{"rule":"card","at_least":"P1","hint":"card-like number"}' END, CASE WHEN h_ipv4 THEN '{"rule":"ipv4","at_least":"P2","hint":"network address"}' END,
        CASE WHEN h_license THEN '{"rule":"license","at_least":"P3","hint":"license"}' END, CASE WHEN h_question THEN '{"rule":"question","hint":"question"}' END) AS hint FROM files""",
)
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    hit = c.judged(spark, sf).withColumn("f", security_floor("model_security_level", "hits"))
    return hit.select(
        "path",
        F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("rule_hits"),
        F.col("f.level").alias("level"),
        F.col("f.floor").alias("floor"),
        rule_hint_block("hits").alias("hint"),
    )


@query(
    "governed_files",
    c.FILES_SQL,
    sql="""SELECT path, file_id, array_to_string(tags, ',') AS tags, security_level, owner_override, rule_floor, rule_hits FROM files""",
)
def governed_files(spark: SparkSession, sf: str) -> DataFrame:
    return c.files(spark, sf).select(
        "path", "file_id", F.array_join("tags", ",").alias("tags"), "security_level", "owner_override", "rule_floor",
        F.array_join("rule_hits", ",").alias("rule_hits"),
    )


@query(
    "synced_overrides",
    c.FILES_SQL,
    sql="""SELECT path, array_to_string(CASE WHEN owner_tags THEN ['low-quality'] ELSE [lang, source] END, ',') AS tags,
      CASE WHEN owner_level THEN 'P1' ELSE model_security_level END AS security_level, owner_override, owner_override AS updated FROM files""",
)
def synced_overrides(spark: SparkSession, sf: str) -> DataFrame:
    stored = c.judged(spark, sf).select(
        "path",
        "ord",
        "model_tags",
        "model_security_level",
        F.col("model_tags").alias("tags"),
        F.col("model_security_level").alias("security_level"),
        F.lit(None).cast("boolean").alias("owner_override"),
    )
    synced = sync_overrides(stored, c.overrides(spark, sf))
    return synced.select("path", F.array_join("tags", ",").alias("tags"), "security_level", "owner_override", "updated")


_LABEL_SQL = "CASE x WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'German' END"


@query(
    "categories",
    c.FILES_SQL,
    sql=f"""SELECT path, array_to_string(category_ids, ',') AS ids, list_contains(category_ids, 'uncategorized') AS needs_review,
      CASE category_ids[1] WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE category_ids[1] END AS first_label,
      array_to_string(list_concat([CASE WHEN len(list_filter(category_ids, lambda x: x <> 'uncategorized')) > 0
        THEN '[' || array_to_string(list_transform(list_filter(category_ids, lambda x: x <> 'uncategorized'), lambda x: {_LABEL_SQL}), ', ') || ']'
        ELSE '[uncategorized]' END], tags), '|') AS report_tags FROM files""",
)
def categories(spark: SparkSession, sf: str) -> DataFrame:
    return c.files(spark, sf).select(
        "path",
        F.array_join("category_ids", ",").alias("ids"),
        F.col("category_needs_review").alias("needs_review"),
        category_label(F.element_at("category_ids", 1), c.CATALOG).alias("first_label"),
        F.array_join(report_tags("tags", "category_ids", c.CATALOG), "|").alias("report_tags"),
    )


@query(
    "classification_report",
    c.FILES_SQL,
    sql=rf"""SELECT strftime(last_analyzed_utc, '%Y-%m-%d %H:%M:%S') || ' (UTC+00:00)' AS analyzed_at, {c.NAME_SQL} AS file, sha256,
      array_to_string(tags, ', ') AS tags,
      CASE security_level WHEN 'P1' THEN '매우 민감' WHEN 'P2' THEN '민감' WHEN 'P3' THEN '내부' ELSE '일반' END || ' (' || security_level || ')' AS security,
      CASE WHEN inference_source = 'mock' THEN 'mock [no_scorer]'
        WHEN owner_override THEN inference_source || ' [owner' || CASE WHEN inference_reason <> '' THEN '; ' || inference_reason ELSE '' END || ']'
        WHEN inference_reason <> '' THEN inference_source || ' [' || inference_reason || ']' ELSE inference_source END AS inference,
      trim(regexp_replace(replace(summary, '|', '\|'), '\s+', ' ', 'g')) AS summary FROM files""",
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return build_report(c.files(spark, sf))


@query(
    "audit_log",
    c.AUDIT_SQL,
    sql="SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, file, sha256, level, tags, source, note FROM audit",
)
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return c.audit(spark, sf).withColumn("ts", _text("ts"))


@query(
    "last_classification",
    c.FILES_SQL,
    sql=f"""SELECT path, {c.NAME_SQL} AS basename, security_level, sha256, strftime(last_analyzed_utc, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS utc
      FROM files ORDER BY last_analyzed_utc DESC, ord DESC LIMIT 1""",
)
def newest(spark: SparkSession, sf: str) -> DataFrame:
    one = last_classification(c.files(spark, sf))
    keys = ("path", "basename", "security_level", "sha256", "utc")
    return one.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in keys])


@query(
    "hits_by_rule",
    c.FILES_SQL,
    sql="""SELECT unnest(string_split(rule_hits, ',')) AS rule, count(*) AS n FROM files WHERE rule_hits <> '' GROUP BY 1""",
)
def hits_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    hits = c.corpus(spark, sf).select(F.explode(match_rules("text", c.RULES)).alias("h"))
    return hits.groupBy(F.col("h.id").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


_RULE_COUNT = 5_000


@query(
    "rule_table_hits",
    c.CORPUS_SQL,
    f""",
words AS (
  SELECT word, row_number() OVER (ORDER BY md5(word)) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{9,}}')) AS word FROM corpus)
  QUALIFY ord <= {_RULE_COUNT}),
found AS (
  SELECT path, words.ord AS ord, 'w' || words.ord AS id FROM corpus JOIN words ON contains(lower(text), word)
  UNION ALL SELECT path, 0, 'number' FROM corpus WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'))""",
    sql="SELECT path, string_agg(id, ',' ORDER BY ord) AS hits FROM found GROUP BY path",
)
def rule_table_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of rules made of words of the corpus: keywords, patterns with classes or optional
    parts, and one pattern without a literal."""
    files = c.corpus(spark, sf)
    # The number of rules is the feature here; the texts are all of them.
    words = files.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("word")).distinct()
    words = words.orderBy(F.md5("word")).limit(_RULE_COUNT).withColumn("ord", F.row_number().over(Window.orderBy(F.md5("word"))))
    head, tail, fifth = F.substring("word", 1, 4), F.substring("word", 6, 1000), F.substring("word", 5, 1)
    stated = F.when(F.col("ord") % 3 == 1, F.concat(head, F.lit("["), fifth, F.lit("]"), tail)).when(F.col("ord") % 3 == 2, F.concat("word", F.lit("(?:ly)?")))
    rules = words.select(
        "ord", F.concat(F.lit("w"), F.col("ord").cast("string")).alias("id"), stated.alias("pattern"),
        F.when(F.col("ord") % 3 == 0, F.array(F.initcap("word"))).alias("keywords"), F.lit("p2").alias("min_level"), F.lit("").alias("hint"),
    )
    number = spark.createDataFrame([(0, "number", "[0-9]{3}-[0-9]{2}-[0-9]{4}", None, "P1", "")], rules.schema)
    hits = match_rule_table(files.select("path", "text"), rules.unionByName(number))
    return hits.select("path", F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"))


@query(
    "category_table",
    c.CORPUS_SQL,
    """,
stated AS (
  SELECT path, CASE ord % 3 WHEN 0 THEN [ord * 7919 % 60000, ord % 60000, ord * 104729 % 60000, ord % 60000, 59999] WHEN 1 THEN [ord * 613 % 60000]
    ELSE [ord * 31 % 60000] END AS ids, ord % 3 AS kind FROM corpus),
numbered AS (SELECT path, kind, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM stated),
kept AS (
  SELECT path, pos, id FROM numbered WHERE (id >= 50000 AND kind < 2) OR (id < 50000 AND pos = (SELECT min(o.pos) FROM numbered o WHERE o.path = numbered.path AND o.id = numbered.id))),
found AS (
  SELECT path, list(CASE WHEN id >= 50000 THEN 'uncategorized' ELSE 'c' || id END ORDER BY pos) AS ids,
    list(CASE WHEN id >= 50000 THEN 'uncategorized' ELSE 'Category ' || id END ORDER BY pos) AS labels FROM kept GROUP BY path)""",
    sql="""SELECT path, array_to_string(coalesce(ids, ['uncategorized']), ',') AS ids, array_to_string(coalesce(labels, ['uncategorized']), ',') AS labels,
      list_contains(coalesce(ids, ['uncategorized']), 'uncategorized') AS needs_review FROM corpus LEFT JOIN found USING (path)""",
)
def category_table(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog of 50,000 categories; a sixth of the proposals is not in it."""
    catalog = spark.range(50_000).select(F.col("id").alias("ord"), F.concat(F.lit(" c"), "id").alias("id"), F.concat(F.lit("Category "), "id").alias("label"))
    of = lambda n: F.concat(F.lit("c"), (F.col("ord") * n % 60_000).cast("string"))
    kind = F.col("ord") % 3
    files = c.corpus(spark, sf).select(
        "path",
        F.when(kind == 0, F.array(of(7919), of(1), of(104729), of(1), F.lit("c59999"), F.lit(" "))).alias("proposed_ids"),
        F.when(kind == 1, of(613)).alias("proposed_id"),
        F.array(F.col("lang"), of(31)).alias("model_tags"),
    )
    found = resolve_category_table(files, catalog)
    return found.select("path", F.array_join("ids", ",").alias("ids"), F.array_join("labels", ",").alias("labels"), "needs_review")
