"""Queries over the whole corpus: versions, lineage, bundles, threads, search, digest, lint."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sensitive_keyword
from ..functions.text import basename, dirname
from ..functions.times import as_timestamp
from ..operators import digest, lint, search
from ..operators.bundles import bundle_rows, context_bundles
from ..operators.cadence import CadenceRule, cadence_log, evaluate_cadence
from ..operators.deltas import added_lines, apply_hunks, positions, removed_lines, text_deltas
from ..operators.governance import Rule, match_rules
from ..operators.lineage import (
    assign_components,
    by_hash_groups,
    description_lines,
    group_members,
    groups,
    lineage_detail,
    multi_groups,
    singletons,
    summary_counts,
    timeline,
    version_edges,
)
from ..operators.related import related_docs
from ..operators.similarity import SimilaritySettings, first_rows, jaccard_pairs, similarity_features, stem_ratio_udf
from ..operators.text_index import TextIndex
from ..operators.threads import build_threads, folder_files, qualifying_folders, threads_top
from ..operators.versions import adopt_renames, assign_file_ids, files_current, last_changes, peer_changes, recent_changes, self_changes, summary_history
from ..session import checkpoint_dir, cut_lineage, written
from ..sources.lookup import FileLookup
from ..streaming.ingest import IngestSettings, process_batch, stored_files
from ..streaming.refresh import key_node, lineage_labels, refresh, status_counts
from ..streaming.throttle import throttle
from . import corpus as c
from ..schema import FILES, with_columns_of
from .registry import query


def _text(ts: str) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


_TS = "'%Y-%m-%d %H:%M:%S'"

# ---------------------------------------------------------------- versions


@query(
    "current_versions",
    c.VERSIONS_SQL,
    sql=f"""SELECT path, ord, sha256, strftime(last_analyzed_utc, {_TS}) AS analyzed FROM versions
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_analyzed_utc DESC, ord DESC) = 1""",
)
def current_versions(spark: SparkSession, sf: str) -> DataFrame:
    return files_current(c.versions(spark, sf)).select("path", "ord", "sha256", _text("last_analyzed_utc").alias("analyzed"))


@query(
    "version_identity",
    c.VERSIONS_SQL,
    sql="""SELECT path, ord, substr(sha256(path || chr(31) || first_sha || chr(31) || first_us), 1, 32) AS file_id FROM (
      SELECT *, first_value(sha256) OVER w AS first_sha, epoch_us(first_value(last_analyzed_utc) OVER w) AS first_us FROM versions
      WINDOW w AS (PARTITION BY path ORDER BY last_analyzed_utc, ord))""",
)
def version_identity(spark: SparkSession, sf: str) -> DataFrame:
    return assign_file_ids(c.versions(spark, sf)).select("path", "ord", "file_id")


@query(
    "renames",
    c.FILES_SQL,
    """,
moved AS (SELECT files.* FROM files JOIN labels ON doc_id = ord WHERE quality = 0),
vanished AS (
  SELECT sha256, count(*) AS n, min(path) AS old_path, min(file_id) AS file_id FROM moved
  WHERE last_analyzed_utc >= TIMESTAMP '2024-01-01 02:00:00' GROUP BY sha256 HAVING count(*) = 1),
first_new AS (SELECT sha256, arg_min('/moved' || path, ord) AS new_path FROM moved GROUP BY sha256)""",
    sql="SELECT old_path, new_path, file_id FROM first_new JOIN vanished USING (sha256)",
)
def renames(spark: SparkSession, sf: str) -> DataFrame:
    """Poorly rated documents turn up below another folder and are gone from their own."""
    files = c.files(spark, sf)
    moved = c.table(spark, sf, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("ord"))
    new = files.join(moved, "ord", "left_semi").select(F.concat(F.lit("/moved"), "path").alias("path"), "sha256", "ord")
    live = files.join(moved, "ord", "left_anti").select("path").unionByName(new.select("path"))
    return adopt_renames(new, files, live, "2024-01-02 00:00:00", 22).select("old_path", "new_path", "file_id")


def _kind_of_text(line: F.Column) -> F.Column:
    """Change lines with the numbers of a text delta left out: those are not unique (see text_deltas)."""
    return F.when(line.startswith("text: "), "text").otherwise(line)


@query(
    "change_lines",
    c.VERSIONS_SQL,
    sql="""SELECT path, ord, CASE WHEN changed THEN CASE WHEN prev_summary <> summary THEN 'summary' ELSE 'body' END END AS change_kind, change_summary
      FROM changes""",
)
def change_lines(spark: SparkSession, sf: str) -> DataFrame:
    return c.changes(spark, sf).select("path", "ord", "change_kind", _kind_of_text(F.col("change_summary")).alias("change_summary"))


def _similar_files(files: DataFrame, threshold: float) -> DataFrame:
    """``lo, hi, jaccard``: pairs of distinct word sets, named by the first file that has them."""
    told = similarity_features(files).withColumn("words", F.sha2(F.to_json(F.struct("tokens")), 256))
    # Told apart from the stored words; a filter before would take the words of each text a second time.
    told = written(told.select("ord", "tokens", "words", F.monotonically_increasing_id().alias("row"))).filter(F.size("tokens") > 0)
    sets = first_rows(told, "words").select(F.col("row").alias("id"), F.col("tokens").alias("items"))
    pairs = jaccard_pairs(sets, threshold, row="id")
    named = told.groupBy("words").agg(F.min("row").alias("row"), F.min("ord").alias("ord"))
    for side in "ab":
        pairs = pairs.join(named.select(F.col("row").alias(f"{side}_id"), F.col("ord").alias(f"{side}_ord")), f"{side}_id")
    return pairs.select(F.least("a_ord", "b_ord").alias("lo"), F.greatest("a_ord", "b_ord").alias("hi"), "jaccard")


def _steps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Steps to another content, of versions, of lineage peers and of similar files, and all texts."""
    versions = c.versions(spark, sf)
    members = written(c.members(spark, sf).select("path", "ord", "component", "sha256", "summary", "text", "last_analyzed_utc"))
    own = self_changes(versions).select("path", "ord", F.col("prev_sha256").alias("from_hash"), F.col("sha256").alias("to_hash"))
    # The steps are told by contents, so accounts are compared by their hash and not carried along.
    peers = peer_changes(members.withColumn("summary", F.sha2("summary", 256))).select("path", "ord", F.col("peer_sha256").alias("from_hash"), F.col("sha256").alias("to_hash"))
    named = members.select("path", "ord", "sha256")
    near = (
        _similar_files(members, 0.5)
        .join(named.select(F.col("ord").alias("lo"), F.col("sha256").alias("from_hash")), "lo")
        .join(named.select("path", F.col("ord").alias("hi"), F.col("sha256").alias("to_hash")), "hi")
        .select("path", F.col("hi").alias("ord"), "from_hash", "to_hash")
    )
    steps = own.unionByName(peers).unionByName(near).filter(F.col("from_hash") != F.col("to_hash"))
    return written(steps), versions.select("sha256", "text").unionByName(members.select("sha256", "text"))


@query("text_deltas")
def delta_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the lines of each step were taken out and put in."""
    steps, texts = _steps(spark, sf)
    # Lines stay where they are compared.
    told = text_deltas(steps, texts).select(
        "from_hash", "to_hash", F.size("hunks").cast("long").alias("hunks"), added_lines(F.col("hunks")).alias("added"),
        removed_lines(F.col("hunks")).alias("removed"), positions(F.col("hunks")).alias("positions"),
    )
    return steps.join(told, ["from_hash", "to_hash"]).drop("from_hash", "to_hash")


_WORD_SETS_SQL = rf""",
tok AS MATERIALIZED (SELECT ord, n, unnest(tokens) AS t FROM (SELECT min(ord) AS ord, len(tokens) AS n, tokens FROM (
  SELECT ord, {c.TOKENS_SQL} AS tokens FROM corpus) GROUP BY tokens))"""
_LINES_SQL = r"len(regexp_extract_all({}, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+'))"


@query(
    "text_deltas_applied",
    c.MEMBERS_SQL,
    "," + c.VERSIONS_SQL,
    _WORD_SETS_SQL,
    """,
steps AS (
  SELECT path, ord, text, lag(text) OVER w AS old FROM versions WINDOW w AS (PARTITION BY path ORDER BY last_analyzed_utc, ord)
  UNION ALL SELECT path, ord, text, lag(text) OVER w FROM members WINDOW w AS (PARTITION BY group_key ORDER BY last_analyzed_utc, ord)
  UNION ALL SELECT y.path, y.ord, y.text, x.text FROM (
    SELECT least(a.ord, b.ord) AS lo, greatest(a.ord, b.ord) AS hi FROM tok a JOIN tok b ON a.t = b.t AND a.ord < b.ord
    GROUP BY a.ord, b.ord, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5) JOIN members x ON x.ord = lo JOIN members y ON y.ord = hi)""",
    sql=f"""SELECT path, ord, sha256(text) AS made_sha256, {_LINES_SQL.format('old')}::BIGINT AS old_lines, {_LINES_SQL.format('text')}::BIGINT AS new_lines
      FROM steps WHERE old <> text""",
)
def deltas_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Each delta applied to the text it starts from."""
    steps, texts = _steps(spark, sf)
    deltas = written(text_deltas(steps, texts))
    new_lines = F.size("old_lines") + added_lines(F.col("hunks")) - removed_lines(F.col("hunks"))
    made = deltas.select(
        "from_hash", "to_hash", F.sha2(apply_hunks(F.col("old_lines"), F.col("hunks")), 256).alias("made_sha256"),
        F.size("old_lines").cast("long").alias("old_lines"), new_lines.alias("new_lines"),
    )
    return steps.join(made, ["from_hash", "to_hash"]).drop("from_hash", "to_hash")


@query(
    "summary_histories",
    c.TOLD_SQL,
    sql="""SELECT path, string_agg(substr(sha256, 1, 8) || coalesce(change_summary, ''), ';' ORDER BY last_analyzed_utc, ord) AS entries FROM (
      SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_analyzed_utc DESC, ord DESC) <= 4) GROUP BY path""",
)
def summary_histories(spark: SparkSession, sf: str) -> DataFrame:
    entry = lambda e: F.concat(F.substring(e["sha256"], 1, 8), F.coalesce(_kind_of_text(e["change_summary"]), F.lit("")))
    return summary_history(c.told_changes(spark, sf), 4).select(
        "path", F.array_join(F.transform("summary_history", entry), ";").alias("entries")
    )


def _account(texts: list[str], hints: list[str]) -> list[str]:
    """A scorer that tells the number of lines, and the level by it."""
    lines = [text.count("\n") + 1 for text in texts]
    return [json.dumps({"tags": ["turn"], "security_level": f"P{1 + n % 4}", "summary": f"{n} lines"}) for n in lines]


_REPLAYS: dict[tuple[str, str], str] = {}


def _turn_ranges(newest: int) -> list[tuple[int, int]]:
    """Turns 0 to 7 one by one, then 8 to 63, 64 to 511 and so on: every turn up to ``newest``, in few batches."""
    ranges = [(turn, turn) for turn in range(min(newest, 7) + 1)]
    while ranges[-1][1] < newest:
        first = ranges[-1][1] + 1
        ranges.append((first, min(8 * first - 1, newest)))
    return ranges


def _replayed(spark: SparkSession, sf: str) -> str:
    """The turns of all conversations taken in as batches, each followed by a refresh: a turn replaces the
    text of its file. The first turns are batches of their own; what follows comes in batches of several
    versions of a file. Done once per application; three queries look at the result."""
    replay = (spark.sparkContext.applicationId, sf)
    if replay in _REPLAYS:
        return _REPLAYS[replay]
    root = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    turns = c.table(spark, sf, "conversations").filter(F.col("text").isNotNull())
    found = turns.select(
        "turn", F.concat(F.lit("/conv/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"),
        F.timestamp_seconds(F.col("turn") * 1800).alias("modificationTime"), F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 1800).alias("taken_utc"),
    )
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for batch, (first, last) in enumerate(_turn_ranges(turns.agg(F.max("turn")).first()[0] or 0)):
        several = "taken_utc" if last > first else None
        rules = IngestSettings((".md",), scorer=_account, history_entries=4, clock=lambda t=last: start + timedelta(minutes=30 * t), at=several)
        process_batch(found.filter(F.col("turn").between(first, last)).drop("turn"), batch, root, rules)
        refresh(spark, root, batch)
    _REPLAYS[replay] = root
    return root


@query(
    "ingested_history",
    c.VERSIONS_SQL,
    r""",
kept AS (
  SELECT * FROM changes WHERE regexp_matches(text, '\S') AND (changed OR prev_sha256 IS NULL)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_analyzed_utc DESC, ord DESC) <= 4)""",
    sql="""SELECT path, string_agg(substr(sha256, 1, 8) || CASE change_summary WHEN 'text' THEN 'other content' ELSE coalesce(change_summary, '') END, ';'
      ORDER BY last_analyzed_utc, ord) AS entries, arg_max(sha256, ord) AS sha256 FROM kept GROUP BY path""",
)
def ingested_history(spark: SparkSession, sf: str) -> DataFrame:
    """State and history after all turns went through the ingest, batch after batch."""
    entry = lambda e: F.concat(F.substring(e["sha256"], 1, 8), F.coalesce(e["change_summary"], F.lit("")))
    return stored_files(spark, _replayed(spark, sf)).select("path", F.array_join(F.transform("summary_history", entry), ";").alias("entries"), "sha256")


@query(
    "refreshed_lineage",
    c.VERSIONS_SQL,
    r""",
held AS (SELECT DISTINCT path, sha256 FROM versions WHERE regexp_matches(text, '\S')),
links AS MATERIALIZED (SELECT DISTINCT x.path AS u, y.path AS v FROM held x JOIN held y ON x.sha256 = y.sha256),
reach AS (SELECT u AS node, u AS seen FROM links UNION SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen),
label AS (SELECT node AS path, min(seen) AS first_path FROM reach GROUP BY node),
newest AS (SELECT * FROM versions WHERE regexp_matches(text, '\S') QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_analyzed_utc DESC, ord DESC) = 1)""",
    sql="""SELECT path, first_path, count(*) OVER (PARTITION BY first_path) AS size FROM label JOIN newest USING (path)""",
)
def refreshed_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Components of files that ever had a content in common, kept up to date batch by batch."""
    root = _replayed(spark, sf)
    files = stored_files(spark, root).select("path", key_node().alias("node"))
    placed = files.join(lineage_labels(spark, root), "node")
    groups = placed.groupBy("component").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("size"))
    return placed.join(groups, "component").select("path", "first_path", "size")


@query(
    "refreshed_counts",
    c.VERSIONS_SQL,
    r""",
newest AS (SELECT *, 'P' || (1 + len(string_split(text, chr(10))) % 4) AS level FROM versions WHERE regexp_matches(text, '\S')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_analyzed_utc DESC, ord DESC) = 1)""",
    sql="""SELECT 'security_level' AS kind, level AS value, count(*) AS n FROM newest GROUP BY level
      UNION ALL SELECT 'inference_source', 'scorer', count(*) FROM newest""",
)
def refreshed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status_counts(spark, _replayed(spark, sf))


@query(
    "recent_changes",
    c.TOLD_SQL,
    sql=f"""SELECT path, trim(change_summary) AS change_summary, strftime(last_analyzed_utc, {_TS}) AS utc FROM (
      SELECT * FROM changes WHERE change_summary IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_analyzed_utc DESC, ord DESC) = 1)
      ORDER BY last_analyzed_utc DESC, ord LIMIT 20""",
)
def newest_changes(spark: SparkSession, sf: str) -> DataFrame:
    newest = recent_changes(c.changed_files(spark, sf), 20)
    return newest.select("path", _kind_of_text(F.col("change_summary")).alias("change_summary"), _text("utc").alias("utc"))


@query(
    "exact_duplicates",
    c.CORPUS_SQL,
    sql="SELECT sha256, count(*) AS copies, arg_min(path, ord) AS first_path FROM corpus GROUP BY sha256 HAVING count(*) > 1",
)
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return by_hash_groups(c.corpus(spark, sf))


# ---------------------------------------------------------------- lineage


@query(
    "lineage_groups",
    c.MEMBERS_SQL,
    sql=f"""SELECT group_key, size, variants, label_path, CASE WHEN variants = 1 THEN 'same content' ELSE variants || ' content variants' END AS variant_note,
      strftime(last_utc, {_TS}) AS last_utc FROM multi JOIN (SELECT group_key, max(last_analyzed_utc) AS last_utc FROM members GROUP BY 1) USING (group_key)""",
)
def lineage_groups(spark: SparkSession, sf: str) -> DataFrame:
    return multi_groups(c.members(spark, sf)).select(
        "group_key", "size", "variants", "label_path", "variant_note", _text("last_utc").alias("last_utc")
    )


@query(
    "lineage_counts",
    c.MEMBERS_SQL,
    sql="""SELECT CAST(sum(size) AS BIGINT) AS files, count(*) FILTER (size >= 2) AS groups, count(*) FILTER (size = 1) AS singletons FROM sizes""",
)
def lineage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summary_counts(c.members(spark, sf))


@query(
    "lineage_timeline",
    c.MEMBERS_SQL,
    sql="""SELECT path, group_key, row_number() OVER (PARTITION BY group_key ORDER BY last_analyzed_utc, lower(path), path) AS position FROM members""",
)
def lineage_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(c.members(spark, sf)).select("path", "group_key", F.col("position").cast("long").alias("position"))


@query(
    "version_edges",
    c.MEMBERS_SQL,
    sql="""SELECT * FROM (SELECT lag(path) OVER w AS from_path, path AS to_path, lag(sha256) OVER w = sha256 AS same_content FROM members
      WINDOW w AS (PARTITION BY group_key ORDER BY last_analyzed_utc, lower(path), path)) WHERE from_path IS NOT NULL""",
)
def lineage_steps(spark: SparkSession, sf: str) -> DataFrame:
    return version_edges(c.members(spark, sf)).select("from_path", "to_path", "same_content")


@query(
    "lineage_singletons",
    c.MEMBERS_SQL,
    sql="""SELECT path, security_level FROM members WHERE group_key NOT IN (SELECT group_key FROM multi) ORDER BY lower(path), path""",
)
def lineage_singletons(spark: SparkSession, sf: str) -> DataFrame:
    return singletons(c.members(spark, sf))


@query(
    "lineage_map",
    c.MEMBERS_SQL,
    sql=f"""SELECT group_key AS label_key, size, row_number() OVER (PARTITION BY group_key ORDER BY last_analyzed_utc, lower(path), path) AS position,
      basename AS file, substr(sha256, 1, 16) AS sha16, security_level AS security, array_to_string(tags, ', ') AS tags,
      strftime(last_analyzed_utc, {_TS}) AS analyzed FROM members JOIN multi USING (group_key)""",
)
def lineage_map(spark: SparkSession, sf: str) -> DataFrame:
    return lineage_detail(c.members(spark, sf)).select(
        "label_key", "size", F.col("position").cast("long").alias("position"), "file", "sha16", "security", "tags",
        _text("last_analyzed_utc").alias("analyzed"),
    )


@query(
    "group_descriptions",
    c.MEMBERS_SQL,
    sql="""SELECT group_key AS label_key, row_number() OVER (PARTITION BY group_key ORDER BY last_analyzed_utc, lower(path), path) AS position,
      CAST(to_json({'file': basename, 'level': security_level, 'tags': tags, 'about': summary}) AS VARCHAR) AS line
      FROM members JOIN multi USING (group_key)""",
)
def group_lines(spark: SparkSession, sf: str) -> DataFrame:
    return description_lines(c.members(spark, sf)).select("label_key", F.col("position").cast("long").alias("position"), "line")


@query(
    "peer_changes",
    c.MEMBERS_SQL,
    """,
peers AS (
  SELECT path, lag(path) OVER w AS peer_path, lag(sha256) OVER w AS peer_sha, sha256, lag(security_level) OVER w AS old, security_level AS new
  FROM members WINDOW w AS (PARTITION BY group_key ORDER BY last_analyzed_utc, ord))""",
    sql="""SELECT path, peer_path, CASE WHEN peer_path IS NULL THEN NULL WHEN old <> new THEN 'summary: ' || old || ' -> ' || new
      WHEN peer_sha <> sha256 THEN 'text' ELSE 'other bytes, no other lines' END AS line FROM peers""",
)
def peer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The account compared is the level here, so that steps differ in it, in the text, or in neither."""
    members = c.members(spark, sf).withColumn("summary", F.col("security_level"))
    return peer_changes(members).select("path", "peer_path", _kind_of_text(F.col("change_summary")).alias("line"))


_COMPONENTS_SQL = (
    c.CORPUS_SQL
    + rf""",
feats AS MATERIALIZED (
  SELECT path, ord, {c.KEY_SQL} AS group_key, lower(regexp_extract(path, '\.[^.]*$')) AS ext, {c.TOKENS_SQL} AS tokens FROM corpus),
tok AS MATERIALIZED (SELECT ord, ext, len(tokens) AS n, unnest(tokens) AS t FROM feats),
links AS MATERIALIZED (
  SELECT DISTINCT u, v FROM (
    SELECT a.ord AS u, b.ord AS v FROM tok a JOIN tok b ON a.ext = b.ext AND a.t = b.t AND a.ord <> b.ord
    GROUP BY a.ord, b.ord, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5
    UNION ALL SELECT a.ord, b.ord FROM feats a JOIN feats b ON a.group_key = b.group_key AND a.ord <> b.ord)),
reach AS (
  SELECT ord AS node, ord AS seen FROM feats
  UNION SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen),
label AS MATERIALIZED (SELECT node AS ord, min(seen) AS component FROM reach GROUP BY node)"""
)


@query("lineage_by_summary", _COMPONENTS_SQL, sql="SELECT path, label.component AS first_ord FROM feats JOIN label USING (ord)")
def lineage_by_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Copy keys and summary overlap of one half, any number of files; components named by their first file."""
    members = assign_components(c.corpus(spark, sf), "both", SimilaritySettings(0.5, 0.0, 1.0))
    first = members.groupBy("component").agg(F.min("ord").alias("first_ord"))
    return members.join(first, "component").select("path", "first_ord")


# The name ratio of two stems: twice the characters in matching blocks, by both lengths. The longest
# common block (the first of equals) is taken, then the parts before and after it in the same way.
_RATIO_SQL = """,
grid AS MATERIALIZED (
  SELECT a, b, i, j, max(l) AS l FROM (
    SELECT a, b, i, j, unnest(range(1, least(length(a) - i, length(b) - j) + 1)) AS l
    FROM (SELECT a, b, i, unnest(range(0, length(b))) AS j FROM (SELECT a, b, unnest(range(0, length(a))) AS i FROM stem_pairs)))
  WHERE substr(a, i + 1, l) = substr(b, j + 1, l) GROUP BY a, b, i, j),
work(a, b, alo, ahi, blo, bhi, l) AS (
  SELECT a, b, 0::BIGINT, length(a), 0::BIGINT, length(b), 0::BIGINT FROM stem_pairs
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN alo ELSE i + l END, CASE side WHEN 0 THEN i ELSE ahi END,
    CASE side WHEN 0 THEN blo ELSE j + l END, CASE side WHEN 0 THEN j ELSE bhi END, CASE side WHEN 0 THEN l ELSE 0 END
  FROM (
    SELECT w.a, w.b, w.alo, w.ahi, w.blo, w.bhi, g.i, g.j, least(g.l, w.ahi - g.i, w.bhi - g.j) AS l,
      row_number() OVER (PARTITION BY w.a, w.b, w.alo, w.ahi, w.blo, w.bhi ORDER BY least(g.l, w.ahi - g.i, w.bhi - g.j) DESC, g.i, g.j) AS r
    FROM work w JOIN grid g ON g.a = w.a AND g.b = w.b AND g.i >= w.alo AND g.i < w.ahi AND g.j >= w.blo AND g.j < w.bhi
  ), (VALUES (0), (1)) s(side) WHERE r = 1),
ratios AS MATERIALIZED (
  SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(l) / (length(a) + length(b)) END AS ratio FROM work GROUP BY a, b)"""

_STEM_SQL = (
    r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)\.[^.]*$', 1), ' \(1\)$', ''), ' - copy$', ''), '_v2$', ''))"
)


@query(
    "stem_ratios",
    c.CORPUS_SQL,
    f""",
named AS (SELECT ord, {_STEM_SQL} AS stem FROM corpus),
stem_pairs AS (SELECT DISTINCT x.stem AS a, y.stem AS b FROM named x JOIN named y ON y.ord > x.ord AND y.ord <= x.ord + 6)""",
    _RATIO_SQL,
    sql="SELECT a, b, round(ratio, 9) AS ratio FROM ratios",
)
def stem_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Name ratios of files that lie near each other in the corpus."""
    named = similarity_features(c.corpus(spark, sf)).select("ord", F.col("stem"))
    near = named.select(F.col("stem").alias("a"), F.explode(F.sequence(F.col("ord") + 1, F.col("ord") + 6)).alias("ord"))
    pairs = near.join(named.withColumnRenamed("stem", "b"), "ord").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(stem_ratio_udf()("a", "b"), 9).alias("ratio"))


@query(
    "lineage_blended",
    c.CORPUS_SQL,
    rf""",
feats AS MATERIALIZED (
  SELECT path, ord, sha256, last_analyzed_utc, {c.KEY_SQL} AS group_key, lower(regexp_extract(path, '\.[^.]*$')) AS ext, {_STEM_SQL} AS stem,
    {c.TOKENS_SQL} AS tokens FROM corpus),
tok AS MATERIALIZED (SELECT ord, ext, stem, len(tokens) AS n, unnest(tokens) AS t FROM feats),
near AS MATERIALIZED (
  SELECT a.ord AS u, b.ord AS v, any_value(a.stem) AS a, any_value(b.stem) AS b, count(*) / (a.n + b.n - count(*)) AS jac
  FROM tok a JOIN tok b ON a.ext = b.ext AND a.t = b.t AND a.ord < b.ord GROUP BY a.ord, b.ord, a.n, b.n
  HAVING 0.55 + 0.45 * (count(*) / (a.n + b.n - count(*))) >= 0.58),
stem_pairs AS (SELECT DISTINCT a, b FROM near)""",
    _RATIO_SQL,
    """,
one_way AS (SELECT u, v FROM near JOIN ratios USING (a, b) WHERE 0.55 * ratio + 0.45 * jac >= 0.58
  UNION ALL SELECT a.ord, b.ord FROM feats a JOIN feats b ON a.group_key = b.group_key AND a.ord < b.ord),
links AS MATERIALIZED (SELECT u, v FROM one_way UNION SELECT v, u FROM one_way),
reach AS (SELECT ord AS node, ord AS seen FROM feats UNION SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen),
label AS MATERIALIZED (SELECT node AS ord, min(seen) AS component FROM reach GROUP BY node)""",
    sql="""SELECT arg_min(group_key, (last_analyzed_utc, lower(path), path)) AS group_key, count(*) AS size, count(DISTINCT sha256) AS variants,
      arg_min(path, (last_analyzed_utc, lower(path), path)) AS label_path
      FROM feats JOIN label USING (ord) GROUP BY component HAVING count(*) >= 2""",
)
def lineage_blended(spark: SparkSession, sf: str) -> DataFrame:
    """The default blend of name ratio and summary overlap, for corpora of any size."""
    members = assign_components(c.corpus(spark, sf), "both")
    return multi_groups(members).select("group_key", "size", "variants", "label_path")


@query(
    "similar_summaries",
    c.CORPUS_SQL,
    _WORD_SETS_SQL,
    sql="""SELECT least(a.ord, b.ord) AS lo, greatest(a.ord, b.ord) AS hi, count(*) / (a.n + b.n - count(*)) AS jaccard FROM tok a JOIN tok b
      ON a.t = b.t AND a.ord < b.ord GROUP BY a.ord, b.ord, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.4""",
)
def similar_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _similar_files(c.corpus(spark, sf), 0.4)


@query(
    "related_documents",
    c.DOCUMENT_EVENTS_SQL,
    c.bundles_sql(120),
    rf""",
feats AS MATERIALIZED (SELECT path, {c.KEY_SQL} AS group_key, {c.TOKENS_SQL} AS tokens FROM corpus),
tok AS MATERIALIZED (SELECT path, len(tokens) AS n, unnest(tokens) AS t FROM feats),
listed AS (SELECT bundle_id, unnest(list_concat([anchor_path], related_paths)) AS path FROM bundles),
edges AS (
  SELECT a.path AS path, b.path AS peer, count(*) / (a.n + b.n - count(*)) AS jac, 0.0::DOUBLE AS same, 0.0::DOUBLE AS together
  FROM tok a JOIN tok b ON a.t = b.t AND a.path <> b.path GROUP BY a.path, b.path, a.n, b.n HAVING jac >= 0.28
  UNION ALL SELECT a.path, b.path, 0.0, 1.0, 0.0 FROM feats a JOIN feats b ON a.group_key = b.group_key AND a.path <> b.path
  UNION ALL SELECT a.path, b.path, 0.0, 0.0, 0.55 FROM listed a JOIN listed b ON a.bundle_id = b.bundle_id AND a.path <> b.path),
scored AS (SELECT path, peer, greatest(max(same) + max(jac), max(together)) AS score FROM edges GROUP BY path, peer)""",
    sql="""SELECT path, peer, score, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, lower(peer), peer) AS BIGINT) AS rank FROM scored
      QUALIFY rank <= 5""",
)
def related_documents(spark: SparkSession, sf: str) -> DataFrame:
    peers = related_docs(c.corpus(spark, sf), c.document_bundles(spark, sf))
    return peers.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- bundles and threads


@query(
    "context_bundles",
    c.EVENTS_SQL,
    c.bundles_sql(30, 200),
    sql="SELECT bundle_id, anchor_path, anchor_us, array_to_string(related_paths, ',') AS related, ord FROM bundles",
)
def newest_bundles(spark: SparkSession, sf: str) -> DataFrame:
    events = c.user_events(spark, sf)
    return context_bundles(events, events, 30, 200).select(
        "bundle_id", "anchor_path", F.unix_micros("anchor_event_utc").alias("anchor_us"),
        F.array_join("related_paths", ",").alias("related"), "ord",
    )


@query(
    "all_bundles",
    c.EVENTS_SQL,
    c.bundles_sql(30, 10**12),
    sql="SELECT bundle_id, anchor_path, anchor_us, array_to_string(related_paths, ',') AS related, ord FROM bundles",
)
def all_bundles(spark: SparkSession, sf: str) -> DataFrame:
    events = c.user_events(spark, sf)
    return context_bundles(events, events, 30).select(
        "bundle_id", "anchor_path", F.unix_micros("anchor_event_utc").alias("anchor_us"),
        F.array_join("related_paths", ",").alias("related"), "ord",
    )


@query(
    "bundle_rows",
    c.EVENTS_SQL,
    c.bundles_sql(240, 60),
    sql=r"""SELECT bundle_id, regexp_extract(anchor_path, '[^/]*$') AS anchor, CAST(len(related_paths) AS BIGINT) AS related_count,
      array_to_string(list_transform(related_paths[1:6], lambda p: regexp_extract(p, '[^/]*$')), ', ')
        || CASE WHEN len(related_paths) > 6 THEN ', ... (+' || (len(related_paths) - 6) || ' more)' ELSE '' END AS preview FROM bundles""",
)
def bundle_display(spark: SparkSession, sf: str) -> DataFrame:
    events = c.user_events(spark, sf)
    rows = bundle_rows(context_bundles(events, events, 240, 60))
    return rows.select("bundle_id", "anchor", F.col("related_count").cast("long").alias("related_count"), "preview")


_FOLDERS_SQL = """,
mixed AS (SELECT folder, min(ord) AS first_ord FROM members GROUP BY folder HAVING min(group_key) <> max(group_key)),
shared AS (SELECT DISTINCT folder FROM (
  SELECT folder, unnest(list_distinct(list_transform(tags, lambda t: lower(trim(t))))) AS tag, ord FROM members) GROUP BY folder, tag HAVING count(*) >= 2),
shown AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY folder ORDER BY last_analyzed_utc DESC, ord) AS pos FROM members
  JOIN mixed USING (folder) WHERE folder IN (SELECT folder FROM shared) QUALIFY pos <= 12),
listed AS MATERIALIZED (
  SELECT members.*, multi.size, row_number() OVER (PARTITION BY group_key ORDER BY last_analyzed_utc DESC, ord) AS pos
  FROM members JOIN multi USING (group_key)
  WHERE group_key IN (SELECT group_key FROM members WHERE path NOT IN (SELECT path FROM shown)) QUALIFY pos <= 12),
conversations AS (
  SELECT 'conv:' || substr(sha256(lower(folder)), 1, 16) AS id,
    CASE WHEN bool_or(group_key IN (SELECT group_key FROM multi)) THEN 'mixed' ELSE 'conversation' END AS kind,
    regexp_extract(folder, '[^/]*$') AS title, folder, arg_min(path, pos) AS latest_path, max(last_analyzed_utc) AS last_utc,
    count(*) AS member_count, count(*) FILTER (CAST(last_analyzed_utc AS DATE) = DATE '2024-01-01') AS today_n,
    min(security_level) AS max_security, arg_min(coalesce(last_change_summary, summary), pos) AS one_liner, 0 AS k, 0 AS size, first_ord AS f, '' AS gk
  FROM shown GROUP BY folder, first_ord HAVING count(*) >= 2),
threads AS MATERIALIZED (SELECT * FROM (
  SELECT * FROM conversations UNION ALL
  SELECT 'ver:' || substr(group_key, 1, 80), 'version', group_key, NULL, arg_min(path, pos), max(last_analyzed_utc), count(*),
    count(*) FILTER (CAST(last_analyzed_utc AS DATE) = DATE '2024-01-01'), min(security_level), arg_min(coalesce(last_change_summary, summary), pos), 1, size, 0, group_key
  FROM listed GROUP BY group_key, size)
  ORDER BY last_utc DESC, k, size DESC, f, gk LIMIT 40)"""
_THREADS_SQL = c.MEMBERS_SQL + _FOLDERS_SQL


def _threads(spark: SparkSession, sf: str, files: DataFrame | None = None) -> DataFrame:
    """``files``: those of the corpus where they are stored already; their texts are then not judged again."""
    members = c.members(spark, sf) if files is None else assign_components(files, "filename_key")
    return build_threads(c.stored(members), c.ROOTS, "2024-01-01 12:00:00", max_threads=40)


@query(
    "threads",
    _THREADS_SQL,
    sql=f"""SELECT id, kind, title, folder, latest_path, strftime(last_utc, {_TS}) AS last_utc, member_count, today_n, max_security,
      CASE WHEN length(one_liner) > 160 THEN substr(one_liner, 1, 157) || '...' ELSE one_liner END AS one_liner FROM threads""",
)
def newest_threads(spark: SparkSession, sf: str) -> DataFrame:
    return _threads(spark, sf).select(
        "id", "kind", "title", "folder", "latest_path", _text("last_utc").alias("last_utc"),
        F.col("member_count").cast("long").alias("member_count"), F.col("today_n").cast("long").alias("today_n"), "max_security", "one_liner",
    )


@query(
    "all_threads",
    _THREADS_SQL.replace(" LIMIT 40", ""),
    sql=f"SELECT id, kind, title, folder, latest_path, strftime(last_utc, {_TS}) AS last_utc, member_count, today_n, max_security FROM threads",
)
def all_threads(spark: SparkSession, sf: str) -> DataFrame:
    found = build_threads(c.stored(c.members(spark, sf)), c.ROOTS, "2024-01-01 12:00:00")
    return found.select(
        "id", "kind", "title", "folder", "latest_path", _text("last_utc").alias("last_utc"),
        F.col("member_count").cast("long").alias("member_count"), F.col("today_n").cast("long").alias("today_n"), "max_security",
    )


@query(
    "thread_members",
    _THREADS_SQL,
    sql="""SELECT t.id, shown.pos AS pos, path, CASE WHEN pos = 1 THEN 'latest' WHEN group_key IN (SELECT group_key FROM multi) THEN 'version' ELSE 'peer' END AS role
      FROM shown JOIN threads t ON t.k = 0 AND t.folder = shown.folder
      UNION ALL SELECT t.id, pos, path, CASE WHEN pos = 1 THEN 'latest' ELSE 'version' END FROM listed JOIN threads t ON t.k = 1 AND t.gk = listed.group_key""",
)
def thread_members(spark: SparkSession, sf: str) -> DataFrame:
    return _threads(spark, sf).select("id", F.posexplode("members").alias("pos", "m")).select(
        "id", (F.col("pos") + 1).cast("long").alias("pos"), "m.path", "m.role"
    )


@query(
    "threads_top",
    _THREADS_SQL,
    sql="""SELECT id, kind, regexp_extract(latest_path, '[^/]*$') AS latest, latest_path, member_count AS count, today_n, max_security
      FROM threads ORDER BY last_utc DESC, k, size DESC, f, gk LIMIT 8""",
)
def top_threads(spark: SparkSession, sf: str) -> DataFrame:
    top = threads_top(_threads(spark, sf), 8)
    return top.select(
        "id", "kind", "latest", "latest_path", F.col("count").cast("long").alias("count"), F.col("today_n").cast("long").alias("today_n"), "max_security"
    )


@query(
    "folders_by_bundle",
    c.DOCUMENT_EVENTS_SQL,
    c.bundles_sql(120),
    f""",
inside AS (SELECT path, folder, {c.KEY_SQL} AS group_key FROM fs_events),
listed AS (SELECT bundle_id, unnest(list_concat([anchor_path], related_paths)) AS path FROM bundles)""",
    sql="""SELECT DISTINCT folder FROM (SELECT folder, bundle_id FROM listed JOIN inside USING (path) GROUP BY ALL HAVING count(*) >= 2)
      WHERE folder IN (SELECT folder FROM inside GROUP BY folder HAVING count(DISTINCT group_key) >= 2)""",
)
def folders_by_bundle(spark: SparkSession, sf: str) -> DataFrame:
    untagged = assign_components(c.corpus(spark, sf), "filename_key").withColumn("tags", F.array().cast("array<string>"))
    return qualifying_folders(folder_files(untagged, c.ROOTS), c.document_bundles(spark, sf)).select("folder")


@query(
    "find_thread",
    _THREADS_SQL,
    sql="""SELECT t.id, t.kind FROM threads t WHERE (SELECT arg_max(path, (last_analyzed_utc, -ord)) FROM members) IN (
        SELECT path FROM shown WHERE t.k = 0 AND shown.folder = t.folder UNION ALL SELECT path FROM listed WHERE t.k = 1 AND listed.group_key = t.gk)
      ORDER BY last_utc DESC, k, size DESC, f, gk LIMIT 1""",
)
def thread_of_newest(spark: SparkSession, sf: str) -> DataFrame:
    files = c.stored(c.files(spark, sf))
    newest = files.orderBy(*search.newest_first()).select("path").first().path
    return search.thread_of(files, c.stored(_threads(spark, sf, files)), path=newest.upper()).select("id", "kind")


@query(
    "thread_lineage",
    _THREADS_SQL,
    """,
top AS (SELECT * FROM threads ORDER BY last_utc DESC, k, size DESC, f, gk LIMIT 1)""",
    sql="""SELECT top.id AS thread_id, top.kind AS kind, pos - 1 AS position, path, coalesce(last_change_summary, '') AS last_change_summary FROM top JOIN shown ON top.k = 0 AND shown.folder = top.folder
      UNION ALL SELECT top.id, top.kind, pos - 1, path, coalesce(last_change_summary, '') FROM top JOIN listed ON top.k = 1 AND listed.group_key = top.gk""",
)
def thread_lineage(spark: SparkSession, sf: str) -> DataFrame:
    files = c.stored(c.files(spark, sf))
    threads = c.stored(_threads(spark, sf, files))
    newest = threads_top(threads, 1).first().id
    return search.lineage_of(files, search.thread_of(files, threads, thread_id=newest)).select(
        "thread_id", "kind", F.col("position").cast("long").alias("position"), "path", "last_change_summary"
    )


@query(
    "throttled_events",
    """
ev AS MATERIALIZED (SELECT '/u' || user_id || '/' || event_type AS path, epoch_us(ts) AS us, event_id FROM events),
chain(path, us) AS (
  SELECT path, min(us) FROM ev GROUP BY path
  UNION ALL SELECT path, nxt FROM (SELECT chain.path, (SELECT min(ev.us) FROM ev WHERE ev.path = chain.path AND ev.us >= chain.us + 21600000000) AS nxt FROM chain) WHERE nxt IS NOT NULL)""",
    sql="SELECT path, us FROM chain",
)
def throttled_events(spark: SparkSession, sf: str) -> DataFrame:
    events = c.table(spark, sf, "events").select(
        F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").alias("ord"),
    )
    return throttle(events, 6 * 3600, 4 * 86_400).select("path", F.unix_micros("event_ts").alias("us"))


# ---------------------------------------------------------------- search


def _page(df: DataFrame) -> DataFrame:
    return df.select("path", "security_level", F.array_join("tags", ",").alias("tags"), "sha256_prefix", _text("last_analyzed_utc").alias("analyzed"))


_PAGE_SQL = f"path, security_level, array_to_string(tags, ',') AS tags, substr(sha256, 1, 16) AS sha256_prefix, strftime(last_analyzed_utc, {_TS}) AS analyzed"


@query("search_by_level", c.FILES_SQL, sql=f"SELECT {_PAGE_SQL} FROM files WHERE security_level = 'P1' ORDER BY last_analyzed_utc DESC, ord LIMIT 20")
def search_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return _page(search.search(c.files(spark, sf), level="p1", limit=20).results)


@query(
    "search_second_page",
    c.FILES_SQL,
    sql=f"""SELECT {_PAGE_SQL} FROM files WHERE contains(lower(path || chr(10) || summary || chr(10) || array_to_string(tags, ', ') || chr(10)
      || array_to_string(category_ids, ' ')), 'the') ORDER BY last_analyzed_utc DESC, ord LIMIT 15 OFFSET 15""",
)
def search_second_page(spark: SparkSession, sf: str) -> DataFrame:
    return _page(search.search(c.files(spark, sf), query=" THE ", limit=15, cursor=search.encode_cursor(15)).results)


@query(
    "search_by_key",
    c.FILES_SQL,
    sql=f"""SELECT {_PAGE_SQL} FROM files WHERE contains(lower(path || chr(10) || summary || chr(10) || array_to_string(tags, ', ') || chr(10)
      || array_to_string(category_ids, ' ')), 'the') ORDER BY last_analyzed_utc DESC, ord LIMIT 15 OFFSET 15""",
)
def search_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The page behind the first one, from its key on."""
    files = c.files(spark, sf)
    first = search.search_after(files, query=" THE ", limit=15)
    return _page(search.search_after(files, query=" THE ", limit=15, token=first.next_token() or "").results)


@query(
    "pattern_matches",
    c.CORPUS_SQL,
    sql=r"""SELECT ord, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(a)b') THEN 'named' END, CASE WHEN regexp_matches(text, '(?i)[\[a]b') THEN 'bracket' END,
      CASE WHEN regexp_matches(text, '(?i)ab') THEN 'comment' END, CASE WHEN regexp_matches(text, '(?i)[a&]c') THEN 'operator' END,
      CASE WHEN regexp_matches(text, '(?im)^the\b') THEN 'line' END) AS ids FROM corpus""",
)
def pattern_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns that mean something else, or nothing, in Java as they stand; one that is no pattern."""
    stated = {"named": "(?P<x>a)b", "bracket": "[[a]b", "comment": "a(?#note)b", "operator": "[a&&]c", "line": r"^the\b", "none": "(?P<a_b>x)|("}
    rules = [Rule(id=k, pattern=p) for k, p in stated.items()]
    found = F.transform(match_rules("text", rules), lambda h: h["id"])
    return c.corpus(spark, sf).select("ord", F.array_join(found, ",").alias("ids"))


@query(
    "search_by_pattern",
    c.FILES_SQL,
    sql=rf"""SELECT {_PAGE_SQL} FROM files WHERE regexp_matches(path || chr(10) || summary || chr(10) || array_to_string(tags, ', ') || chr(10)
      || array_to_string(category_ids, ' '), '(?i)SRC1\d/[ef].*\.md') ORDER BY last_analyzed_utc DESC, ord LIMIT 100""",
)
def search_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _page(search.search(c.files(spark, sf), query=r"SRC1\d/[ef].*\.md", regex=True, limit=100).results)


@query(
    "search_by_facets",
    c.FILES_SQL,
    sql=f"""SELECT {_PAGE_SQL} FROM files WHERE contains(lower(array_to_string(tags, ', ')), 'src') AND list_contains(category_ids, 'en')
      AND CAST(last_analyzed_utc AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-02' AND path LIKE '/corpus/src1/%' ORDER BY last_analyzed_utc DESC, ord LIMIT 50""",
)
def search_by_facets(spark: SparkSession, sf: str) -> DataFrame:
    page = search.search(
        c.files(spark, sf), tag="SRC", category_id="en", since="2024-01-01T10:00", until="2024-01-02", roots=["/corpus/src1"], limit=50
    )
    return _page(page.results)


@query(
    "search_match_count",
    c.FILES_SQL,
    sql="SELECT count(*) AS n FROM files WHERE contains(lower(path || chr(10) || summary || chr(10) || array_to_string(tags, ', ')), 'an')",
)
def search_match_count(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.matching(c.files(spark, sf), query="an", include_categories=False)
    return hits.agg(F.count(F.lit(1)).alias("n"))


@query(
    "search_corpus",
    c.FILES_SQL,
    sql="""SELECT path, security_level, substr(summary, 1, 160) AS summary FROM files WHERE security_level = 'P4'
      AND contains(lower(path || chr(10) || summary || chr(10) || array_to_string(tags, ', ')), 'en') ORDER BY last_analyzed_utc DESC, ord LIMIT 50""",
)
def plain_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search_corpus(c.files(spark, sf), 50, level="P4", query="EN")
    return hits.select("path", "security_level", F.substring("summary", 1, 160).alias("summary"))


_QUESTIONS = (("text", " The Th"), ("text", "license"), ("text", "src1/EN/n0"), ("text", "no such text"), ("text", "én"), ("pattern", r"SRC1\d/[ef].*\.md"),
              ("pattern", r"licen[cs]e|mit licen"), ("pattern", r"[0-9]{3}-[0-9]{2}"), ("pattern", "warranty.{0,40}kind"))


@query(
    "search_by_index",
    c.FILES_SQL,
    """,
blobs AS (SELECT path, path || chr(10) || CASE WHEN ord % 5 = 0 THEN 'license of old' ELSE summary END || chr(10) || array_to_string(tags, ', ') || chr(10)
  || array_to_string(category_ids, ' ') AS blob FROM files)""",
    sql=" UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS question, path FROM blobs WHERE "
        + (f"contains(lower(blob), '{q.strip().lower()}')" if kind == "text" else f"regexp_matches(blob, '(?i){q}')")
        for i, (kind, q) in enumerate(_QUESTIONS)
    ),
)
def search_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """All questions asked of an index of two segments, then half of them again of the merged one; every
    fifth file has another summary in the second segment."""
    files = c.stored(c.files(spark, sf))
    index = TextIndex(spark, f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    index.create(files, 0)
    index.add(files.filter(F.col("ord") % 5 == 0).withColumn("summary", F.lit("license of old")), 1)
    found = []
    for i, (kind, q) in enumerate(_QUESTIONS):
        if i == len(_QUESTIONS) // 2:
            index.merge(2)
        found.append(index.search(q, regex=kind == "pattern").select(F.lit(i).cast("long").alias("question"), "path"))
    return reduce(DataFrame.unionByName, found)


@query(
    "get_file",
    c.VERSIONS_SQL,
    """,
counted AS (
  SELECT path, arg_max(sha256, (last_analyzed_utc, ord)) AS sha256, count(*) AS n, substr(sha256(path || chr(31) || arg_min(sha256, (last_analyzed_utc, ord)) || chr(31)
    || epoch_us(min(last_analyzed_utc))), 1, 32) AS file_id, arg_max(change_summary, (last_analyzed_utc, ord)) AS line FROM changes GROUP BY path),
asked AS (SELECT * FROM counted ORDER BY n DESC, path LIMIT 1)""",
    sql="""SELECT 'path' AS by, path, file_id, sha256, FALSE AS in_allowlist, least(n, 5) AS history, coalesce(line, '') AS line FROM asked
      UNION ALL SELECT 'file_id', path, file_id, sha256, TRUE, least(n, 5), coalesce(line, '') FROM asked""",
)
def get_file(spark: SparkSession, sf: str) -> DataFrame:
    """The file with most versions: by its path in capitals with a root elsewhere, and by its id."""
    steps = c.changes(spark, sf)
    files = files_current(steps.drop("change_summary")).join(last_changes(steps), "path", "left").join(summary_history(steps), "path")
    files = c.stored(with_columns_of(files, FILES))
    most = steps.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("file_id").alias("id")).orderBy(F.desc("n"), "path").first()
    looked_up = {"path": search.get(files, path=most.path.upper(), roots=["/conv/other"]), "file_id": search.get(files, file_id=most.id, roots=["/conv"])}
    rows = [
        found.select(
            F.lit(by).alias("by"), "path", "file_id", "sha256", "in_allowlist", F.size("summary_history").cast("long").alias("history"),
            _kind_of_text(F.col("last_change_summary")).alias("line"),
        )
        for by, found in looked_up.items()
    ]
    return rows[0].unionByName(rows[1])


@query(
    "looked_up",
    c.FILES_SQL,
    """,
asked AS (SELECT *, row_number() OVER (ORDER BY md5(path)) AS i FROM files QUALIFY i <= 3)""",
    sql="""SELECT 'path' AS by, path, sha256 FROM asked WHERE i = 1 UNION ALL SELECT 'file_id', path, sha256 FROM asked WHERE i = 2
      UNION ALL SELECT * FROM (SELECT 'hash', path, sha256 FROM files WHERE starts_with(sha256, (SELECT substr(sha256, 1, 9) FROM asked WHERE i = 3)) ORDER BY ord LIMIT 20)""",
)
def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Look-ups by path, id and hash prefix in a layout of all files."""
    files = c.stored(c.files(spark, sf))
    lookup = FileLookup(spark, f"{checkpoint_dir(spark)}/lookup-{uuid.uuid4().hex}")
    lookup.write(files)
    one, two, three = files.orderBy(F.md5("path")).select("path", "file_id", "sha256").limit(3).collect()
    by_hash = lookup.by_hash(three.sha256[:9].upper()).select("path").join(files.select("path", "sha256"), "path")
    found = [lookup.locate(path=one.path.upper()), lookup.locate(file_id=two.file_id), by_hash]
    rows = [df.select(F.lit(by).alias("by"), "path", "sha256") for by, df in zip(("path", "file_id", "hash"), found)]
    return reduce(DataFrame.unionByName, rows)


@query(
    "excerpts",
    c.FILES_SQL,
    """,
judgement AS (SELECT path, text, length(text) AS n, CASE WHEN NOT path LIKE '/corpus/src1%' THEN 'path_not_in_allowlist'
  WHEN security_level < 'P3' THEN 'level ' || security_level || ' exceeds maximum' WHEN path LIKE '%.docx' THEN 'unsupported extension: .docx' END AS denied FROM files)""",
    sql="""SELECT path, denied, CASE WHEN denied IS NULL THEN sha256(substr(text, 1, 1200)) END AS excerpt_sha, denied IS NULL AND n > 1200 AS truncated FROM judgement""",
)
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    texts = c.extracted(spark, sf).select("path", "text", "skip_reason")
    roots = [f"/corpus/src{i}" for i in (1, *range(10, 20))]
    shown = search.excerpt(c.files(spark, sf).drop("text"), texts, roots, max_level="P3")
    return shown.select("path", "denied", F.sha2("excerpt", 256).alias("excerpt_sha"), "truncated")


@query(
    "files_by_hash",
    c.FILES_SQL,
    sql=f"""SELECT {_PAGE_SQL} FROM files WHERE starts_with(sha256, (SELECT substr(sha256, 1, 12) FROM (
      SELECT sha256, count(*) AS n FROM files GROUP BY sha256 ORDER BY n DESC, sha256 LIMIT 1))) ORDER BY ord LIMIT 20""",
)
def files_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    files = c.files(spark, sf)
    most = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "sha256").first().sha256
    return _page(search.by_hash(files, most[:12].upper()))


@query(
    "related_to_newest",
    c.DOCUMENT_EVENTS_SQL,
    c.bundles_sql(120),
    rf""",
feats AS MATERIALIZED (SELECT path, ord, {c.KEY_SQL} AS group_key, {c.TOKENS_SQL} AS tokens FROM corpus),
anchor AS (SELECT * FROM feats ORDER BY ord DESC LIMIT 1),
together AS (SELECT DISTINCT unnest(list_concat([anchor_path], related_paths)) AS path FROM bundles, anchor
  WHERE anchor_path = anchor.path OR list_contains(related_paths, anchor.path)),
scored AS (
  SELECT f.path AS peer, len(list_intersect(f.tokens, a.tokens)) / (len(f.tokens) + len(a.tokens) - len(list_intersect(f.tokens, a.tokens))) AS jac,
    CASE WHEN f.group_key = a.group_key THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN jac >= 0.28 THEN jac ELSE 0.0::DOUBLE END AS own,
    CASE WHEN f.path IN (SELECT path FROM together) THEN greatest(own, 0.55::DOUBLE) ELSE own END AS score
  FROM feats f, anchor a WHERE f.path <> a.path)""",
    sql="SELECT peer AS path, score FROM scored WHERE score > 0 ORDER BY score DESC, lower(peer), peer LIMIT 8",
)
def related_to_newest(spark: SparkSession, sf: str) -> DataFrame:
    files = c.files(spark, sf)
    newest = c.corpus(spark, sf).orderBy(F.col("ord").desc()).select("path").first().path
    return search.related(files, newest, c.document_bundles(spark, sf), 8).select("path", "score")


@query(
    "bundles_of_newest",
    c.DOCUMENT_EVENTS_SQL,
    c.bundles_sql(120),
    sql="""SELECT bundle_id, anchor_path FROM bundles, (SELECT related_paths[1] AS p FROM bundles ORDER BY anchor_us DESC, ord DESC LIMIT 1)
      WHERE anchor_path = p OR list_contains(related_paths, p) ORDER BY anchor_us DESC, ord DESC LIMIT 8""",
)
def bundles_of_newest(spark: SparkSession, sf: str) -> DataFrame:
    bundles = c.stored(c.document_bundles(spark, sf))
    newest = bundles.orderBy(F.col("anchor_event_utc").desc(), F.col("ord").desc()).first().related_paths[0]
    return search.bundles_of(bundles, newest.upper()).select("bundle_id", "anchor_path")


# ---------------------------------------------------------------- counts, digest, cadence, lint


@query("level_counts", c.FILES_SQL, sql="SELECT security_level AS level, count(*) AS n FROM files GROUP BY 1")
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return digest.level_counts(c.files(spark, sf))


@query(
    "backend_counts",
    c.FILES_SQL,
    sql="""SELECT security_level AS level, inference_source AS source, count(*) AS n,
      CAST(row_number() OVER (PARTITION BY security_level ORDER BY count(*) DESC, min(ord)) AS BIGINT) AS rank FROM files GROUP BY 1, 2 QUALIFY rank <= 3""",
)
def backend_counts(spark: SparkSession, sf: str) -> DataFrame:
    return digest.backend_counts(c.files(spark, sf), 3).withColumn("rank", F.col("rank").cast("long"))


@query(
    "category_counts",
    c.FILES_SQL,
    sql="SELECT category_id, count(*) AS n FROM (SELECT unnest(category_ids) AS category_id FROM files) GROUP BY 1",
)
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return digest.category_counts(c.files(spark, sf))


@query(
    "status_tables",
    c.AUDIT_SQL,
    c.SKIPS_SQL.replace(c.CORPUS_SQL, ""),
    sql="""SELECT 'levels' AS part, security_level AS name, count(*) AS n FROM files GROUP BY security_level
      UNION ALL SELECT 'categories', category_id, count(*) FROM (SELECT unnest(category_ids) AS category_id FROM files) GROUP BY category_id
      UNION ALL SELECT 'sensitive_skips', path, 1 FROM (SELECT path FROM skips WHERE keyword IS NOT NULL ORDER BY path DESC LIMIT 8)
      UNION ALL SELECT 'counters', 'tracked_files', count(*) FROM files""",
)
def status_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables = digest.status(c.files(spark, sf), c.skips(spark, sf), c.audit(spark, sf), "2024-01-01 12:00:00")
    rows = lambda part, name, n: tables[part].select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"))
    shown = [
        rows("levels", F.col("level"), F.col("n")),
        rows("categories", F.col("category_id"), F.col("n")),
        rows("sensitive_skips", F.col("path"), F.lit(1)),
        rows("counters", F.lit("tracked_files"), F.col("tracked_files")),
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


@query("skip_counts", c.SKIPS_SQL, sql="SELECT reason, count(*) AS n, count(keyword) AS sensitive FROM skips GROUP BY reason")
def skip_counts(spark: SparkSession, sf: str) -> DataFrame:
    return digest.skip_counts(c.skips(spark, sf))


@query(
    "sensitive_skips",
    c.SKIPS_SQL,
    sql="SELECT path, keyword FROM skips WHERE keyword IS NOT NULL ORDER BY path DESC",
)
def sensitive_skips(spark: SparkSession, sf: str) -> DataFrame:
    return digest.recent_sensitive_skips(c.skips(spark, sf)).select("path", "keyword")


@query(
    "sensitive_names",
    c.CORPUS_SQL,
    sql="""SELECT path, CASE WHEN contains(n, '여권') THEN '여권' WHEN contains(n, 'n1') THEN 'N1' WHEN contains(n, 'copy') THEN 'copy' END AS keyword
      FROM (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS n FROM corpus)""",
)
def sensitive_names(spark: SparkSession, sf: str) -> DataFrame:
    return c.corpus(spark, sf).select("path", sensitive_keyword("path", ["여권", "N1", "copy"]).alias("keyword"))


@query(
    "sharing_counts",
    c.AUDIT_SQL,
    sql=r"SELECT regexp_extract(note, '\[sharing: ([a-z_]+)\]', 1) AS sharing, count(*) AS n FROM audit GROUP BY 1",
)
def sharing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return digest.sharing_counts(c.audit(spark, sf))


_METRICS_SQL = c.AUDIT_SQL + c.SKIPS_SQL.replace(c.CORPUS_SQL, "") + """,
metrics AS (
  SELECT count(*) AS tracked_files, count(*) FILTER (security_level = 'P1') AS p1, count(*) FILTER (security_level = 'P2') AS p2,
    count(*) FILTER (CAST(last_analyzed_utc AS DATE) = DATE '2024-01-01') AS today_classified,
    count(*) FILTER (NOT owner_override AND security_level <> model_security_level) AS mismatch, count(*) FILTER (ord % 4 <> 0) AS with_related,
    (SELECT count(*) FROM skips) AS skip_extract, (SELECT count(keyword) FROM skips) AS skip_sensitive,
    (SELECT count(*) FROM audit WHERE contains(note, '[sharing: redact')) AS redact,
    (SELECT count(*) FROM audit WHERE contains(note, '[sharing: internal_only')) AS internal_only
  FROM files)"""

_AS_OF = "2024-01-01 23:00:00"
_CADENCE = (
    CadenceRule("weekly_n", "n*_v2.md", "Weekly notes"),
    CadenceRule("monthly_docx", r"\.docx$", "", "monthly", "src1/"),
    CadenceRule("brackets", "n[0-4]?*.TXT", "Bracketed", "weekly"),
    CadenceRule("invalid", "(1", "Invalid pattern", "weekly"),
    CadenceRule("late", "*", "Late", "weekly", "/elsewhere/"),
    CadenceRule("never", "zzz*", "Never", "monthly"),
)


_CADENCE_SQL = (
    c.CORPUS_SQL
    + rf""",
named AS (SELECT *, {c.NAME_SQL} AS name, date_trunc('week', last_analyzed_utc) = DATE '2024-01-01' AS week,
  date_trunc('month', last_analyzed_utc) = DATE '2024-01-01' AS month FROM corpus),
found AS (
  SELECT 0 AS ord, 'weekly_n' AS id, arg_max(path, (last_analyzed_utc, -ord)) FILTER (week AND regexp_full_match(name, 'n.*_v2\.md')) AS latest FROM named
  UNION ALL SELECT 1, 'monthly_docx', arg_max(path, (last_analyzed_utc, -ord)) FILTER (month AND name LIKE '%.docx' AND contains(path, 'src1/')) FROM named
  UNION ALL SELECT 2, 'brackets', arg_max(path, (last_analyzed_utc, -ord)) FILTER (week AND regexp_full_match(name, 'n[0-4]..*\.txt')) FROM named
  UNION ALL SELECT 3, 'invalid', arg_max(path, (last_analyzed_utc, -ord)) FILTER (week AND contains(name, '(1')) FROM named
  UNION ALL SELECT 4, 'late', arg_max(path, (last_analyzed_utc, -ord)) FILTER (week AND contains(path, '/elsewhere/')) FROM named
  UNION ALL SELECT 5, 'never', arg_max(path, (last_analyzed_utc, -ord)) FILTER (month AND starts_with(name, 'zzz')) FROM named),
misses AS (SELECT ord, label || ': not found (pattern=' || pattern || ')' AS message FROM found JOIN (VALUES
  (0, 'Weekly notes', 'n*_v2.md'), (1, 'monthly_docx', '\.docx$'), (2, 'Bracketed', 'n[0-4]?*.TXT'), (3, 'Invalid pattern', '(1'), (4, 'Late', '*'),
  (5, 'Never', 'zzz*')) r(ord, label, pattern) USING (ord) WHERE latest IS NULL)"""
)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    files = c.stored(c.files(spark, sf))
    return digest.metrics_row(digest.metrics(files, c.skips(spark, sf), c.audit_of(files), _AS_OF))


@query("digest_metrics", _METRICS_SQL, sql="SELECT * FROM metrics")
def digest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


_ACTIONS_SQL = """,
lines AS (
  SELECT 1 AS p, 'sensitive' AS code, 'sensitive files: 매우 민감 (P1) ' || p1 || ', 민감 (P2) ' || p2 AS message FROM metrics WHERE p1 > 0 OR p2 > 0
  UNION ALL SELECT 2, 'redact', 'check before external sharing: ' || redact FROM metrics WHERE redact > 0
  UNION ALL SELECT 3, 'internal_only', 'internal use advised: ' || internal_only FROM metrics WHERE internal_only > 0
  UNION ALL SELECT 4, 'mismatch', 'level differs from the model: ' || mismatch FROM metrics WHERE mismatch > 0
  UNION ALL SELECT 5, 'skip_sensitive', 'unclassified with a sensitive name: ' || skip_sensitive FROM metrics WHERE skip_sensitive > 0
  UNION ALL SELECT 5, 'skip', 'unclassified: ' || skip_extract FROM metrics WHERE skip_sensitive = 0 AND skip_extract > 0
  UNION ALL SELECT 6, 'related', 'files with related candidates: ' || with_related FROM metrics WHERE with_related > 0
  UNION ALL SELECT 100 + ord, 'cadence', 'periodic document missing: ' || message FROM misses)"""
_CADENCE_PART = _CADENCE_SQL.replace(c.CORPUS_SQL, "")


@query("action_lines", _METRICS_SQL, _CADENCE_PART, _ACTIONS_SQL, sql="SELECT CAST(p AS BIGINT) AS priority, code, message FROM lines ORDER BY p LIMIT 8")
def action_lines(spark: SparkSession, sf: str) -> DataFrame:
    cadence = evaluate_cadence(c.corpus(spark, sf), _CADENCE, _AS_OF)
    return digest.action_lines(_metrics(spark, sf), cadence, 8).withColumn("priority", F.col("priority").cast("long"))


@query(
    "digest_payload",
    _METRICS_SQL,
    _CADENCE_PART,
    _ACTIONS_SQL,
    _THREADS_SQL.replace(c.FILES_SQL, ""),
    sql="""SELECT today_classified, p1, p2, tracked_files, skip_extract, skip_sensitive,
      CASE WHEN skip_extract = 0 THEN '' ELSE 'unclassified (no text extracted): ' || skip_extract ||
        CASE WHEN skip_sensitive > 0 THEN ', of which sensitive file names: ' || skip_sensitive ELSE '' END END AS blind_spot,
      (SELECT arg_max(inference_source, last_analyzed_utc) FROM files) AS last_inference_backend,
      (SELECT string_agg(message, ';' ORDER BY p) FROM (SELECT * FROM lines ORDER BY p LIMIT 4)) AS actions,
      (SELECT string_agg(message, ';' ORDER BY ord) FROM misses) AS cadence_misses,
      (SELECT string_agg(title || ' ' || member_count || ' ' || today_n, ';' ORDER BY last_utc DESC, k, size DESC, f, gk) FROM (
        SELECT * FROM threads ORDER BY last_utc DESC, k, size DESC, f, gk LIMIT 3)) AS threads FROM metrics""",
)
def digest_payload(spark: SparkSession, sf: str) -> DataFrame:
    files = c.stored(c.files(spark, sf))
    payload = digest.digest_payload(files, c.skips(spark, sf), c.audit_of(files), _AS_OF, _CADENCE, c.stored(_threads(spark, sf, files)))
    thread = lambda t: F.concat_ws(" ", *[F.get_json_object(t, f"$.{k}") for k in ("title", "count", "today_n")])
    return payload.select(
        "today_classified", "p1", "p2", "tracked_files", "skip_extract", "skip_sensitive", "blind_spot", "last_inference_backend",
        F.array_join("actions", ";").alias("actions"), F.array_join("cadence_misses", ";").alias("cadence_misses"),
        F.array_join(F.transform("threads_top", thread), ";").alias("threads"),
    )


@query(
    "last_inference",
    c.FILES_SQL,
    sql=f"SELECT arg_max(inference_source, last_analyzed_utc) AS source, strftime(max(last_analyzed_utc), {_TS}) AS utc FROM files",
)
def last_inference(spark: SparkSession, sf: str) -> DataFrame:
    return digest.last_inference(c.files(spark, sf)).select(
        F.col("last_inference_backend").alias("source"), _text("last_inference_utc").alias("utc")
    )


@query(
    "cadence",
    _CADENCE_SQL,
    sql="SELECT CAST(ord AS BIGINT) AS ord, id, CASE WHEN latest IS NULL THEN 'miss' ELSE 'ok' END AS status, coalesce(latest, '') AS latest_path FROM found",
)
def cadence(spark: SparkSession, sf: str) -> DataFrame:
    results = evaluate_cadence(c.files(spark, sf), _CADENCE, _AS_OF)
    return results.select(F.col("ord").cast("long").alias("ord"), "id", "status", "latest_path")


@query(
    "cadence_log",
    _CADENCE_SQL,
    sql="SELECT id AS rule_id, '2024-01-01' AS day FROM found WHERE latest IS NULL AND id <> 'late'",
)
def missed(spark: SparkSession, sf: str) -> DataFrame:
    files = c.files(spark, sf)
    results = evaluate_cadence(files, _CADENCE, _AS_OF)
    logged = results.filter(F.col("id") == "late").select(F.col("id").alias("rule_id"), F.to_date(as_timestamp(_AS_OF)).alias("day"))
    return cadence_log(results, logged, _AS_OF).select("rule_id", F.col("day").cast("string").alias("day"))


_LINT_SQL = (
    c.AUDIT_SQL
    + f""",
damaged AS (
  SELECT path, ord, {c.NAME_SQL} AS name, CASE WHEN lang = 'de' AND owner_override THEN ' ' ELSE summary END AS summary,
    CASE WHEN source = 'src2' AND owner_override THEN substr(sha256, 1, 40) ELSE sha256 END AS sha256, security_level, model_security_level,
    owner_override, CASE WHEN lang = 'fr' THEN '' ELSE rule_floor END AS rule_floor FROM files),
findings AS (
  SELECT 'empty_summary' AS code, path, name AS message FROM damaged WHERE trim(summary) = ''
  UNION ALL SELECT 'level_mismatch', path, 'model=' || model_security_level || ' effective=' || security_level || ': ' || name FROM damaged
    WHERE security_level <> model_security_level AND NOT owner_override AND rule_floor = ''
  UNION ALL SELECT 'bad_sha', path, name || ' sha256 length=' || length(sha256) FROM damaged WHERE length(sha256) <> 64)"""
)


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    override = F.col("owner_override")
    return (
        c.files(spark, sf)
        .withColumn("summary", F.when((F.col("lang") == "de") & override, " ").otherwise(F.col("summary")))
        .withColumn("sha256", F.when((F.col("source") == "src2") & override, F.substring("sha256", 1, 40)).otherwise(F.col("sha256")))
        .withColumn("rule_floor", F.when(F.col("lang") == "fr", "").otherwise(F.col("rule_floor")))
    )


@query(
    "governance_lint",
    _LINT_SQL,
    sql="""SELECT * FROM findings UNION ALL SELECT 'audit_gap', path, security_level || ' not in audit log: ' || name FROM damaged
      WHERE security_level IN ('P1', 'P2') AND NOT EXISTS (SELECT 1 FROM audit WHERE contains(audit.file || ' ' || audit.note, damaged.name))""",
)
def governance_lint(spark: SparkSession, sf: str) -> DataFrame:
    return lint.governance_lint(c.stored(_damaged(spark, sf)), c.stored(c.audit(spark, sf)), match="substring")


@query(
    "audit_gaps_by_name",
    _LINT_SQL,
    sql="""SELECT 'audit_gap' AS code, path, security_level || ' not in audit log: ' || name AS message FROM damaged
      WHERE security_level IN ('P1', 'P2') AND name NOT IN (SELECT file FROM audit)""",
)
def audit_gaps_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return lint.audit_gaps(c.files(spark, sf), c.audit(spark, sf), match="basename")


@query(
    "bundle_orphans",
    c.EVENTS_SQL,
    c.bundles_sql(30, 200),
    sql="""SELECT 'bundle_orphan' AS code, anchor_path AS path, regexp_extract(anchor_path, '[^/]*$') AS message FROM bundles
      WHERE anchor_path NOT IN (SELECT '/u' || user_id || '/click-' || (event_id % 3) || '.log' FROM events)""",
)
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    events = c.user_events(spark, sf)
    tracked = c.table(spark, sf, "events").select(
        F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/click-"), (F.col("event_id") % 3).cast("string"), F.lit(".log")).alias("path")
    )
    return lint.bundle_orphans(tracked, context_bundles(events, events, 30, 200))
