"""The registered queries of the operators, with the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontamination, line_runs, mixing, near_dedup, quality, repeats, revisits, secret_scan, spelling, surrogates, word_pieces
from .common import store, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def query(fn: Query, sql: str | None = None) -> Query:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


# The rank file of a public byte-level vocabulary; any other of that form will do.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(ranks, "rb") as lines:
        return word_pieces.add_counts(docs, word_pieces.byte_ranks(lines)).drop("text")


query(op1_token_counts)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), near_dedup.NearDup(shingle=3, percent=85))


query(
    op2_near_dedup,
    rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM sets GROUP BY doc_id
), both_ways AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS c FROM documents
  UNION SELECT b, c FROM reach JOIN both_ways ON node = a WHERE c < b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id, n
""",
)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, count_as="n_entities")


query(op3_surrogates)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


query(
    op4_mixing,
    rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS s,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source
), sums AS (
  SELECT *, sum(w) OVER () AS all_w, sum(s) OVER () * 150 / 100.0::DOUBLE AS budget,
         coalesce(sum(2 * s) OVER (ORDER BY 2.0 * s / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS c,
         coalesce(sum(w) OVER (ORDER BY 2.0 * s / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w_full
  FROM per_source
), levels AS (
  -- with the sources up to this one at their limit; the level is the one whose sources fit
  SELECT (budget - c) / nullif(all_w - w_full, 0) AS level, 2.0 * s / w AS ratio FROM sums
  UNION ALL SELECT any_value(budget) / any_value(all_w), -1 FROM sums
), level AS (SELECT max(level) AS level FROM levels WHERE level >= ratio
), targets AS (
  SELECT source, s, CASE WHEN 2 * s < level * w THEN (2 * s)::DOUBLE ELSE level * w END AS target FROM per_source, level
), rated AS (
  SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, s AS source_size, target::DOUBLE AS target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
""",
)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "n_equal", "text")


query(
    op5_chat,
    r"""
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM clean
), prefixes AS (
  SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS length,
         list([role, text]) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turns FROM placed
), ends AS (
  SELECT min(conv_id) AS conv_id, n, turns, count(*)::BIGINT AS n_equal FROM prefixes WHERE n = length GROUP BY n, turns
), kept AS (
  SELECT * FROM ends WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.n = ends.n AND p.n < p.length AND p.turns = ends.turns)
)
SELECT p.conv_id, ((p.n - 1) // 1024)::BIGINT AS part, kept.n AS n_turns, n_equal,
       string_agg('<|im_start|>' || regexp_replace(regexp_replace(role, '<\|(im_start|im_end)\|>', '< || >', 'g'), '[\r\n]+', ' ', 'g') || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '< || >', 'g') || '<|im_end|>' || chr(10), '' ORDER BY p.n) AS text
FROM kept JOIN placed p ON p.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY p.conv_id, part, kept.n, n_equal
""",
)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


query(op6_repeats)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = store(docs.select("doc_id", "source", quality.measures(docs["text"]).alias("m")).select("doc_id", "source", "m.*"))
    return quality.judge(measured).select("doc_id", *quality.MEASURES, "base_failed", "kept")


query(
    op7_quality,
    rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), grams AS (
  SELECT doc_id, i, list_slice(words, i, i + 2) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), again AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split
), dups AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN dups ON s.doc_id = dups.doc_id LEFT JOIN again ON s.doc_id = again.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), flags AS (
  SELECT *, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 5 * n_words AS dup_lines,
         word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length FROM judged
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f
  FROM (SELECT source, unnest(['base', 'symbols', 'dup_lines', 'word_length']) AS rule, unnest([base_failed, symbols, dup_lines, word_length]) AS failed FROM flags)
  GROUP BY source, rule
), means AS (SELECT rule, count(*) AS k, sum(n) AS total, sum(n * n) AS squares, sum(f) / sum(n) AS m FROM hosts GROUP BY rule
), spread AS (
  SELECT rule, k, m, (sum(n * (f / n - m) * (f / n - m)) / nullif(k - 1, 0)) AS msb, sum(n * (f / n) * (1 - f / n)) / nullif(total - k, 0) AS msw,
         (total - squares / total) / nullif(k - 1, 0) AS n0
  FROM hosts JOIN means USING (rule) GROUP BY rule, k, m, total, squares
), prior AS (
  SELECT rule, m, CASE WHEN msb > msw THEN 1 / ((msb - msw) / (msb + (n0 - 1) * msw)) - 1 END AS weight FROM spread
), verdicts AS (
  SELECT source, bool_or(CASE WHEN weight IS NULL THEN m ELSE (f + m * weight) / (n + weight) END > 0.7) AS rejected
  FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM flags JOIN verdicts ON flags.source IS NOT DISTINCT FROM verdicts.source
""",
)


def archive_records(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl that got each page in full and asked again 64 pages later."""
    tag, day = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.date_add(F.lit("2024-01-01"), F.pmod(F.length("html"), F.lit(300)))
    stored = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"),
        F.lit("ETag"), tag, F.lit("Date"), F.concat(F.lit("day "), F.col("page_id").cast("string")),
    )
    update = F.create_map(F.lit("date"), F.concat(F.lit("day "), (F.col("page_id") + 64).cast("string")), F.lit("Content-Length"), F.lit("0"), F.lit("etag"), tag)
    full = pages.select(
        F.concat(F.lit("full-"), "page_id").alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"),
        tag.alias("etag"), day.cast("string").alias("last_modified"), stored.alias("headers"), F.col("html").alias("payload"),
    )
    again = pages.select(
        F.concat(F.lit("again-"), "page_id").alias("record_id"), "url", ((F.col("page_id") + 64) * 10 + 5).alias("ts"), F.lit(304).alias("status"),
        F.concat(F.lit("W/"), tag).alias("etag"), day.cast("string").alias("last_modified"), update.alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(archive_records(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_lines(F.col("headers")))


query(
    op8_revisits,
    r"""
WITH bare AS (
  SELECT page_id, html, md5(html) AS tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), parts AS (
  SELECT page_id, html, tag, regexp_replace(regexp_replace(lower(regexp_extract(split_part(u, '?', 1), '^([^/]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(split_part(u, '?', 1), '^[^/]*(.*)$', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS q
  FROM bare
), keyed AS (
  SELECT page_id, html, tag, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM parts
), again AS (SELECT *, (page_id + 64) * 10 + 5 AS ts FROM keyed
), answers AS (SELECT *, page_id * 10 AS ts FROM keyed
), met AS (
  SELECT a.page_id, a.url_key, a.ts, f.page_id AS of_page, f.html AS body, a.tag AS asked, f.tag AS had
  FROM again a ASOF LEFT JOIN answers f ON a.url_key = f.url_key AND a.ts > f.ts
)
SELECT 'again-' || page_id AS record_id, url_key, ts,
       CASE WHEN of_page IS NULL THEN 'no_response' WHEN asked = had THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
       'full-' || of_page AS refers_to,
       CASE WHEN asked = had THEN 'content-length: ' || strlen(body) || chr(10) || 'content-type: text/html' ELSE 'content-length: 0' END
         || chr(10) || 'date: day ' || (page_id + 64) || chr(10) || 'etag: "' || asked || '"' AS headers,
       CASE WHEN asked = had THEN sha256(body) END AS payload_sha256, CASE WHEN asked = had THEN strlen(body)::BIGINT END AS payload_bytes
FROM met
""",
)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger, versions = secret_scan.update_ledger(docs)
    found = secret_scan.findings_of(versions, ledger)
    of_kind = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select(
        F.col("key").alias("doc_id"),
        *counts,
        F.sha2(secret_scan.joined(of_kind(*secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        secret_scan.joined(F.col("findings")).alias("spans"),
    )


def _in_sql(rule: secret_scan.Rule) -> str:
    """The pattern with ASCII letters of its first group in either case, as a SQL text."""
    head, bar, tail = rule.pattern.partition(")")
    if rule.any_case:
        head = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head)
    return (head + bar + tail).replace("'", "''")


def _spans_sql(rank: int, rule: secret_scan.Rule) -> str:
    pattern = _in_sql(rule)
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, s AS s, s + len(found[i]) AS e, found[i] AS hit FROM (
    SELECT doc_id, found, i, (list_sum(list_transform(rest[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s
    FROM (SELECT doc_id, found, rest, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS rest FROM documents WHERE text IS NOT NULL
    )))"""


query(
    op9_secrets,
    "WITH hits AS ("
    + "\n  UNION ALL".join(_spans_sql(i, r) for i, r in enumerate(secret_scan.RULES))
    + r"""
), good AS (
  SELECT *, kind || ':' || s || ':' || e AS label FROM hits
  WHERE CASE kind WHEN 'assign' THEN len(regexp_extract(hit, '"""
    + _in_sql(secret_scan.RULES[0])
    + r"""', 2)) >= 6
             WHEN 'access' THEN len(hit) >= 20 ELSE true END
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(label, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(label, ',' ORDER BY s, rank), '') AS spans
FROM documents d LEFT JOIN good ON d.doc_id = good.doc_id GROUP BY d.doc_id
""",
)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    matched = decontamination.match_items(docs.select("doc_id", "text"), benchmark)
    match = F.col("match")
    ids = F.array_join(F.array_sort(match["items"]), ",")
    return matched.select(
        "doc_id",
        match["n_words"].alias("n_words"),
        decontamination.n_hit(match).alias("n_hit"),
        F.size(match["items"]).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        decontamination.contaminated(match).alias("contaminated"),
    )


query(
    op10_decontamination,
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(13, len(w)) AS width FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS win
  FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM b)
), dw AS (
  SELECT doc_id, i, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM bw))
), hits AS (
  SELECT DISTINCT doc_id, i, dw.width, item_id FROM dw JOIN bw ON dw.width = bw.width AND dw.win = bw.win
), covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_runs.drop_shared_lines(docs, least_chars=40, least_docs=5)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


query(
    op13_line_dedup,
    r"""
WITH lines AS (
  SELECT rid, doc_id, line, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(s) AS line, unnest(range(len(s))) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), shared AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT lines.*, shared.k IS NOT NULL AND doc_id IS DISTINCT FROM owner AS gone FROM lines LEFT JOIN shared ON lines.k = shared.k)
GROUP BY rid
""",
)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


query(
    op11_collocations,
    r"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM split)
), totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang
), starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), spans AS (
  SELECT lang, list_slice(w, i, i + k - 1) AS p FROM (SELECT lang, w, i, unnest(range(1, 6)) AS k FROM starts) WHERE i + k - 1 <= len(w)
), freq AS (SELECT lang, p, count(*)::HUGEINT AS a FROM spans GROUP BY lang, p HAVING count(*) >= 100
), cuts AS (
  SELECT lang, p, a, k, list_slice(p, 1, k) AS head, list_slice(p, k + 1, len(p)) AS tail
  FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM freq WHERE len(p) > 1)
), scored AS (
  SELECT c.lang, c.p, c.a, x.a AS l, y.a AS r, n, (1000 * c.a * n) // (x.a * y.a) AS score, k
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.p = head JOIN freq y ON y.lang = c.lang AND y.p = tail JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_spans AS (
  SELECT lang, a, list_slice(p, i, i + k - 1) AS p
  FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS k FROM freq WHERE len(p) > 2))
), covered AS (SELECT lang, p, max(a) AS most FROM inner_spans GROUP BY lang, p
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, array_to_string(w.p, ' ')) AS rank, array_to_string(w.p, ' ') AS phrase,
       w.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest w LEFT JOIN covered c ON c.lang = w.lang AND c.p = w.p WHERE NOT coalesce(100 * most >= 100 * w.a, false)
QUALIFY rank <= 2000
""",
)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))


query(op12_spelling)
