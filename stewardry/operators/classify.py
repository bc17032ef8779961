"""Classification of documents by a user-supplied scorer.

The scorer gets lists of texts and hints and returns one raw answer per text. Parsing and
validation of the answers are Spark expressions; only the scorer itself runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LEVEL_PATTERN
from ..functions.text import ColumnOrName, col, once, strip
from ..session import cut_lineage
from .governance import FALLBACK_SOURCE, SHARING_CODES, by_model

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[str]]

CLASSIFICATION_TYPE = (
    "struct<tags:array<string>,security_level:string,summary:string,"
    "category_id:string,category_ids:array<string>>"
)
FALLBACK = {
    "tags": ("mock", "prototype", "fallback"),
    "security_level": "P4",
    "summary": "Fallback classification: no scorer answered.",
}
RETRY_HINT = "The last answer could not be read. Answer with one JSON object and a level from P1 to P4."


def fallback_classification() -> Column:
    return F.struct(
        F.array(*[F.lit(t) for t in FALLBACK["tags"]]).alias("tags"),
        F.lit(FALLBACK["security_level"]).alias("security_level"),
        F.lit(FALLBACK["summary"]).alias("summary"),
        F.lit(None).cast("string").alias("category_id"),
        F.lit(None).cast("array<string>").alias("category_ids"),
    ).cast(CLASSIFICATION_TYPE)


def extract_json(raw: ColumnOrName) -> Column:
    """The first fenced block if there is one, then from its first ``{`` to its last ``}``; else null."""
    fence = r"(?is)```(?:json)?\s*(.*?)```"

    def between(body: Column) -> Column:
        start = F.locate("{", body)
        end = F.length(body) - F.locate("}", F.reverse(body)) + 1
        found = (start > 0) & body.contains("}") & (end > start)
        return F.when(found, F.substring(body, start, end - start + 1))

    unfenced = lambda text: F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    return once(strip(F.coalesce(col(raw), F.lit(""))), lambda text: once(unfenced(text), between))


def _string_list(doc: Column, key: str) -> Column:
    """A list of texts, or one text taken as a list of one."""
    field = F.try_variant_get(doc, f"$.{key}", "variant")
    kind = F.schema_of_variant(field)
    values = F.when(kind.startswith("ARRAY"), F.try_variant_get(doc, f"$.{key}", "array<string>")).when(
        kind == "STRING", F.array(F.try_variant_get(doc, f"$.{key}", "string"))
    )
    return F.filter(F.transform(values, strip), lambda t: t.isNotNull() & (t != ""))


def _text(doc: Column, key: str) -> Column:
    # A present null reads as the word "None", an absent key as an empty text.
    field = F.try_variant_get(doc, f"$.{key}", "variant")
    text = F.when(F.is_variant_null(field), F.lit("None")).otherwise(F.try_variant_get(doc, f"$.{key}", "string"))
    return strip(F.coalesce(text, F.lit("")))


def validate_classification(json_text: ColumnOrName) -> Column:
    """``{valid, error, result}`` for one JSON answer."""

    def read(json: Column) -> Column:
        return once(F.try_parse_json(json), lambda doc: once(fields(json, doc), judged))

    def fields(json: Column, doc: Column) -> Column:
        category_field = F.try_variant_get(doc, "$.category_ids", "variant")
        category_ids = F.when(F.schema_of_variant(category_field).startswith("ARRAY"), _string_list(doc, "category_ids"))
        return F.struct(
            json.isNull().alias("no_json"),
            doc.isNull().alias("bad_json"),
            _string_list(doc, "tags").alias("tags"),
            _text(doc, "security_level").alias("security_level"),
            _text(doc, "summary").alias("summary"),
            strip(F.try_variant_get(doc, "$.category_id", "string")).alias("category_id"),
            category_ids.alias("category_ids"),
        )

    def judged(f: Column) -> Column:
        error = (
            F.when(f["no_json"], F.lit("no_json_object"))
            .when(f["bad_json"], F.lit("bad_json"))
            .when(f["tags"].isNull(), F.lit("tags_not_a_list"))
            .when(F.size(f["tags"]) == 0, F.lit("tags_empty"))
            .when(~f["security_level"].rlike(LEVEL_PATTERN), F.lit("bad_security_level"))
            .when(f["summary"] == "", F.lit("summary_empty"))
        )
        result = F.struct(*[f[name].alias(name) for name in ("tags", "security_level", "summary", "category_id", "category_ids")]).cast(CLASSIFICATION_TYPE)
        return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), result).alias("result"))

    return once(col(json_text), read)


def _score(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``df`` with ``raw`` for its ``text, hint``; an exception of the scorer fails the task, which Spark retries."""

    @F.pandas_udf("string")
    def ask(text: pd.Series, hint: pd.Series) -> pd.Series:
        return pd.Series(list(scorer(text.tolist(), hint.tolist())), dtype=object)

    return df.withColumn("raw", ask.asNondeterministic()("text", "hint"))


def _in_parts(contents: DataFrame, chars: int) -> DataFrame:
    """Each text in parts of at most ``chars`` characters, named ``<sha256>:<number of the part>``."""
    last = F.greatest(F.ceil(F.length("text") / chars) - 1, F.lit(0)).cast("int")
    texts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("text"), i * chars + 1, F.lit(chars)))
    parts = contents.select("sha256", "hint", F.posexplode(texts).alias("part", "text"))
    return parts.select(F.concat_ws(":", "sha256", F.col("part").cast("string")).alias("sha256"), "text", "hint")


def _of_part(df: DataFrame) -> DataFrame:
    """``df`` with the name of a part taken apart again."""
    return df.withColumn("part", F.substring_index("sha256", ":", -1).cast("int")).withColumn("sha256", F.substring_index("sha256", ":", 1))


def classify(
    docs: DataFrame,
    scorer: Scorer | None = None,
    source: str = "scorer",
    part_chars: int = 12_000,
) -> DataFrame:
    """Add ``result, inference_source, inference_reason`` to ``docs(sha256, text, hint)``.

    Equal contents are scored once, and whole: a text longer than ``part_chars`` is scored in
    parts, of which the most sensitive level, all tags and categories, and the first summary
    count. Answers are written out with the texts of the invalid ones, which get one second pass,
    so that the scorer never runs twice for one part within a pass, and texts move once.
    """
    if scorer is None:
        return docs.select(
            "*",
            fallback_classification().alias("result"),
            F.lit("mock").alias("inference_source"),
            F.lit("no_scorer").alias("inference_reason"),
        )
    contents = docs.groupBy("sha256").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.min("hint").alias("hint"))

    def answered(parts: DataFrame) -> DataFrame:
        checked = _score(parts, scorer).select("*", validate_classification(extract_json("raw")).alias("check"))
        unread = F.when(~F.col("check.valid"), F.col("text"))
        return cut_lineage(checked.select("sha256", "hint", unread.alias("text"), F.col("check.result").alias("found"), "check.valid"))

    first = answered(_in_parts(contents, part_chars))
    failed = first.filter(~F.col("valid")).select("sha256", "text", F.concat_ws("\n\n", "hint", F.lit(RETRY_HINT)).alias("hint"))
    of_pass = lambda df, again: df.select("sha256", "found", F.lit(again).alias("again"))
    each = _of_part(of_pass(first.filter("valid"), False).union(of_pass(answered(failed), True)))
    merged = each.groupBy("sha256").agg(
        F.array_sort(F.collect_list(F.when(F.col("found").isNotNull(), F.struct("part", "found")))).alias("found"),
        F.count("found").alias("good"),
        F.count(F.lit(1)).alias("parts"),
        F.count(F.when(F.col("again"), 1)).alias("asked_again"),
    )
    by_part = lambda name: F.transform("found", lambda e: e["found"][name])
    everything = F.struct(
        F.array_distinct(F.flatten(by_part("tags"))).alias("tags"),
        F.array_min(by_part("security_level")).alias("security_level"),
        F.get(by_part("summary"), F.lit(0)).alias("summary"),
        F.get(by_part("category_id"), F.lit(0)).alias("category_id"),
        F.array_distinct(F.flatten(F.filter(by_part("category_ids"), lambda x: x.isNotNull()))).alias("category_ids"),
    ).cast(CLASSIFICATION_TYPE)
    some = F.col("good") > 0
    answers = merged.select(
        "sha256",
        F.when(some, everything).otherwise(fallback_classification()).alias("result"),
        F.when(some, F.lit(source)).otherwise(FALLBACK_SOURCE).alias("inference_source"),
        F.when(~some, "json_or_schema_failed")
        .when(F.col("good") < F.col("parts"), "some_parts_failed")
        .when(F.col("asked_again") > 0, "retry_after_schema_fail")
        .otherwise("")
        .alias("inference_reason"),
    )
    return docs.join(answers, "sha256", "left")


def quality_flags(source: ColumnOrName, tags: ColumnOrName, level: ColumnOrName) -> Column:
    """``{likely_mock, shape_ok}``."""
    return F.struct(
        (~by_model(source)).alias("likely_mock"),
        ((F.size(F.coalesce(col(tags), F.array())) > 0) & (F.coalesce(col(level), F.lit("")) != "")).alias("shape_ok"),
    )


def parse_handling(raw: ColumnOrName) -> Column:
    """``{handling_note, sharing}`` from a raw answer; null where there is no note."""
    def read(doc: Column) -> Column:
        stated = strip(F.coalesce(F.try_variant_get(doc, "$.sharing", "string"), F.lit("internal_only")))
        fields = F.struct(doc.isNotNull().alias("there"), _text(doc, "handling_note").alias("note"), stated.alias("sharing"))
        return once(fields, noted)

    def noted(f: Column) -> Column:
        share = F.when(f["sharing"].isin(*SHARING_CODES), f["sharing"]).otherwise(F.lit(SHARING_CODES[0]))
        return F.when(f["there"] & (f["note"] != ""), F.struct(f["note"].alias("handling_note"), share.alias("sharing")))

    return once(F.try_parse_json(extract_json(raw)), read)


def handling_hints(docs: DataFrame, scorer: Scorer, part_chars: int = 1200) -> DataFrame:
    """``sha256, security_level, handling`` for the P1 and P2 rows of ``docs(sha256, text, security_level)``.

    Whole texts are asked about, in parts; the first note and the strictest sharing code count.
    """
    sensitive = (
        docs.filter(F.col("security_level").isin("P1", "P2"))
        .groupBy("sha256", "security_level")
        .agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
        .select("sha256", "text", F.concat(F.lit("security_level="), "security_level").alias("hint"))
    )
    answers = _score(_in_parts(sensitive, part_chars), scorer).select("sha256", "hint", parse_handling("raw").alias("one"))
    strictness = F.array_position(F.array(*[F.lit(c) for c in SHARING_CODES]), F.col("one.sharing"))
    known = F.col("one").isNotNull()
    merged = _of_part(answers).groupBy("sha256", "hint").agg(
        F.min_by("one.handling_note", F.when(known, F.col("part"))).alias("note"), F.min_by("one.sharing", strictness).alias("sharing")
    )
    handling = F.when(F.col("note").isNotNull(), F.struct(F.col("note").alias("handling_note"), "sharing"))
    return merged.select("sha256", F.substring_index("hint", "=", -1).alias("security_level"), handling.alias("handling"))
