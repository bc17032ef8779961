"""Secret scans over an incremental ledger of text blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger holds one row
per blob and rule version with the findings. A scan reads only blobs with a rule version that
the ledger does not hold, and joins findings back to every path that has the blob.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, store
from .words import text_bytes

FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, rule string, findings {FINDING}"
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """``cues``: lower-case texts of which one stands in every text with a match."""

    kind: str
    pattern: str
    cues: tuple[str, ...] = ()
    any_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        stated = repr((self.kind, self.pattern, self.any_case, self.group, self.least))
        return f"{self.kind}@{hashlib.sha256(stated.encode()).hexdigest()[:12]}"


RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("passw", "secret", "token", "apikey", "api_key"),
        any_case=True,
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), least=20),
    Rule("hex", r"[0-9a-f]{24,}", ("",)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ("eyj",)),
)

_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def _long_hex(texts: pa.Array, least: int = 24) -> np.ndarray:
    """Which texts may have a run of at least ``least`` hex digits; runs across two texts count
    for the first one, the pattern decides."""
    data, bounds = text_bytes(texts)
    run, length = _HEX[data], 1
    while length < least and len(run):
        step = min(length, least - length)
        run = run[: max(len(run) - step, 0)] & run[step:]
        length += step
    has = np.zeros(len(bounds) - 1, dtype=bool)
    has[np.searchsorted(bounds, np.flatnonzero(run), "right") - 1] = True
    return has


def _find(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    found = (m for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least)
    return [m.span() for m in found]


def scan(text: Column, wanted: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Findings of the rules whose bits ``wanted`` has, by start and order of the rules.

    Matches of one rule are leftmost and do not overlap; positions are code points. Letters are
    folded as ASCII only. Null text has no findings.
    """

    @F.arrow_udf(FINDING)
    def scanned(texts: pa.Array, bits: pa.Array) -> pa.Array:
        compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        hexed = _long_hex(texts)
        out = []
        for i, (t, todo) in enumerate(zip(texts.to_pylist(), bits.to_pylist())):
            rows = []
            low = t.lower() if t else ""
            for rank, rule in enumerate(rules):
                if t and todo >> rank & 1 and (hexed[i] if rule.kind == "hex" else any(c in low for c in rule.cues)):
                    rows += [(a, rank, rule.kind, b) for a, b in _find(t, rule, compiled[rank])]
            out.append([dict(zip(("start", "rank", "kind", "end"), r)) for r in sorted(rows)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        return pa.array(out, kind)

    return scanned(text, wanted)


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _bit_of(version: Column, rules: tuple[Rule, ...]) -> Column:
    bit = F.lit(0)
    for i, rule in enumerate(rules):
        bit = F.when(version == rule.version, F.lit(1 << i)).otherwise(bit)
    return bit


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(new, versions)``: the ledger rows to append, and ``key, blob`` per row of ``docs``.

    One row per blob is scanned, however many rows of ``docs`` hold it, and only for rule
    versions that ``ledger`` (columns of ``LEDGER``) lacks for it. Null text is the empty blob.
    Keys may repeat or be null.
    """
    versions = store(docs.select(F.col(key).alias("key"), blob_name(docs["text"]).alias("blob")))
    held = versions.groupBy("blob").agg(F.min("key").alias("key"))
    every = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        todo = held.withColumn("wanted", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as rule versions
        nothing = F.array().cast("array<string>")
        todo = held.join(seen, "blob", "left").withColumn("wanted", F.array_except(every, F.coalesce("seen", nothing)))
        todo = todo.filter(F.size("wanted") > 0).drop("seen")
    # Only numbers meet the texts: the key, 64 bits of the name, and a bit for each wanted rule.
    bits = sum(F.array_contains("wanted", r.version).cast("int") * (1 << i) for i, r in enumerate(rules))
    todo = small(store(todo.select(F.col("key").alias("of"), F.xxhash64("blob").alias("unseen"), bits.alias("wanted"))))
    named = docs.select(F.col(key).alias("key"), "text", blob_name(docs["text"]).alias("blob"))
    unseen = named.join(todo, named["key"].eqNullSafe(todo["of"]) & (F.xxhash64(named["blob"]) == todo["unseen"]))
    scanned = unseen.select("blob", "wanted", scan(F.col("text"), F.col("wanted"), rules).alias("all"))
    # A key that repeats with the same text is the same blob once.
    once = scanned.groupBy("blob").agg(F.first("wanted").alias("wanted"), F.first("all").alias("all"))
    asked = F.filter(every, lambda r: F.expr("wanted").bitwiseAND(_bit_of(r, rules)) > 0)
    per_rule = once.select("blob", F.explode(asked).alias("rule"), "all")
    own = F.filter("all", lambda f: f["kind"] == F.substring_index(F.col("rule"), "@", 1))
    return store(per_rule.select("blob", "rule", own.alias("findings"))), versions


def findings_of(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, findings`` per row of ``versions``, from the ledger rows of the given rules."""
    current = ledger.filter(F.col("rule").isin([r.version for r in rules]) & (F.size("findings") > 0))
    per_blob = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    nothing = F.from_json(F.lit("[]"), FINDING)
    return versions.join(per_blob, "blob", "left").select("key", F.coalesce("findings", nothing).alias("findings"))


def joined(findings: Column) -> Column:
    """Findings as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
