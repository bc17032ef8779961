"""Regular expressions as users write them, in the dialect that Spark runs.

Users state patterns in Python's dialect; Spark evaluates them with ``java.util.regex``. The
differences are translated, and the JVM has the last word: what it does not compile is no
pattern, whatever Python thinks of it.
"""

from __future__ import annotations

import re
import warnings

from pyspark import SparkContext

# Openings that only one of the dialects knows, and what stands for them in the other.
_GROUPS = ((re.compile(r"\(\?P<([A-Za-z]\w*)>"), r"(?<\1>"), (re.compile(r"\(\?P=([A-Za-z]\w*)\)"), r"\\k<\1>"))
_COMMENT = re.compile(r"\(\?#[^)]*\)")
_TOKEN = re.compile(r"\\.|\[|\(\?P<[A-Za-z]\w*>|\(\?P=[A-Za-z]\w*\)|\(\?#[^)]*\)|.", re.DOTALL)


class PatternError(ValueError):
    """The text is not a pattern that both sides agree on."""


def _class_end(pattern: str, start: int) -> int:
    """Index of the bracket that closes the class opened at ``start``."""
    at = start + 1 + pattern.startswith("^", start + 1)
    at += pattern.startswith("]", at)
    while at < len(pattern) and pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at


def _java_class(body: str) -> str:
    """A class without Java's nested classes and set operators: there, ``[`` and ``&&`` are text."""
    negated = body.startswith("^")
    rest = body[negated:]
    first, rest = (r"\]", rest[1:]) if rest.startswith("]") else ("", rest)
    plain = re.sub(r"\\.|\[|&&|\^", lambda m: m[0] if m[0][0] == "\\" else "".join(f"\\{c}" for c in m[0]), rest, flags=re.DOTALL)
    return f"[{'^' if negated else ''}{first}{plain}]"


def java_pattern(pattern: str) -> str:
    """``pattern`` in Java's dialect; :class:`PatternError` where it has no equal there."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # set operators, which are text here
            re.compile(pattern)
    except re.error as err:
        raise PatternError(str(err)) from None
    out, at = [], 0
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)[0]
        if token == "[":
            end = _class_end(pattern, at)
            out.append(_java_class(pattern[at + 1 : end]))
            at = end + 1
            continue
        at += len(token)
        if _COMMENT.fullmatch(token):
            continue
        if token == r"\Z":
            token = r"\z"
        for opening, other in _GROUPS:
            token = opening.sub(other, token)
        out.append(token)
    return "".join(out)


def compiled_pattern(pattern: str, flags: str = "") -> str:
    """The translated pattern with inline ``flags``, compiled once by the JVM of the session."""
    stated = f"(?{flags}){java_pattern(pattern)}" if flags else java_pattern(pattern)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(stated)
        except Exception as err:
            raise PatternError(str(err).splitlines()[0]) from None
    return stated
