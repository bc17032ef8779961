"""Literal texts that every match of a pattern holds, read off the parsed pattern."""

from __future__ import annotations

import re
import warnings

LEAST = 3


def _runs(parsed, out: list[list[str]], run: list[str]) -> list[str]:
    """Append to ``out`` the alternatives that each required part of ``parsed`` asks for; returns the
    run of plain characters at its end."""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(value))
            continue
        if name == "SUBPATTERN":
            run = _runs(value[3], out, run)
            continue
        if name == "AT":
            continue
        _close(out, run)
        run = []
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            _close(out, _runs(value[2], out, []))
        elif name == "ATOMIC_GROUP":
            _close(out, _runs(value, out, []))
        elif name == "BRANCH":
            found = [_alternatives(branch) for branch in value[1]]
            if all(found):
                out.append([literal for branch in found for literal in branch])
    return run


def _close(out: list[list[str]], run: list[str]) -> None:
    # Lower case may change the number of characters, as in Java; such letters end a run.
    for part in re.split(r"[^\x00-\x7f]", "".join(run)):
        if len(part) >= LEAST:
            out.append([part.lower()])


def _alternatives(parsed) -> list[str] | None:
    """Texts of which one stands in every match; None if none is known. Of several such sets the
    one whose shortest text is longest."""
    out: list[list[str]] = []
    _close(out, _runs(parsed, out, []))
    return max(out, key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case ASCII texts of at least three characters, one of which stands, in any case, in every
    text that ``pattern`` (Python's dialect, letters in either case) matches. None where there are none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return _alternatives(re._parser.parse(pattern, re.IGNORECASE))
        except (re.error, RecursionError, OverflowError):
            return None
