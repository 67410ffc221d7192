"""Secret redaction as a chain of linear-time regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED]"

# --- fixed values -----------------------------------------------------------
# (pattern, Java replacement). Every pattern is valid in Java and in RE2.
# Group 1, where there is one, is the part that stays.
RULES: tuple[tuple[str, str], ...] = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", PLACEHOLDER),
    (r"\bsk-[A-Za-z0-9_-]{16,}", PLACEHOLDER),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", PLACEHOLDER),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", PLACEHOLDER),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", PLACEHOLDER),
    (
        r"""(?i)\b((?:password|passwd|secret|token|api[_-]?key)[ \t]*[:=][ \t]*["']?)[^\s"'\[\]]+""",
        "$1" + PLACEHOLDER,
    ),
)
# Text one of which every match of a rule contains; the last rule needs its
# key word and a colon or equals sign.
MARKS = ("-----BEGIN", "sk-", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ")
ASSIGNMENT = r"(?i)(?:password|passwd|secret|token|api[_-]?key)[ \t]*[:=]"
# ----------------------------------------------------------------------------


def _suspicious(text: Column) -> Column:
    """Cheap necessary condition: plain substring tests before any pattern."""
    marked = reduce(lambda a, b: a | b, [text.contains(mark) for mark in MARKS])
    return marked | ((text.contains("=") | text.contains(":")) & text.rlike(ASSIGNMENT))


def redact_secrets(text: Column) -> Column:
    """Pass a plain column: the expression refers to it several times."""
    cleaned = reduce(lambda value, rule: F.regexp_replace(value, rule[0], rule[1]), RULES, text)
    return F.when(_suspicious(text), cleaned).otherwise(text)


def redaction_count(text: Column) -> Column:
    """How many places redaction changed: placeholders after minus before."""
    mark = F.lit(r"\[REDACTED\]")
    return (F.regexp_count(redact_secrets(text), mark) - F.regexp_count(text, mark)).cast("bigint")
