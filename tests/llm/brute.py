"""Plain Python versions of the span contracts."""

from __future__ import annotations

import hashlib
import re


def spans_of(text, patterns):
    """patterns: (kind, regex, keep) in listed order; returns counts and spans by start, then kind."""
    text, found, counts = text or "", [], []
    for order, (kind, regex, keep) in enumerate(patterns):
        own = [m for m in re.finditer(regex, text) if keep(m)]
        counts.append(len(own))
        found += [(m.start(), order, m.end(), kind) for m in own]
    written = [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]
    return counts, written, hashlib.sha256(",".join(written).encode()).hexdigest()


SECRETS = (
    (
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[1]) >= 6,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def luhn(match) -> bool:
    digits = [int(c) for c in match if c.isdigit()]
    if not 14 <= len(digits) <= 19:
        return False
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.findall("[0-9]", m[0])) <= 15),
)

PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


def licence_places(text):
    """Number of words, starts of base phrases, base labels."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), places, ",".join(sorted(labels))
