"""Glob patterns over keys: ``*`` and ``?`` stay inside one path component."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.model import InvalidGlob

META = "*?[]"
#: A class without members.
NOTHING = r"[^\x{0}-\x{10FFFF}]"


def is_glob(text: str) -> bool:
    return any(c in text for c in META)


def literal_prefix(pattern: str) -> str:
    """What every match begins with: the text before the first metacharacter."""
    return re.match(r"[^*?\[\]]*", pattern)[0]


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The regex of the bracket expression that begins at ``at``, and where it ends."""
    i = at + 1
    negated = i < len(pattern) and pattern[i] == "!"
    i += negated
    end = pattern.find("]", i + 1)  # a bracket in the first place is a member
    if end < 0:
        raise InvalidGlob(f"unclosed [ in {pattern!r}")
    members: list[tuple[str, str]] = []
    while i < end:
        if i + 2 < end and pattern[i + 1] == "-":
            members.append((pattern[i], pattern[i + 2]))
            i += 3
        else:
            members.append((pattern[i], pattern[i]))
            i += 1
    # no class matches a slash, so ranges are cut around it
    parts: list[tuple[str, str]] = []
    for lo, hi in members:
        if negated or not lo <= "/" <= hi:
            parts.append((lo, hi))
        else:
            parts += [(a, b) for a, b in ((lo, chr(ord("/") - 1)), (chr(ord("/") + 1), hi)) if a <= b]
    parts = [(a, b) for a, b in parts if a <= b]
    if negated:
        parts.append(("/", "/"))
    if not parts:
        return NOTHING, end + 1
    quote = lambda c: "\\" + c if c in r"\]^-[&~" else c
    body = "".join(quote(a) if a == b else f"{quote(a)}-{quote(b)}" for a, b in parts)
    return f"[{'^' if negated else ''}{body}]", end + 1


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression without look-around that matches whole keys."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "?":
            out.append("[^/]")
            i += 1
        elif c == "*":
            stars = len(re.match(r"\**", pattern[i:])[0])
            if stars == 1:
                out.append("[^/]*")
                i += 1
                continue
            if stars > 2:
                raise InvalidGlob(f"more than two * in a row in {pattern!r}")
            starts, after = i == 0 or pattern[i - 1] == "/", pattern[i + 2 : i + 3]
            if not starts or after not in ("", "/"):
                raise InvalidGlob(f"** is not a whole component in {pattern!r}")
            if after == "/":
                out.append("(?:.*/)?")
                i += 3
            else:
                out.append(".*")
                i += 2
        elif c == "[":
            part, i = _class(pattern, i)
            out.append(part)
        else:
            out.append("\\" + c if c in r"\.+()|^${}]" else c)
            i += 1
    return f"(?s)^{''.join(out)}$"


@lru_cache(maxsize=1000)
def compiled(pattern: str) -> re.Pattern:
    """The same expression for Python."""
    return re.compile(glob_to_regex(pattern).removesuffix("$").replace(NOTHING, r"[^\x00-\U0010FFFF]") + r"\Z")


def matches_glob(key: Column, pattern: str) -> Column:
    """Keys that match. The literal prefix is a condition of its own, which a source can take over."""
    regex, prefix = key.rlike(glob_to_regex(pattern).removesuffix("$") + r"\z"), literal_prefix(pattern)
    return key.startswith(prefix) & regex if prefix else regex
