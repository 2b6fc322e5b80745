"""Selectors of objects and filters of archive entries, as predicates over keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.globs import compiled, glob_to_regex, is_glob, literal_prefix, matches_glob
from stowage.model import InvalidFilter


@dataclass(frozen=True)
class Selector:
    """One input of an archive: all of a bucket, a prefix, a glob or one object. A listing may also be of all ``below`` a prefix."""

    kind: str
    value: str | None = None

    @staticmethod
    def parse(text: str | None) -> Selector:
        """A glob if it has any metacharacter, a prefix if it ends in a slash, else an object; nothing is the bucket."""
        if not text:
            return Selector("bucket")
        if is_glob(text):
            glob_to_regex(text)  # raises if it is none
            return Selector("glob", text)
        return Selector("prefix" if text.endswith("/") else "object", text)

    def predicate(self, key: Column | None = None) -> Column:
        """Keys that are selected. A prefix takes direct children only."""
        key = F.col("key") if key is None else key
        if self.kind == "bucket":
            return F.lit(True)
        if self.kind == "glob":
            return matches_glob(key, self.value)
        if self.kind == "below":
            return key.startswith(self.value)
        if self.kind == "prefix":
            return key.startswith(self.value) & ~F.substring(key, F.lit(len(self.value) + 1), F.length(key)).contains("/")
        return key == self.value

    def scope(self) -> dict[str, str]:
        """Options of a listing that has all keys which are selected, and few others."""
        if self.kind == "bucket":
            return {}
        if self.kind in ("glob", "below"):
            return {"prefix": literal_prefix(self.value) if self.kind == "glob" else self.value}
        return {"prefix": self.value, "direct": "true"} if self.kind == "prefix" else {"key": self.value}

    def describe(self, bucket: str) -> str:
        """For messages."""
        return {"bucket": f"all objects of {bucket}", "prefix": f"objects under {bucket}/{self.value}", "glob": f"objects of {bucket} matching {self.value}", "object": f"object {bucket}/{self.value}"}[self.kind]


@dataclass(frozen=True)
class EntryFilter:
    """A filter of archive entries. Unlike a selector's, its prefix takes everything below."""

    kind: str
    value: str

    @staticmethod
    def parse(text: str) -> EntryFilter:
        if text in ("", "/"):
            raise InvalidFilter(f"{text!r} is no filter")
        if is_glob(text):
            glob_to_regex(text)
            return EntryFilter("glob", text)
        return EntryFilter("prefix" if text.endswith("/") else "object", text)

    def predicate(self, key: Column | None = None) -> Column:
        key = F.col("key") if key is None else key
        if self.kind == "glob":
            return matches_glob(key, self.value)
        return key.startswith(self.value) if self.kind == "prefix" else key == self.value


    def takes(self, key: str) -> bool:
        """The same for one key, where headers are read."""
        if self.kind == "glob":
            return compiled(self.value).match(key) is not None
        return key.startswith(self.value) if self.kind == "prefix" else key == self.value


def scopes(selectors: list[Selector]) -> list[Selector]:
    """Selectors whose listings together have all keys that any of these selects; what a longer listing has is not listed again."""
    deep = sorted({s.scope().get("prefix", "") for s in selectors if s.kind in ("bucket", "glob")})
    deep = [p for p in deep if not any(q != p and p.startswith(q) for q in deep)]
    inside = lambda key: any(key.startswith(p) for p in deep)
    folders = sorted({s.value for s in selectors if s.kind == "prefix" and not inside(s.value)})
    keys = sorted({s.value for s in selectors if s.kind == "object" and not inside(s.value) and s.value.rpartition("/")[0] + "/" not in folders})
    return [*(Selector("below", p) if p else Selector("bucket") for p in deep), *(Selector("prefix", p) for p in folders), *(Selector("object", k) for k in keys)]


def any_filter(filters: list[EntryFilter], key: Column | None = None) -> Column:
    """Entries that any filter takes; all of them if there is none."""
    return reduce(or_, (f.predicate(key) for f in filters)) if filters else F.lit(True)


def input_kind(text: Column) -> Column:
    """The kind of an input given as text, in a column."""
    return F.when(text.isNull() | (text == ""), "bucket").when(text.rlike(r"[*?\[\]]"), "glob").when(text.endswith("/"), "prefix").otherwise("object")


def filter_kind(text: Column) -> Column:
    """The kind of a filter given as text, in a column."""
    return F.when(text.isNull() | text.isin("", "/"), "error").when(text.rlike(r"[*?\[\]]"), "glob").when(text.endswith("/"), "prefix").otherwise("object")


def literal_prefix_of(pattern: Column) -> Column:
    """The literal prefix of globs in a column."""
    return F.regexp_extract(pattern, r"^([^*?\[\]]*)", 1)
