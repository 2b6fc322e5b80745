"""Object URLs."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.model import InvalidUrl, UnsupportedStore

#: Schemes that name an S3-compatible store, and how Spark's connector calls it.
SCHEMES = {"s3": "s3a"}


@dataclass(frozen=True)
class Location:
    bucket: str
    key: str | None
    version_id: str | None = None


def strip_slash(path: str) -> str:
    """Without one leading slash."""
    return path[1:] if path.startswith("/") else path


def parse_location(url: str) -> Location:
    """Bucket and key of an object URL; a URL never names a version."""
    parts = urlsplit(url)
    if parts.scheme.lower() not in SCHEMES:
        raise UnsupportedStore(f"{url}: unsupported object store {parts.scheme or '(none)'!r}")
    if not parts.hostname:
        raise InvalidUrl(f"{url}: there is no bucket")
    return Location(parts.netloc.rpartition("@")[2], strip_slash(parts.path) or None)


def url_columns(url: Column) -> dict[str, Column]:
    """``scheme, bucket, key`` of URLs in a column."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    key = F.regexp_replace(path, "^/", "")
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "bucket": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1),
        "key": F.when(key != "", key),
    }
