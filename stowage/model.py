"""Schemas, configuration and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from stowage.functions.sizes import parse_size

#: Limits of object stores and of the tar format; fixed values.
MAX_OBJECT_SIZE = 5 * 1024**4
MAX_PARTS = 10_000
TAR_BLOCK = 512
TAR_NAME = 100

OBJECTS = T.StructType(
    [
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("version_id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
IDENTITY = ["bucket", "key", "version_id"]
#: A total order: the time decides, the identity breaks ties.
ARCHIVE_ORDER = ["timestamp", *IDENTITY]


@dataclass(frozen=True)
class Config:
    """How archives are cut and transferred; sizes may be numbers or texts such as ``8MiB``.

    Some fields are what the store needs (region, credentials,
    endpoint); ``hadoop_conf`` turns it into Spark settings, ``store_options`` into
    those of the file systems of tasks.
    """

    multipart_chunk_size: int | str = "8MiB"
    multipart_threshold: int | str = "8MiB"
    max_concurrent_requests: int = 10
    region: str | None = None
    access_key_id: str | None = None
    secret_access_key: str | None = None
    session_token: str | None = None
    assume_role_arn: str | None = None
    assume_role_external_id: str | None = None
    assume_role_session_name: str | None = None
    endpoint: str | None = None
    path_style: bool = False
    user_agent: str | None = None
    credentials_provider: str | None = None
    #: Plain paths are the same folder on all machines. On a cluster they are refused otherwise.
    shared_paths: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    @property
    def chunk(self) -> int:
        return parse_size(self.multipart_chunk_size)

    @property
    def threshold(self) -> int:
        return parse_size(self.multipart_threshold)

    def hadoop_conf(self) -> dict[str, str]:
        """Settings of the S3A connector. A custom provider comes before static keys, these before a role, that before the environment."""
        s3a = "spark.hadoop.fs.s3a."
        out = {f"{s3a}threads.max": str(self.max_concurrent_requests), f"{s3a}multipart.size": str(self.chunk), f"{s3a}multipart.threshold": str(self.threshold)}
        if self.region:
            out[f"{s3a}endpoint.region"] = self.region
        if self.endpoint:
            out[f"{s3a}endpoint"] = self.endpoint
        if self.path_style:
            out[f"{s3a}path.style.access"] = "true"
        if self.user_agent:
            out[f"{s3a}user.agent.prefix"] = self.user_agent
        if self.credentials_provider:
            out[f"{s3a}aws.credentials.provider"] = self.credentials_provider
        elif self.access_key_id and self.secret_access_key:
            out |= {f"{s3a}access.key": self.access_key_id, f"{s3a}secret.key": self.secret_access_key}
            if self.session_token:
                out[f"{s3a}session.token"] = self.session_token
        elif self.assume_role_arn:
            out |= {f"{s3a}aws.credentials.provider": "org.apache.hadoop.fs.s3a.auth.AssumedRoleCredentialProvider", f"{s3a}assumed.role.arn": self.assume_role_arn}
            if self.assume_role_session_name:
                out[f"{s3a}assumed.role.session.name"] = self.assume_role_session_name
            if self.assume_role_external_id:
                out[f"{s3a}assumed.role.external.id"] = self.assume_role_external_id
        return out | self.extra


    def store_options(self) -> dict[str, str]:
        """The same for the file systems that tasks open; empty if nothing is said, and then the environment decides."""
        static = bool(self.access_key_id and self.secret_access_key)
        out = {
            "region": self.region,
            "endpoint_override": self.endpoint,
            "access_key": self.access_key_id if static else None,
            "secret_key": self.secret_access_key if static else None,
            "session_token": self.session_token if static else None,
            "role_arn": None if static else self.assume_role_arn,
            "session_name": None if static else self.assume_role_session_name,
            "external_id": None if static else self.assume_role_external_id,
        }
        out = {k: v for k, v in out.items() if v}
        return out | {"force_virtual_addressing": str(not self.path_style).lower()} if out else out


class StowageError(Exception):
    """Any error of this package."""


class UnsupportedStore(StowageError):
    """The URL's scheme names no known object store."""


class InvalidUrl(StowageError):
    """The URL has no bucket or no key where one is needed."""


class InvalidGlob(StowageError):
    """The pattern is no valid glob."""


class InvalidFilter(StowageError):
    """A filter is empty or only a slash."""


class NoInputs(StowageError):
    """An archive was asked for without any input."""


class NothingMatched(StowageError):
    """An input matched no object."""


class ObjectNotFound(NothingMatched):
    """A single object does not exist."""


class EmptyArchive(StowageError):
    """No input matched anything."""


class ObjectTooLarge(StowageError):
    """An object or archive is larger than the store allows."""


class InvalidKey(StowageError):
    """A key cannot be a path in an archive."""


class ArchiveNotFound(StowageError):
    """The archive to read does not exist."""


class CorruptArchive(StowageError):
    """A header of the archive is damaged."""
