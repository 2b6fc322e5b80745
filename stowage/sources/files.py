"""Files of any store, as tasks open them."""

from __future__ import annotations

from urllib.parse import urlsplit

from stowage.model import ArchiveNotFound

#: Options of data sources that begin so are for the store.
STORE = "store."


def filesystem(path: str, store: dict[str, str] | None = None):
    """A pyarrow file system and the path in it. ``store`` has the region, credentials and so on of an S3-compatible store."""
    from pyarrow import fs

    scheme = urlsplit(path).scheme
    if not scheme:
        return fs.LocalFileSystem(), path
    if scheme in ("s3", "s3a"):
        if store:
            own = {k: v for k, v in store.items() if k != "force_virtual_addressing"}
            return fs.S3FileSystem(**own, force_virtual_addressing=store.get("force_virtual_addressing") == "true"), path.split("://", 1)[1]
        return fs.FileSystem.from_uri("s3://" + path.split("://", 1)[1])
    return fs.FileSystem.from_uri(path)


def store_of(options: dict[str, str]) -> dict[str, str]:
    """What the options of a data source say about the store."""
    return {k.removeprefix(STORE): v for k, v in options.items() if k.startswith(STORE)}


def store_options(store: dict[str, str]) -> dict[str, str]:
    """The same as options of a data source."""
    return {STORE + k: v for k, v in store.items()}


def open_path(path: str, store: dict[str, str] | None = None):
    """A seekable file for reading."""
    where, name = filesystem(path, store)
    try:
        return where.open_input_file(name)
    except FileNotFoundError as e:
        raise ArchiveNotFound(f"there is no file at {path}") from e
