"""``python -m stowage.cli create|extract``: the two jobs from the command line."""

from __future__ import annotations

import argparse
import shutil
import sys
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession

from stowage.api import check_path, create_archive, extract_archive, is_mounted
from stowage.functions.sizes import format_size
from stowage.model import Config, StowageError
from stowage.plans.scale import checkpoint_dir
from stowage.sources.files import filesystem


def parser() -> argparse.ArgumentParser:
    defaults = Config()
    p = argparse.ArgumentParser(prog="stowage", description="Create and extract tar archives of objects.")
    level = p.add_mutually_exclusive_group()
    level.add_argument("-v", "--verbose", action="store_true")
    level.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--multipart-chunk-size", default=defaults.multipart_chunk_size)
    p.add_argument("--multipart-threshold", default=defaults.multipart_threshold)
    p.add_argument("--max-concurrent-requests", type=int, default=defaults.max_concurrent_requests)
    for name in ("region", "access-key-id", "secret-access-key", "session-token", "assume-role-arn", "assume-role-external-id", "assume-role-session-name", "endpoint", "user-agent"):
        p.add_argument(f"--{name}")
    p.add_argument("--path-style", action="store_true")
    p.add_argument("--shared-paths", action="store_true", help="plain paths are the same folder on all machines")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create", help="pack objects into an archive")
    out = c.add_mutually_exclusive_group(required=True)
    out.add_argument("-f", "--file")
    out.add_argument("-s", "--s3", metavar="URL")
    out.add_argument("-t", "--stdout", action="store_true")
    c.add_argument("objects", nargs="+", metavar="URL")
    e = sub.add_parser("extract", help="unpack an archive")
    src = e.add_mutually_exclusive_group(required=True)
    src.add_argument("-f", "--file")
    src.add_argument("-s", "--s3", metavar="URL")
    src.add_argument("-t", "--stdin", action="store_true")
    e.add_argument("target", metavar="URL")
    e.add_argument("filters", nargs="*", metavar="FILTER")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    names = Config.__dataclass_fields__.keys() & vars(a).keys()
    config = Config(**{n: getattr(a, n) for n in names})
    spark = SparkSession.builder.config(map=config.hadoop_conf()).getOrCreate()
    say = (lambda event, **v: None) if a.quiet else lambda event, **v: print(event, *(f"{k}={x}" for k, x in v.items()), file=sys.stderr)
    try:
        # standard input and output go through a file that all machines see
        spool = f"{checkpoint_dir(spark)}/spool-{uuid.uuid4().hex}.tar" if a.command == "create" and a.stdout or a.command == "extract" and a.stdin else None
        if spool and a.command == "extract":
            check_path(spark, a.target, config)
        if spool and is_mounted(spool):
            config = replace(config, shared_paths=True)  # the checkpoint folder is
        where, name = filesystem(spool, config.store_options()) if spool else (None, None)
        try:
            if a.command == "create":
                done = create_archive(spark, a.objects, spool or a.file or a.s3, config, progress=say)
                if spool:
                    with where.open_input_stream(name) as f:
                        shutil.copyfileobj(f, sys.stdout.buffer)
                size, count = done.archive_bytes, done.n_objects
            else:
                if spool:
                    with where.open_output_stream(name) as f:
                        shutil.copyfileobj(sys.stdin.buffer, f)
                done = extract_archive(spark, spool or a.file or a.s3, a.target, a.filters, config, progress=say)
                size, count = done.extracted_bytes, done.extracted_objects
        finally:
            if spool and where.get_file_info(name).type.name == "File":
                where.delete_file(name)
    except StowageError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not a.quiet:
        print(f"{count} objects, {format_size(size)} in {done.seconds:.1f} s ({format_size(size / max(done.seconds, 1e-9))}/s)", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
