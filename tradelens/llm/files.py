"""Byte files in the shared folder, written and read by tasks.

Used for flat token files and index shards.  Paths are Hadoop-style URIs
under the shared checkpoint folder; pyarrow's file systems open them from
any executor.  Writers name a file after the task attempt and report the
name as a row, so only files of committed attempts are ever read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


# Hadoop's names of file systems that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (no scheme or ``file:`` is a mounted path)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def attempt_name(folder: str, stem: str) -> str:
    """A file URI no other task attempt uses."""
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}.bin"


def open_output(uri: str):
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_all(uri: str) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_stream(path) as f:
        return f.read()
