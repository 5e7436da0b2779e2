"""Byte access to a shared folder by URI, from the driver and from executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, blocks) -> int:
    """Writes the blocks beside the name and moves them there when whole, so a task that runs again leaves one whole file."""
    to, path = resolve(uri)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with to.open_output_stream(part) as f:
        for x in blocks:
            f.write(x)
            size += len(x)
    to.move(part, path)
    return size


def read(uri: str) -> bytes:
    to, path = resolve(uri)
    with to.open_input_stream(path) as f:
        return f.read()


@lru_cache(None)
def mapped(uri: str, kind: type, n: int) -> np.ndarray:
    """A file's numbers, mapped into memory; from a store that isn't a folder by way of a copy that this process keeps."""
    to, path = resolve(uri)
    if isinstance(to, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", shape=(n,))
    copy = tempfile.TemporaryFile()  # noqa: SIM115
    with to.open_input_stream(path) as f:
        while block := f.read(1 << 22):
            copy.write(block)
    copy.flush()
    return np.memmap(copy, kind, "r", shape=(n,))


def fresh(base: str, name: str) -> str:
    """A new folder below base."""
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    to, path = resolve(uri)
    to.create_dir(path)
    return uri
