"""Files that tasks read and write themselves, through the file system their path names.

Spark's own readers and writers go through Hadoop; Python code in a task cannot.  It opens
``file:`` and plain paths locally and every other scheme (``hdfs``, ``viewfs``, ``s3``, ``gs``, ...)
by pyarrow's client.  A scheme without a client raises: a remote path is never taken for a
path on the task's own machine.  On a cluster a plain path must be one that all machines
share; ``qualified`` turns a path into one that names its file system, as Hadoop sees it.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
_SAME = {"s3a": "s3", "s3n": "s3", "gs": "gs"}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path inside it."""
    found = _SCHEME.match(path)
    scheme = found.group(1).lower() if found else "file"
    if scheme == "file":
        inner = path[len("file:"):] if found else path
        return pafs.LocalFileSystem(), re.sub(r"^/{2,}", "/", inner)
    uri = _SAME.get(scheme, scheme) + path[len(scheme):]
    try:
        return pafs.FileSystem.from_uri(uri)
    except Exception as e:
        raise ValueError(f"tasks have no client for {scheme}: paths ({path}): {e}") from e


def qualified(spark, path: str) -> str:
    """``path`` with its scheme and host: a plain path belongs to Hadoop's default file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).makeQualified(p).toString()


def list_files(path: str, suffix: str) -> list[str]:
    """Paths of the files under ``path`` (or ``path`` itself), sorted; hidden ones are left out."""
    fs, inner = open_fs(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    names = [f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(suffix)
             and not f.base_name.startswith((".", "_"))]
    root = path.rstrip("/")
    return sorted(f"{root}/{posixpath.relpath(n, inner.rstrip('/'))}" for n in names)


def read_bytes(path: str) -> bytes:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as f:
        return f.read()


@contextmanager
def open_whole(path: str):
    """A stream whose file appears under ``path`` only when it is complete.

    The bytes go to a hidden name beside it, moved at the end; after an error the hidden file goes.
    """
    fs, inner = open_fs(path)
    folder, name = posixpath.split(inner)
    fs.create_dir(folder, recursive=True)
    hidden = posixpath.join(folder, f".{name}.{uuid.uuid4().hex[:8]}.tmp")
    try:
        with fs.open_output_stream(hidden, compression=None) as f:
            yield f
    except BaseException:
        if fs.get_file_info(hidden).type == pafs.FileType.File:
            fs.delete_file(hidden)
        raise
    fs.move(hidden, inner)


def delete_file(path: str) -> None:
    fs, inner = open_fs(path)
    fs.delete_file(inner)
