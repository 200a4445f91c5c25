"""Files on the shared storage from inside tasks, by URI (local, s3, gs or hdfs through pyarrow)."""

from __future__ import annotations

import re

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's spellings ``file:/x`` and ``s3a://`` are known."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:"):]
    elif uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, tag: str):
    """An output stream to ``uri`` under a temporary name, and the call that publishes it.

    ``tag`` tells attempts of one task apart, so a retried or speculative task never mixes its bytes
    with another's; the last one to finish replaces the file with equal content.
    """
    system, path = open_fs(uri)
    part = f"{path}.{tag}.part"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(part, compression=None), lambda: system.move(part, path)
