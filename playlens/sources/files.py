"""Where a path that Spark names lies for code inside a task."""

from __future__ import annotations

import re


def located(path: str):
    """(file system, its own path) of a path as Spark writes it: ``/x``, ``file:/x`` or ``scheme://host/x``, nothing encoded."""
    from pyarrow import fs

    remote = re.match(r"(?!file:)([a-z][a-z0-9+.-]*://[^/]+)/(.*)", path, re.S)
    if not remote:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    system, root = fs.FileSystem.from_uri(remote[1])
    return system, f"{root.rstrip('/')}/{remote[2]}"
