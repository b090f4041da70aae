"""Files behind Spark paths, for the few steps that handle whole files or folders."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Spark path and the path in it: ``file:/x``, ``/x`` or any scheme Arrow knows."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)
