"""Binary files in the shared folder, from any executor: local paths and whatever pyarrow.fs opens by URI."""

from __future__ import annotations

import uuid


def _at(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write(path: str, data: list[bytes]) -> None:
    """All or nothing: a retried or speculative task replaces the file by one with the same content."""
    where, to = _at(path)
    folder, _, name = to.rpartition("/")
    where.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        for x in data:
            out.write(x)
    where.move(part, to)


def open_at(path: str):
    where, to = _at(path)
    return where.open_input_file(to)
