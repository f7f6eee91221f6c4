"""Whole files written by tasks to a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def write_file(folder: str, name: str, content: bytes) -> None:
    """Write ``name`` below ``folder`` (a URI or an absolute path): under another name first, then moved, so a repeated task does no harm."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    path = f"{base.rstrip('/')}/{name}"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, path)


def zip_member(uri: str, member: str) -> bytes | None:
    """One member of a ZIP archive, or None: only the archive's directory and the member's own bytes are read, wherever the file lies."""
    import zipfile

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + "/" + uri.removeprefix("file:").lstrip("/"))
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        return z.read(member) if member in z.NameToInfo else None


def plain_path(uri: Column) -> Column:
    """A file's path without scheme, so that ``file:/a`` and ``/a`` agree."""
    return F.concat(F.lit("/"), F.regexp_replace(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")), r"^(?:[a-zA-Z0-9]+:)?/*", ""))
