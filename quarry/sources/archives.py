"""Project archives (zip) to one row per entry (SRC5).

Each archive is one row of ``binaryFile``; a ``mapInPandas`` step opens it
with ``zipfile`` inside the task and yields its entries in bounded chunks.
Archives are independent, so the work spreads over all archive partitions.
"""

from __future__ import annotations

import io
import posixpath
import zipfile

import pandas as pd
from pyspark.sql import DataFrame

ENTRY_SCHEMA = "archive string, project_id int, entry string, content binary, ok boolean, error string"
CHUNK = 256


def _safe_name(name: str) -> str | None:
    """Entry name with '\\' as '/', or None when it is absolute or climbs out ('..')."""
    n = name.replace("\\", "/")
    if n.startswith("/") or (len(n) > 1 and n[1] == ":"):
        return None
    norm = posixpath.normpath(n)
    if norm == ".." or norm.startswith("../") or "/../" in f"/{n}/":
        return None
    return norm


def _entries(batches):
    cols = ENTRY_SCHEMA.split(", ")
    names = [c.split()[0] for c in cols]

    def frame(rows):
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object)
                             for i, c in enumerate(names)})

    for pdf in batches:
        for archive, pid, content in zip(pdf["archive"], pdf["project_id"], pdf["content"]):
            pid = None if pid is None or pid != pid else int(pid)
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as zf:
                    for info in zf.infolist():
                        if info.is_dir():
                            continue
                        safe = _safe_name(info.filename)
                        if safe is None:
                            rows.append((archive, pid, info.filename, None, False, "unsafe entry path"))
                            continue
                        rows.append((archive, pid, safe, zf.read(info), True, None))
                        if len(rows) >= CHUNK:
                            yield frame(rows)
                            rows = []
            except (zipfile.BadZipFile, OSError, EOFError, ValueError) as e:
                rows.append((archive, pid, None, None, False, f"{type(e).__name__}: {e}"))
            if rows:
                yield frame(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """(archive, project_id, entry, content, ok, error) for every entry of every archive.

    Entries with an absolute or '..' path are rejected (ok = false, no
    content); a truncated or corrupt archive yields one ok = false row after
    whatever entries were read before the failure.
    """
    return archives.select("archive", "project_id", "content").mapInPandas(_entries, ENTRY_SCHEMA)
