"""Archives within chunks, unpacked within limits."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH, ENTRY, TOTAL, FILES = 3, 10 << 20, 50 << 20, 1_000
_ENTRIES = "array<struct<archive_path:string,content:binary,problem:string>>"


def kind(data: str = "content") -> Column:
    """zip, gzip, bzip2 or tar by their first bytes, else null."""
    head, tar = F.hex(F.substring(data, 1, 4)), F.hex(F.substring(data, 258, 5))
    return F.when(head.isin("504B0304", "504B0506"), "zip").when(head.startswith("1F8B"), "gzip").when(head.startswith("425A68"), "bzip2").when(tar == "7573746172", "tar")


def safe(name: str) -> bool:
    """Relative, without drives, backslashes, zero characters or steps upwards."""
    return bool(name) and "\0" not in name and "\\" not in name and not name.startswith("/") and name[1:2] != ":" and ".." not in name.split("/")


def _kind(data: bytes) -> str | None:
    if data[:4] in (b"PK\3\4", b"PK\5\6"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    return "bzip2" if data[:3] == b"BZh" else "tar" if data[257:262] == b"ustar" else None


def entries(data: bytes, at: str = "", depth: int = 0, left: list[int] | None = None):
    """(path, bytes, problem) of all files, nested archives included; a problem comes without bytes."""
    left = [FILES, TOTAL] if left is None else left
    what = _kind(data)
    if what is None:
        yield at, data, None
        return
    if depth >= DEPTH:
        yield at, None, "nested too deep"
        return
    try:
        for name, size, open_ in _members(data, what):
            path = f"{at}/{name}" if at and name else at or name
            if name and not safe(name):
                yield path, None, "unsafe name"
            elif size is not None and size > ENTRY:
                yield path, None, "entry too large"
            elif left[0] <= 0 or left[1] <= 0:
                yield path, None, "archive too large"
                return
            else:
                with open_() as stream:
                    body = stream.read(ENTRY + 1)
                left[0] -= 1
                left[1] -= len(body)
                if len(body) > ENTRY:
                    yield path, None, "entry too large"
                else:
                    yield from entries(body, path, depth + 1, left)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, NotImplementedError, RuntimeError) as e:
        yield at, None, f"malformed: {type(e).__name__}"


def _members(data: bytes, what: str):
    if what == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, lambda i=info: z.open(i)
    elif what == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield info.name, info.size, lambda i=info: t.extractfile(i)
    else:
        yield "", None, lambda: (gzip.open if what == "gzip" else bz2.open)(io.BytesIO(data))


def explode(chunks: DataFrame, data: str = "content") -> DataFrame:
    """One row per file of each chunk's archive, a chunk that is none being its own: archive_path, content, problem."""
    fields = pa.list_(pa.struct([("archive_path", pa.string()), ("content", pa.binary()), ("problem", pa.string())]))

    @F.arrow_udf(_ENTRIES)
    def opened(values: pa.Array) -> pa.Array:
        return pa.array([[{"archive_path": p, "content": b, "problem": e} for p, b, e in entries(v)] if v is not None else [] for v in values.to_pylist()], fields)

    return chunks.withColumn("_e", F.explode(opened(data))).drop(data).select("*", "_e.*").drop("_e")
