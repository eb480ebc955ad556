"""Files by byte range, from executors and driver alike: local ones, and the stores that Arrow's filesystems reach (HDFS, S3, GCS, ABFS)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs

#: Bytes that are read at a time; of both ends of a file's known part that its seal covers.
CHUNK, HEAD, TAIL = 4 << 20, 4 << 10, 64 << 10


@lru_cache(maxsize=16)
def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(filesystem, path in it)."""
    m = re.match(r"(\w[\w+.-]*):(?://([^/]*))?(/.*)", path)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else path
    system, base = _store(f"{m[1]}://{m[2] or ''}/")
    return system, base.rstrip("/") + m[3]


def opened(path: str) -> pa.NativeFile:
    system, own = located(path)
    return system.open_input_file(own)


def listing(path: str) -> list[tuple[str, int, int]]:
    """(path as Spark names it, length, time of change) of the files below path, in order; none that Spark would pass over: names that begin with a dot or underscore, empty files."""
    system, own = located(path)
    outer = path.removesuffix(own) if path.endswith(own) and path != own else "file:"
    info = system.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True))
    keep = (f for f in found if f.type == fs.FileType.File and f.size and not re.search(r"(^|/)[._]", f.path[len(own.rstrip("/")) :]))
    return sorted((f"{path.rstrip('/')}{f.path[len(own.rstrip('/')) :]}" if outer not in ("file:", "file://") else f"file:{f.path}", f.size, f.mtime_ns or 0) for f in keep)


def pieces(path: str, begin: int, end: int, most: int | None = None) -> Iterator[bytes]:
    """The bytes from begin up to end, CHUNK (or, if that is less, `most`) at a time."""
    size = min(CHUNK, most or CHUNK)
    with opened(path) as f:
        f.seek(begin)
        while begin < end and (b := f.read(min(size, end - begin))):
            yield b
            begin += len(b)


def between(path: str, begin: int, end: int) -> bytes:
    return b"".join(pieces(path, begin, end))


def digests(path: str, *lengths: int) -> list[str | None]:
    """SHA-256 of the first so many bytes, for each length (ascending), from one pass; None: the file is shorter."""
    h, at, out = hashlib.sha256(), 0, []
    for length in lengths:
        for b in pieces(path, at, length):
            h.update(b)
            at += len(b)
        out.append(h.hexdigest() if at == length else None)
    return out


def seal(path: str, length: int, whole: bool = False) -> str | None:
    """A digest of a file's first `length` bytes: of all of them, or of their number and both ends. None: the file is shorter."""
    if whole:
        return digests(path, length)[0]
    head, tail = between(path, 0, min(HEAD, length)), between(path, max(0, length - TAIL), length)
    if len(head) < min(HEAD, length) or len(tail) < min(TAIL, length):
        return None
    return hashlib.sha256(b"%d\n" % length + head + tail).hexdigest()
