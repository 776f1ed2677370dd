"""Files by path on any store that Arrow knows: listing, heads, ranges, whole writes and appends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs

#: Schemes of Hadoop and what Arrow calls them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs", "hdfs": "hdfs"}
HEAD_BYTES = 1 << 16


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, sep, rest = uri.partition(":")
    if not sep or "/" in scheme:
        return pa.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def first_line(uri: str) -> bytes:
    """The first line of a file, without its end; no more than that is read."""
    fs, path = opened(uri)
    out = b""
    with fs.open_input_file(path) as f:
        while b"\n" not in out:
            part = f.read(HEAD_BYTES)
            if not part:
                break
            out += part
    return out.partition(b"\n")[0]


def read_from(uri: str, offset: int, step: int = 1 << 22) -> Iterator[bytes]:
    """The bytes of a file from an offset on, in steps."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        while offset < size:
            part = f.read_at(min(step, size - offset), offset)
            if not part:
                return
            offset += len(part)
            yield part


def owned_lines(uri: str, begin: int, end: int, step: int = 1 << 20) -> Iterator[tuple[bytes, bool]]:
    """(line without its end, whether it has none) of the lines that start in a range of a file; one that goes on beyond it is read to its end."""
    foreign = begin > 0  # bytes of a line that starts before the range
    at = start = max(begin - 1, 0)
    parts: list[bytes] = []
    for chunk in read_from(uri, at, step):
        if foreign and at >= end:
            return
        at += len(chunk)
        *whole, rest = chunk.split(b"\n")
        for piece in whole:
            line = b"".join([*parts, piece])
            parts = []
            if not foreign:
                yield line, False
                start += len(line) + 1
            else:
                foreign, start = False, at - len(chunk) + len(piece) + 1
            if start >= end:
                return
        if not foreign:
            parts.append(rest)
    if any(parts):
        yield b"".join(parts), True


def write_whole(uri: str, data: bytes, attempt: str = "0") -> None:
    """A file that is there whole or not at all."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(draft, compression=None) as f:
        f.write(data)
    fs.move(draft, path)


def size(uri: str) -> int:
    """The bytes of a file; none where there is no file."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    return info.size if info.type == pa.fs.FileType.File else 0


def is_file(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type == pa.fs.FileType.File


def append(uri: str, head: bytes, data: bytes) -> None:
    """Data at the end of a file, after the head where the file is new; for stores that can append."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    new = fs.get_file_info(path).type == pa.fs.FileType.NotFound
    with fs.open_append_stream(path, compression=None) as f:
        f.write((head if new else b"") + data)


def append_at(uri: str, offset: int, data: bytes) -> int:
    """Let data be what a file has from an offset on, by appending what it lacks; how much that was.

    So a second attempt finishes what the first has begun, and adds nothing to
    what it has finished.  For stores that can append.
    """
    fs, path = opened(uri)
    there = size(uri)
    if there < offset:
        raise ValueError(f"{uri} has {there} bytes, and {offset} were there")
    held = b"".join(read_from(uri, offset)) if there > offset else b""
    if held[: len(data)] != data[: len(held)]:
        raise ValueError(f"{uri} has other data from byte {offset} on")
    rest = data[len(held) :]
    if rest:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_append_stream(path, compression=None) as f:
            f.write(rest)
    return len(rest)


def listed(uri: str, suffix: str = "") -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files in a folder itself, and (path, -1) of the folders in it; nothing where there is none."""
    fs, path = opened(uri)
    at = uri.rstrip("/")
    for i in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        if i.type == pa.fs.FileType.Directory:
            yield f"{at}/{i.base_name}", -1
        elif i.type == pa.fs.FileType.File and i.base_name.endswith(suffix):
            yield f"{at}/{i.base_name}", i.size


def names(uri: str) -> list[str]:
    """The names of what is in a folder; nothing where there is none."""
    fs, path = opened(uri)
    return [i.base_name for i in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True))]


def folders(uri: str) -> list[str]:
    """The names of the folders in a folder."""
    fs, path = opened(uri)
    return [i.base_name for i in fs.get_file_info(pa.fs.FileSelector(path)) if i.type == pa.fs.FileType.Directory]


def remove(uri: str) -> None:
    """A folder goes with what is in it; none there is no error."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type == pa.fs.FileType.Directory:
        fs.delete_dir(path)
