"""Listing and opening files: local paths by Python itself, URIs (s3://, gs://, hdfs://) by pyarrow's file systems."""

from __future__ import annotations

import fnmatch
import glob
import os

from tracelode.errors import FileOpenError


def _remote(path: str):
    """(file system, path in it) of a URI, or None for a local path."""
    if "://" not in path or path.startswith("file:"):
        return None
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def open_file(path: str):
    """A binary file that can seek."""
    try:
        if (found := _remote(path)) is None:
            return open(local(path), "rb")
        return found[0].open_input_file(found[1])
    except OSError:
        raise FileOpenError(path) from None


def create_file(path: str):
    """A binary file to write; folders are made as needed."""
    if (found := _remote(path)) is None:
        os.makedirs(os.path.dirname(local(path)) or ".", exist_ok=True)
        return open(local(path), "wb")
    found[0].create_dir(found[1].rpartition("/")[0], recursive=True)
    return found[0].open_output_stream(found[1])


def delete(path: str) -> None:
    if (found := _remote(path)) is None:
        os.remove(local(path))
    else:
        found[0].delete_file(found[1])


def expand(name: str, suffix: str = ".edf") -> dict[str, int]:
    """Sizes by path of the files that a name stands for: a file, a pattern, or a folder's files of the suffix. A file that isn't there has size 0."""
    if (found := _remote(name)) is not None:
        return _expand_remote(name, *found, suffix)
    name = local(name)
    if os.path.isdir(name):
        hits = glob.glob(os.path.join(name, "**", f"*{suffix}"), recursive=True)
    else:
        hits = glob.glob(name) if glob.has_magic(name) else [name]
    return {p: os.path.getsize(p) if os.path.exists(p) else 0 for p in hits}


def _expand_remote(name: str, fs, path: str, suffix: str) -> dict[str, int]:
    from pyarrow.fs import FileSelector, FileType

    root = name[: len(name) - len(path)]
    base = path if not glob.has_magic(path) else path[: min(path.index(c) for c in "*?[" if c in path)].rpartition("/")[0]
    info = fs.get_file_info(base)
    if info.type != FileType.Directory:
        return {name: info.size or 0}
    listed = [f for f in fs.get_file_info(FileSelector(base, recursive=True)) if f.type == FileType.File]
    wanted = (lambda p: fnmatch.fnmatch(p, path)) if glob.has_magic(path) else (lambda p: p.endswith(suffix))
    return {root + f.path: f.size for f in listed if wanted(f.path)}
