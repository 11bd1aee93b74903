"""Files of a shared store as Python workers see them: Arrow's file systems, by URI or by plain path."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Sequence

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths and file: URIs are local or mounted folders."""
    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def listed(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files, of those that a pattern in the last part of a path matches, and of a folder's files.

    Names that begin with _ or . are left out of folders and patterns; a file that isn't there has -1 bytes.
    """
    out = []
    for path in paths:
        folder, _, last = path.rstrip("/").rpartition("/")
        pattern = last if any(c in last for c in "*?[") else None
        store, place = opened(folder if pattern else path)
        prefix = path[: len(path) - len(place)] if not pattern else path[: len(folder) - len(place)]
        info = store.get_file_info(place.rstrip("/") or "/")
        if info.type == fs.FileType.Directory:
            inside = [f for f in store.get_file_info(fs.FileSelector(info.path)) if f.is_file and f.base_name[0] not in "_." and (not pattern or fnmatch.fnmatchcase(f.base_name, pattern))]
            out += sorted((prefix + f.path, f.size) for f in inside)
        elif not pattern:
            out.append((path, info.size if info.is_file else -1))
    return out


def paths_of(options: dict[str, str]) -> list[str]:
    """The paths of a reader: `paths`, a JSON list, or `path`, what load() was given."""
    if "paths" in options:
        return json.loads(options["paths"])
    if "path" not in options:
        raise ValueError("no path was given")
    return [options["path"]]
