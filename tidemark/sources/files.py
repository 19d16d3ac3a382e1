"""Files of any store that pyarrow knows, for data sources whose readers run without a session."""

from __future__ import annotations

from typing import Any

import pyarrow.fs


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def listed(uri: str) -> list[tuple[str, int]]:
    """(name below the folder, bytes) of the files below ``uri`` in order of name, or ('', bytes) of a file; hidden ones are none."""
    store, path = _store(uri)
    if store.get_file_info(path).type == pyarrow.fs.FileType.File:
        return [("", store.get_file_info(path).size)]
    found = store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    names = [(f.path[len(path.rstrip("/")) + 1 :], f.size) for f in found if f.type == pyarrow.fs.FileType.File]
    return sorted((name, size) for name, size in names if not any(p[0] in "._" for p in name.split("/")))


def opened(uri: str, name: str = "") -> Any:
    """A file of the folder ``uri``, open for reading anywhere."""
    store, path = _store(uri)
    return store.open_input_file(f"{path.rstrip('/')}/{name}" if name else path)
