"""Single files by path or URI: on this machine, or in any store that Arrow's file systems know."""

from __future__ import annotations

from typing import BinaryIO


def open_for(path: str, writing: bool = False) -> BinaryIO:
    if "://" not in path:
        return open(path, "wb" if writing else "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if not writing:
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)
