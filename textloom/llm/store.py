"""Array files in the shared folder, mapped into memory where they are used.

A file is written under a name of its own and only then reported, so one that a lost executor left half done is never
read. On a store without local paths a reader fetches the file once, maps it and unlinks it at once.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile

import numpy as np

from textloom.llm.common import local_path

_ALIGN = 64


def save_arrays(uri: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    layout, at = {}, 0
    for name, a in arrays.items():
        at = -(-at // _ALIGN) * _ALIGN
        layout[name] = (at, a.dtype.str, len(a))
        at += a.nbytes
    head = json.dumps({"arrays": layout, "meta": meta}).encode()
    start = -(-(8 + len(head)) // _ALIGN) * _ALIGN

    def write(f) -> None:
        f.write(len(head).to_bytes(8, "little") + head)
        done = 8 + len(head)
        for name, a in arrays.items():
            to = start + layout[name][0]
            f.write(bytes(to - done))
            f.write(np.ascontiguousarray(a).data.cast("B") if a.nbytes else b"")
            done = to + a.nbytes

    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            write(f)
    else:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(inside), recursive=True)
        with store.open_output_stream(inside) as f:
            write(f)


def open_input(uri: str):
    """A seekable file in whatever store it is."""
    path = local_path(uri)
    if path:
        return open(path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inside)


def open_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    path, fetched = local_path(uri), None
    if not path:
        import shutil

        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(uri)
        handle, path = tempfile.mkstemp()
        fetched = path
        with os.fdopen(handle, "wb") as f, store.open_input_stream(inside) as g:
            shutil.copyfileobj(g, f, 1 << 20)
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    if fetched:
        os.unlink(fetched)
    n = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + n])
    start = -(-(8 + n) // _ALIGN) * _ALIGN
    return {name: np.frombuffer(data, np.dtype(kind), length, start + at) if length else np.empty(0, np.dtype(kind)) for name, (at, kind, length) in head["arrays"].items()}, head["meta"]
