"""Arrays as files of the shared folder: written once by a task, memory-mapped by workers.

A folder on a mounted file system is mapped in place. From any other store a file is copied once into an unnamed temporary
file of the worker, which is mapped and vanishes with the worker.
"""

from __future__ import annotations

import io
import mmap
import os
import tempfile
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs

_MAPPED: dict[str, dict[str, np.ndarray]] = {}
#: Models that a worker keeps mapped.
KEPT_MODELS = 2


def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return (u.path or folder) if u.scheme in ("", "file") else None


def put(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array; a repeated or a second attempt of a task replaces the file as a whole."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{os.getpid()}.part"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, f"{path}/{name}.npy")
        return
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    out = io.BytesIO()
    np.save(out, values)
    with store.open_output_stream(f"{path}/{name}.npy") as f:
        f.write(out.getbuffer())


def get(folder: str, name: str) -> np.ndarray:
    """The array, mapped read-only; maps are kept for the models used last."""
    if folder not in _MAPPED:
        while len(_MAPPED) >= KEPT_MODELS:
            _MAPPED.pop(next(iter(_MAPPED)))
        _MAPPED[folder] = {}
    held = _MAPPED[folder]
    if name not in held:
        if (path := _local(folder)) is not None:
            held[name] = np.load(f"{path}/{name}.npy", mmap_mode="r")
        else:
            store, path = fs.FileSystem.from_uri(folder)
            with store.open_input_stream(f"{path}/{name}.npy") as f, tempfile.TemporaryFile() as copy:
                while chunk := f.read(1 << 22):
                    copy.write(chunk)
                copy.flush()
                copy.seek(0)
                version = np.lib.format.read_magic(copy)
                shape, _, dtype = np.lib.format.read_array_header_1_0(copy) if version == (1, 0) else np.lib.format.read_array_header_2_0(copy)
                at = copy.tell()
                held[name] = np.frombuffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ), dtype, offset=at, count=shape[0])
    return held[name]
