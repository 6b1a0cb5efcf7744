"""Arrays as small bytes, and named bytes as files of the shared folder."""

from __future__ import annotations

import io
import uuid

import numpy as np
import zstandard

from . import common


def packed(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: planes of zeros cost nothing."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpacked(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def sorted_packed(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)))


def sorted_unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def store(folder: str, name: str | None = None, **arrays: bytes) -> str:
    """Write named bytes to a file of the folder; its name, a new one unless given.

    A file of a given name is written aside and then moved, so that it is whole for all who read it; who writes it once
    more, such as a task that is run again, must write the same.
    """
    system, root = common.byte_files(folder)
    system.create_dir(root, recursive=True)
    aside, out = uuid.uuid4().hex, io.BytesIO()
    np.savez(out, **{k: np.frombuffer(v, np.uint8) for k, v in arrays.items()})
    with system.open_output_stream(f"{root}/{aside}", compression=None) as sink:
        sink.write(out.getbuffer())
    if name is None:
        return aside
    try:
        system.move(f"{root}/{aside}", f"{root}/{name}")
    except OSError:  # some file systems move onto no file that is there
        if not system.get_file_info(f"{root}/{name}").is_file:
            raise
        system.delete_file(f"{root}/{aside}")
    return name


def stored(folder: str, name: str) -> dict[str, bytes]:
    system, root = common.byte_files(folder)
    with system.open_input_file(f"{root}/{name}") as source:
        got = np.load(io.BytesIO(source.read()))
        return {k: got[k].tobytes() for k in got.files}
