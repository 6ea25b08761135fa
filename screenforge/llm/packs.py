"""Columns of numbers as one compressed value, so that a row of Spark carries a block of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard


def pack(columns: Sequence[np.ndarray]) -> bytes:
    """Equally or differently long arrays as Arrow record batches, one each, compressed."""
    sink = pa.BufferOutputStream()
    for c in columns:
        batch = pa.RecordBatch.from_arrays([pa.array(c)], names=["c"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, in order."""
    source, out = pa.BufferReader(blob), []
    while source.tell() < source.size():
        out.append(pa.ipc.open_stream(source).read_all().column(0).combine_chunks().to_numpy(zero_copy_only=False))
    return out


def squeeze(rows: np.ndarray) -> bytes:
    """A table of integers, a column each row of ``rows``, byte by byte; the first column as steps, so it is best in order."""
    rows = np.array(rows, np.int64, order="C")
    rows[0, 1:] -= rows[0, :-1].copy()
    planes = rows.view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1)
    return rows.shape[0].to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    """The table of ``squeeze``."""
    width = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    rows = planes.reshape(width, 8, -1).transpose(0, 2, 1).copy(order="C").view(np.int64).reshape(width, -1)
    rows[0] = np.cumsum(rows[0])
    return rows
