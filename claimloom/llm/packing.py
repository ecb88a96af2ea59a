"""Rows of numpy arrays sent through a shuffle as packed bytes, one value for each part and batch."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa

#: part: to which task; kind: what the rows are; packed: their bytes.
PACKED = "part long, kind int, packed binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def packed(rows: np.ndarray, part: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """(part, kind, bytes) of each part that has rows."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), kind, rows[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = ([r[i] for r in rows] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "packed"])


def unpacked(batches, kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All rows of a task, by kind."""
    found: dict[int, list] = {k: [] for k in kinds}
    for b in batches:
        for k, x in zip(b.column("kind").to_pylist(), b.column("packed").to_pylist()):
            found[k].append(np.frombuffer(x, kinds[k]))
    return {k: np.concatenate([np.empty(0, kinds[k]), *v]) for k, v in found.items()}


def by_part(batches):
    """Batches of rows that are sorted by part, as (part, an iterator of (kind, rows)), one part
    after the other, so that a task need hold one only."""

    def cells():
        for b in batches:
            part, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "kind"))
            new = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                if z > a:
                    yield int(part[a]), int(kind[a]), b.slice(a, z - a)

    for part, rows in groupby(cells(), lambda c: c[0]):
        yield part, ((k, b) for _, k, b in rows)
