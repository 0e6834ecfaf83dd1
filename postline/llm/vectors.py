"""Helpers for tables of vectors: matrices out of Arrow lists, and exact sums of integers of any size across tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Exact sums travel between tasks as digits of this many bits, so that Spark can add them up as longs.
LIMB = 40


def finite_blocks(column: pa.Array, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, float64 matrix) of the lists whose entries are all finite, in blocks of one length each; nulls are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dim in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == dim)
        for at in range(0, len(own), rows):
            part = own[at : at + rows]
            x = flat[starts[part][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1)
            if good.any():
                yield part[good], x[good]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer of any size; digits of equal place add up across tasks."""
    place, sign = 0, -1 if value < 0 else 1
    value = abs(value)
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1


def whole(digits: dict[int, int]) -> int:
    """The integer whose digits by place were added up."""
    return sum(int(v) << (LIMB * place) for place, v in digits.items())


def list_array(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow array of lists."""
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel(), type=kind))


def fits_long(value: int) -> int | None:
    """The value, or null where a long can't hold it."""
    return value if -(1 << 63) <= value < 1 << 63 else None
