"""Arrow batches to Python values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def column_list(c: pa.Array) -> list:
    """What ``to_pylist`` gives, an order of magnitude sooner for texts, numbers and booleans: no scalar object is made per value."""
    kind = c.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return c.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return c.to_pylist()
    if not c.null_count:
        return c.to_numpy(zero_copy_only=False).tolist()
    out = c.fill_null(pa.scalar(0).cast(kind)).to_numpy(zero_copy_only=False).astype(object)
    out[c.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


def column_lists(batch: pa.RecordBatch) -> list[list]:
    return [column_list(c) for c in batch.columns]
