"""Taking Arrow batches apart."""

import inspect

import pyarrow as pa
import pytest

from ledgerloom.functions.columns import column_list, column_lists
from ledgerloom.operators import assignment, textsearch

COLUMNS = [
    pa.array(["a", None, "", "é漢😀", "\0"]), pa.array(["a", None], pa.large_string()), pa.array([1, None, -(2**62) - 1]), pa.array([2**31 - 1, 0], pa.int32()),
    pa.array([0.5, None, float("inf")]), pa.array([True, False]), pa.array([True, None]), pa.array([[1], None, []]),
    pa.array([], pa.string()), pa.array([None], pa.int64()), pa.array(["x", "y", None, "z"])[1:3], pa.array([None, 7, 8, None])[1:4],
]


@pytest.mark.parametrize("column", COLUMNS, ids=lambda c: str(c.type))
def test_same_values_and_types_as_to_pylist(column):
    got, want = column_list(column), column.to_pylist()
    assert got == want and list(map(type, got)) == list(map(type, want))


def test_batches_by_column():
    assert column_lists(pa.RecordBatch.from_arrays(COLUMNS[2:3] + COLUMNS[4:5], names=["a", "b"])) == [COLUMNS[2].to_pylist(), COLUMNS[4].to_pylist()]


def test_no_scalar_per_value_where_rows_stream():
    assert "to_pylist" not in inspect.getsource(textsearch) + inspect.getsource(assignment)
