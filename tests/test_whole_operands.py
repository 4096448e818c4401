"""The products over whole operands: every cell of both tables takes part, against NumPy."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from latticeframe import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense():
    read = lambda name: pq.read_table(f"{DATA}/{name}.parquet").to_pandas()
    lines, events = read("lineitem"), read("events")
    t = np.zeros((read("part").p_partkey.max() + 1, read("supplier").s_suppkey.max() + 1))
    np.add.at(t, (lines.l_partkey, lines.l_suppkey), lines.l_quantity)
    x = np.zeros((events.user_id.max() + 1, len(q.TYPES), 31))
    np.add.at(x, (events.user_id, events.event_type.map(q.TYPES.index), events.ts.dt.day - 1), 1)
    return t, x


def cells(spark, name, shape):
    rows = q.QUERIES[name](spark, DATA).toPandas()
    out = np.zeros(shape)
    out[tuple(rows[f"d{i}"] for i in range(len(shape)))] = rows.v
    return out


def test_products_take_whole_operands(spark, dense):
    t, x = dense
    w = x.sum((0, 2))
    assert np.array_equal(cells(spark, "outer", (*t.shape, 5)), np.multiply.outer(t, w))
    assert np.array_equal(cells(spark, "kron", (t.shape[0], t.shape[1] * 5)), np.kron(t, w[None]))
    assert np.array_equal(cells(spark, "einsum_chain", (5, 5)), np.einsum("utd,ute,se,rd->rs", x, x, x.sum(0), x.sum(0), optimize=True))
