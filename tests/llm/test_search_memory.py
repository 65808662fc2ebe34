"""A deep packing search suspends one enumeration at every step: each must stay small."""

import tracemalloc

import numpy as np

from entitygraph.llm import packing


def test_suspended_fillings_are_small():
    stock = np.zeros(4097, np.int64)
    stock[1001:2400:2] = 3         # odd lengths: no two of them fill a sequence with the longest
    rest = packing.Stock(stock, 4096)
    rest.know(len(rest.lengths))
    first = next(rest.fillings())
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        held = [rest.fillings() for _ in range(50)]
        assert all(next(f) == first for f in held)
        each = (tracemalloc.get_traced_memory()[0] - before) / len(held)
    finally:
        tracemalloc.stop()
    assert each < 60_000
