import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wallscope.llm.grouping import suffix_array


def brute(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=800, deadline=None)
def test_equals_sorting(s):
    assert suffix_array(np.array(s, np.int64)).tolist() == brute(s)


@pytest.mark.parametrize("s", [[], [7], [1] * 300, [0, 1] * 200, [2, 1, 0] * 99, [3, 3, 9] * 50 + [3, 3]])
def test_repetitive(s):
    assert suffix_array(np.array(s, np.int64)).tolist() == brute(s)


def test_long_random():
    s = np.random.default_rng(1).integers(0, 5, 3000)
    assert suffix_array(s).tolist() == brute(s.tolist())
