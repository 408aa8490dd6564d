import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlog.coords import bundle_intervals, file_name, merged, operation_intervals, parse_pointer


@pytest.mark.parametrize(
    "spec, want",
    [("1", {1}), ("1,3,5", {1, 3, 5}), ("1-3", {1, 2, 3}), ("1,3-5,7", {1, 3, 4, 5, 7}), ("1,1,2,2", {1, 2}), ("root", {1}), ("head", {10}), ("head~3", {7}), ("~2", {8}),
     ("root,head,head~1", {1, 9, 10}), ("latest:3", {8, 9, 10}), ("head~2-head", {8, 9, 10}), ("latest:99", set(range(1, 11)))],
)
def test_bundle_ranges(spec, want):
    assert {n for a, b in bundle_intervals(spec, 10) for n in range(a, b + 1)} == want


@pytest.mark.parametrize("spec", ["11", "5-3", "1-2-3", "head~10", "~10", "head~abc", "0", "x", "1-11"])
def test_bad_bundle_ranges(spec):
    with pytest.raises(ValueError):
        bundle_intervals(spec, 10)


@pytest.mark.parametrize("spec, want", [("0", {0}), ("0,5,10", {0, 5, 10}), ("0-2", {0, 1, 2}), ("0,5-7,10", {0, 5, 6, 7, 10}), ("0,0,1,1", {0, 1})])
def test_operation_ranges(spec, want):
    assert {n for a, b in operation_intervals(spec, 1000) for n in range(a, b + 1)} == want


@pytest.mark.parametrize("spec", ["1001", "10-5", "1-2-3", "abc"])
def test_bad_operation_ranges(spec):
    with pytest.raises(ValueError):
        operation_intervals(spec, 1000)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5)), max_size=20))
def test_merged_keeps_the_set(pairs):
    spans = [(a, a + n) for a, n in pairs]
    out = merged(spans)
    assert {x for a, b in out for x in range(a, b + 1)} == {x for a, b in spans for x in range(a, b + 1)}
    assert all(b + 1 < c for (_, b), (c, _) in zip(out, out[1:]))


def test_pointers_and_names():
    assert parse_pointer("3:17") == (3, 17)
    assert parse_pointer("25") == (1, 25)
    assert parse_pointer("10000") == (2, 0)
    assert file_name(7) == "000007.jsonl.zst"
    for bad in ("0:1", "a:1", "x"):
        with pytest.raises(ValueError):
            parse_pointer(bad)
