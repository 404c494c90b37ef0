"""Trees grown over several parts of rows, where a node has no rows in some of them."""
import numpy as np
import pytest

from actuaria.operators import boosting as B


def rows(n):
    codes = np.column_stack([np.arange(n) * 16 // n, np.arange(n) % 3]).astype(np.uint8)
    return B.Rows(codes, codes[:, 0] ** 2.0 + codes[:, 1], np.arange(n).astype(np.uint64), np.full(n, B.NO_FOLD, np.uint8))


CUTS = [np.arange(15) + 0.5, np.arange(2) + 0.5]


@pytest.mark.parametrize("slim", [0, 400])
@pytest.mark.parametrize("backwards", [False, True])
def test_a_node_may_have_no_rows_in_a_part(monkeypatch, slim, backwards):
    spec = B.Spec(rounds=3, depth=5, rate=0.3)
    some = rows(320)
    if backwards:
        some = B.Rows(*(x[::-1].copy() for x in (some.codes, some.y, some.mark, some.fold)))
    want = B.grow_batch(some, [spec], {B.NO_FOLD: 50.0}, 1024.0, CUTS, True)
    monkeypatch.setattr(B, "SLIM", slim)
    monkeypatch.setattr(B, "PART_ROWS", 20)  # a part holds one value of the first feature
    assert B.grow_batch(some, [spec], {B.NO_FOLD: 50.0}, 1024.0, CUTS, True) == want


@pytest.mark.parametrize("slim", [0, 400])
def test_sums_without_rows_are_floating_point(monkeypatch, slim):
    monkeypatch.setattr(B, "SLIM", slim)
    none = np.zeros(0, np.int64)
    g, n = B.Cells(rows(32), [16, 3]).at(none, np.zeros(0), none, 2)
    assert g.dtype == np.float64 and n.dtype.kind == "i" and g.shape == n.shape == (2, 19) and not g.any() and not n.any()
