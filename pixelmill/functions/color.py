"""Reversible colour transforms and integer helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of (r, g, b) that each permutation reads (fixed values).
PERMUTATIONS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
#: (permutation, type) of the short candidate bank (fixed values).
BANK = {"C6": (0, 6), "C27": (3, 6), "C12": (1, 5)}


def half(x: Column) -> Column:
    """Floor of x / 2."""
    return F.shiftright(x, 1)


def floor_div(x: Column, n: int) -> Column:
    """Floor division by a positive constant; shifts where it is a power of two."""
    if n & (n - 1) == 0:
        return F.shiftright(x, n.bit_length() - 1)
    return ((x - F.pmod(x, F.lit(n))) / n).cast("int")


def ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    co = r - b
    t = b + half(co)
    cg = g - t
    return t + half(cg), co, cg


def ycocg_inverse(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - half(cg)
    b = t - half(co)
    return b + co, cg + t, b


def rct(p: int, t: int):
    """The transform of permutation p and type t, as a function of three columns."""

    def forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
        a, m, c = ((r, g, b)[k] for k in PERMUTATIONS[p])
        if t == 6:
            return ycocg(a, m, c)
        third = c - a if t in (1, 3, 5) else c
        if t in (2, 3):
            return a, m - a, third
        if t in (4, 5):
            return a, m - half(a + c), third
        return a, m, third

    return forward


def rct_inverse(p: int, t: int):
    def backward(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        if t == 6:
            parts = ycocg_inverse(x, y, z)
        else:
            c = z + x if t in (1, 3, 5) else z
            m = y + x if t in (2, 3) else y + half(x + c) if t in (4, 5) else y
            parts = (x, m, c)
        out = [None, None, None]
        for k, v in zip(PERMUTATIONS[p], parts, strict=True):
            out[k] = v
        return tuple(out)

    return backward


def zigzag(r: Column) -> Column:
    """0, -1, 1, -2, 2 ... to 0, 1, 2, 3, 4 ..."""
    return F.when(r >= 0, 2 * r).otherwise(-2 * r - 1)


def zigzag_up(r: Column) -> Column:
    """0, 1, -1, 2, -2 ... to 0, 1, 2, 3, 4 ..."""
    return 2 * F.abs(r) - (r > 0).cast("int")
