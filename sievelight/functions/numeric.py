"""Numbers: matrix shapes, quantisers, fixed point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 1.0 in fixed point with 26 fraction bits.
FIXED_ONE = 1 << 26


@dataclass(frozen=True)
class MatrixMeta:
    """Shape of a matrix; kept apart from its entries, as trailing rows and columns may be empty."""

    rows: int
    cols: int
    nnz: int

    @property
    def density(self) -> float:
        return self.nnz / (self.rows * self.cols) if self.rows and self.cols else 0.0


def levels(bits: int, symmetric: bool = True) -> int:
    """The multiplier of a ``bits``-wide quantiser: half the range if symmetric (31 for 6 bits), else all of it (63)."""
    full = (1 << bits) - 1
    return full // 2 if symmetric else full


def quantized(val: Column, largest: Column, bits: int = 6, scheme: str = "dense", symmetric: bool = True) -> Column:
    """Integers from ``val``, rounded half to even.

    dense: scaled by ``largest`` to the levels M, within -M-1 and M. csr: scaled to 2**bits / 2 less a half (31.5 for 6
    bits), within the signed range. fixed: not scaled by ``largest``; 2**(bits-2) times the value, towards zero.
    """
    if scheme == "fixed":
        return truncated(val * float(1 << (bits - 2))).cast("int")
    if scheme == "csr":
        half, top = ((1 << bits) - 1) / 2, (1 << (bits - 1)) - 1
        scaled = F.rint(F.lit(half) * (val / largest))
    elif scheme == "dense":
        top = levels(bits, symmetric)
        scaled = F.rint(F.lit(float(top)) * (val / largest))
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return F.greatest(F.lit(-top - 1), F.least(F.lit(top), scaled)).cast("int")


def truncated(x: Column) -> Column:
    """Towards zero, still a double."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def fixed_point(val: Column) -> Column:
    """Fixed point with 26 fraction bits, towards zero. Sums are exact whatever their order."""
    return (val * float(FIXED_ONE)).cast("bigint")


def to_int8(val: Column) -> Column:
    """Towards zero; outside of -128 to 127 the nearest of the two."""
    return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), truncated(val))).cast("tinyint")


def to_half(val: Column) -> Column:
    """Rounded to half precision, half to even, as a float: Spark has no such type. 10 bits follow the first, down to
    steps of 2**-24; from 65520 on it is infinite."""
    x = val.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    near = F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x / step) * step)
    return F.when(F.abs(near) >= 65520, F.signum(near) * float("inf")).otherwise(near).cast("float")
