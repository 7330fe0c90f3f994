"""Column functions and plain-Python formulas."""

from sievelight.functions.bounds import expected_precision, published_estimate
from sievelight.functions.numeric import FIXED_ONE, MatrixMeta, fixed_point, levels, quantized, to_half, to_int8, truncated

__all__ = ["FIXED_ONE", "MatrixMeta", "expected_precision", "fixed_point", "levels", "published_estimate", "quantized", "to_half", "to_int8", "truncated"]
