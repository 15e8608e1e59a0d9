"""Random columns; the same seed and partitioning give the same values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rand_col(kind: str, seed: int) -> Column:
    """u uniform, n normal, e exponential, c Cauchy, l Laplace, p Pareto (exponent 1), s sign."""
    u = F.rand(seed)
    if kind == "l":
        return F.when(F.rand(seed + 1) < 0.5, F.ln(1 - u)).otherwise(-F.ln(1 - u))
    return {"u": u, "n": F.randn(seed), "e": -F.ln(1 - u), "c": F.tan(math.pi * (u - 0.5)), "p": 1 / (1 - u), "s": F.when(u < 0.5, -1.0).otherwise(1.0)}[kind]
