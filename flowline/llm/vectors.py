"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def usable(vector) -> F.Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equal lengths as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)
