"""Input columns under names of their own, so that no operator's inner names clash with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns d0, d1, ..., and the new name of each old one."""
    names = {c: f"d{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(d) for c, d in names.items()]), names
