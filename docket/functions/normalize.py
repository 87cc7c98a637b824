"""Unicode normalisation: Spark has no built-in, so an Arrow-batched function does it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _form(form: str):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return run


def nfc(text: Column) -> Column:
    """Canonical composition; full-width characters stay."""
    return _form("NFC")(text)


def nfkc(text: Column) -> Column:
    """Compatibility composition."""
    return _form("NFKC")(text)


def matching_key(text: Column, substitute: dict[str, str] | None = None, compatible: bool = True) -> Column:
    """NFKC, no white space, characters substituted by a map."""
    key = F.regexp_replace(nfkc(text) if compatible else text, r"(?U)\s+", "")
    substitute = substitute or {}
    return F.translate(key, "".join(substitute), "".join(substitute.values())) if substitute else key
