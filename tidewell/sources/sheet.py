"""Spreadsheet values as a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_names


def sheet_to_table(df: DataFrame, row_col: str = "row_idx", values_col: str = "cells") -> DataFrame:
    """Row 0 names the columns; short rows end in NULL; everything is text.

    Only the header row comes to the driver.
    """
    header = df.where(F.col(row_col) == 0).select(values_col).first()
    if header is None:
        raise ValueError("the sheet has no header row")
    names = safe_names([re.sub(r"[^a-zA-Z0-9_]", "_", h or "column").lower() for h in header[0]])
    return df.where(F.col(row_col) > 0).select(
        *[F.get(values_col, F.lit(i)).alias(n) for i, n in enumerate(names)])
