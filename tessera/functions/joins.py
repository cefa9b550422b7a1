"""How tables that grow with the input are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and never broadcast.

    Tables by chunk compress so well that Spark takes millions of rows for a few MB and would gather them on the driver.
    """
    return df.hint("merge")
