"""Report windows that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import scan


def overlaps(df: DataFrame, by: Sequence[str], start: str, end: str, id_col: str) -> DataFrame:
    """Adds ``prev_end`` and ``prev_id``: the latest end among windows before this one, and whose it is (the first's on ties).

    A window overlaps if it starts before ``prev_end``.  One running maximum in order of start; no range join.  Without
    ``by`` all windows are one series, of any length.
    """
    if not by:
        # the first of equal ends has the least cell and place, hence the greatest negatives
        entry = F.struct(F.col(end), -F.col(scan.CELL), -F.col(scan.PLACE), F.col(id_col))
        out = scan.scan(df, [start, id_col], {"_held": scan.greatest(F.when(F.col(end).isNotNull(), entry))}, before=True)
        return out.select(*df.columns, F.col("_held")[end].alias("prev_end"), F.col("_held")[id_col].alias("prev_id"))
    before = Window.partitionBy(*by).orderBy(start, id_col).rowsBetween(Window.unboundedPreceding, -1)
    order = F.row_number().over(Window.partitionBy(*by).orderBy(start, id_col))
    df = df.withColumn("_n", order)
    held = F.max(F.when(F.col(end).isNotNull(), F.struct(F.col(end), -F.col("_n"), F.col(id_col)))).over(before)
    return df.withColumns({"prev_end": held[end], "prev_id": held[id_col]}).drop("_n")
