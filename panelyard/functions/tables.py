"""Table functions for SQL: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from panelyard.operators.stats import mean_ranks, pearson


def finite(value) -> float | None:
    """A number, or a text of one; None for anything else and for what isn't finite."""
    try:
        found = None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None
    return found if found is not None and math.isfinite(found) else None


@F.udtf
class PanelScores:
    """``panel_scores(rows => TABLE(t) PARTITION BY (...), panel => 'column', prediction => 'column', reference => 'column')``

    One row a partition: the panel's column with the type that it has in the table, n, spearman_rho and pearson_r over the rows
    that hold a finite number on both sides; no row for a partition without any.  Other columns may be there.  A row whose
    prediction and reference are arrays of one length stands for as many rows (:func:`packed` makes such).
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, panel: AnalyzeArgument, prediction: AnalyzeArgument, reference: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rows must be a table")
        names = {f.name: f for f in rows.dataType.fields}
        for told in (panel, prediction, reference):
            if told.isTable or not told.isConstantExpression or told.value not in names:
                raise ValueError(f"not a column of the table: {told.value!r}")
        more = [T.StructField("n", T.LongType()), T.StructField("spearman_rho", T.DoubleType()), T.StructField("pearson_r", T.DoubleType())]
        return AnalyzeResult(T.StructType([T.StructField(panel.value, names[panel.value].dataType), *more]))

    def __init__(self):
        self.panel, self.pairs = None, []

    def eval(self, rows, panel: str, prediction: str, reference: str):
        self.panel = rows[panel]
        p, r = rows[prediction], rows[reference]
        if not (isinstance(p, list) and isinstance(r, list)):
            p, r = [p], [r]
        pairs = ((finite(a), finite(b)) for a, b in zip(p, r, strict=True))
        self.pairs.extend(pair for pair in pairs if None not in pair)

    def terminate(self):
        if self.pairs:
            x, y = np.array(self.pairs, float).T
            yield self.panel, len(x), pearson(mean_ranks(x), mean_ranks(y)), pearson(x, y)


#: Rows of a panel that :func:`packed` puts in one.
PACK_ROWS = 1000


def packed(df: DataFrame, panel: str, prediction: str, reference: str, most: int = PACK_ROWS) -> DataFrame:
    """A panel's rows put together, ``most`` in one with arrays of predictions and references: a table function in Python is called
    for each row, which costs more than the row's own work."""
    place = F.row_number().over(Window.partitionBy(panel).orderBy(F.lit(1)))
    blocks = df.select(panel, prediction, reference, F.floor((place - 1) / most).alias("_block")).groupBy(panel, "_block").agg(F.collect_list(F.struct(F.col(prediction).alias("p"), F.col(reference).alias("r"))).alias("_pairs"))
    return blocks.select(panel, F.col("_pairs.p").alias(prediction), F.col("_pairs.r").alias(reference))


def register(spark: SparkSession) -> None:
    spark.udtf.register("panel_scores", PanelScores)
