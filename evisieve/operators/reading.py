"""Lines of documents as somebody may see them: keys and credentials masked, a bounded number at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redact import mask_keys_udf, redact_udf

MOST_LINES = 201


def line_window(docs: DataFrame, start: int = 1, end: int | None = None, most: int = MOST_LINES) -> DataFrame:
    """`docs` (text and others) with total_lines, shown (how many lines) and `text` cut to lines start to end, `most` at most.

    A newline at the end doesn't begin another line; a null text has none. Private keys are masked in the whole text, as a
    block may begin outside the window, credentials in what is shown. text is null where a document has no such lines;
    the first line of an empty one is empty.
    """
    last = min(end or start + most - 1, start + most - 1)
    lines = F.split(mask_keys_udf(F.coalesce("text", F.lit(""))), "\n", -1)
    rows = docs.withColumn("__lines", lines)
    rows = rows.withColumn("__lines", F.when(F.element_at("__lines", -1) == "", F.slice("__lines", F.lit(1), F.size("__lines") - 1)).otherwise(F.col("__lines")))
    rows = rows.withColumn("total_lines", F.size("__lines"))
    there = (F.lit(start) <= F.greatest(F.lit(1), F.col("total_lines"))) & F.lit(last >= start)
    own = F.slice("__lines", F.lit(start), F.lit(max(0, last - start + 1)))
    rows = rows.withColumn("shown", F.when(there, F.greatest(F.lit(1), F.size(own))).otherwise(0))
    return rows.withColumn("text", F.when(there, redact_udf(F.array_join(own, "\n"))["text"])).drop("__lines")
