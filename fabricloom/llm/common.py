"""Helpers shared by the operators: staged tables, batch slicing, distributed row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Staged, delete, passing_path  # noqa: F401

#: The space characters between words: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


class Scratch:
    """Writes tables like staged(), and drops all of them at once when their last reader is done."""

    def __init__(self):
        self.tables: list[Staged] = []

    def __call__(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """folders: columns whose values get a folder each."""
        self.tables.append(Staged(df, name, *folders))
        return self.tables[-1].df

    def drop(self) -> None:
        for table in self.tables:
            table.drop()
        self.tables = []


#: Rows at most of a batch that goes to Python: Spark's own 10,000 would be gigabytes of long texts.
BATCH_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Has the session hand rows to Python in batches that long texts can't make too large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batch, column: str, limit: int = 2_000_000):
    """Cuts an Arrow record batch where the bytes of a string column would pass the limit; a longer text stands alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def with_rank(df: DataFrame, groups: list[str], rank: str, name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, though one group may hold most rows.

    The rows are staged with the number of the task that made them; each (group, task) is numbered by
    itself and moved up by what earlier tasks hold of the group, so no task ever sees a whole group.
    """
    marked = staged(df.withColumn("_row", F.monotonically_increasing_id()), name)
    marked = marked.withColumn("_task", F.shiftright("_row", 33))
    keys = [*groups, "_task"]
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = marked.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_row")))
    return (
        numbered.join(counts, keys)
        .withColumn(rank, F.col("_before") + F.col("_i") - 1)
        .drop("_row", "_task", "_i", "_before")
    )


def aside(docs: DataFrame, text: str = "text"):
    """Documents under names that no operator uses, but for doc_id and the text, and a function that selects
    their columns again under their own names, in their order."""
    names = [c if c in ("doc_id", text) else f"_column_{k}" for k, c in enumerate(docs.columns)]

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

    return docs.toDF(*names), restore


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used, also for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: its runs of characters other than SPACES. Null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
