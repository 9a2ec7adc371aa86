"""Evidence stored by day: the newest rows are found and read without touching the history behind them."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.scale import attach, small_table

DAY_SECONDS = 86400.0


@dataclass(frozen=True)
class DayTable:
    """A Parquet folder with a partition per day of the time column ``at`` (epoch seconds)."""

    path: str
    at: str

    def append(self, rows: DataFrame) -> None:
        days = rows.withColumn("day", F.floor(F.col(self.at) / DAY_SECONDS).cast("int")).hint("rebalance", F.col("day"))
        days.write.mode("append").partitionBy("day").parquet(self.path)

    def days(self, spark: SparkSession) -> list[int]:
        """The days there are, newest first, from the names of the partitions; no data is read."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return sorted((int(n.split("=")[1]) for n in names if n.startswith("day=")), reverse=True)

    def read(self, spark: SparkSession, since: float | None = None) -> DataFrame:
        """The rows after the time ``since``; older days are not read."""
        rows = spark.read.parquet(self.path)
        if since is not None:
            rows = rows.where((F.col("day") >= int(since // DAY_SECONDS)) & (F.col(self.at) > F.lit(float(since))))
        return rows.drop("day")

    def newest(
        self, spark: SparkSession, keys: Sequence[str], wanted: DataFrame, known: DataFrame | None = None,
    ) -> DataFrame:
        """The newest time ``_top`` of every group in ``wanted`` that has a row: ``keys`` and ``_top``.

        Days are read newest first, twice as many at each step, until every wanted group has been seen, so groups that are in use
        cost the newest days only. ``known`` is what an earlier call gave: days before its newest time are then only searched for
        groups it lacks (rows of a group that come later than that with an older time are not looked for). One small aggregate
        runs per step; what it leaves is one row per group.
        """
        days, found, begin, step = self.days(spark), [], 0, 1
        missing = small_table(wanted.select(*keys).distinct())
        mark = None if known is None else known.agg(F.max("_top")).first()[0]
        while begin < len(days) and not missing.isEmpty():
            if mark is not None and days[begin] < mark // DAY_SECONDS:
                tops, mark = small_table(attach(known.select(*keys, "_top"), missing, keys, "left_semi")), None
            else:
                part = [d for d in days[begin : begin + step] if mark is None or d >= mark // DAY_SECONDS]
                rows = spark.read.parquet(self.path).where(F.col("day").between(part[-1], part[0]))
                tops = small_table(attach(rows, missing, keys, "left_semi").groupBy(*keys).agg(F.max(self.at).alias("_top")))
                begin, step = begin + len(part), step * 2
            found.append(tops)
            missing = small_table(attach(missing, tops, keys, "left_anti"))
        return reduce(DataFrame.unionByName, found) if found else missing.withColumn("_top", F.lit(None).cast("double"))
