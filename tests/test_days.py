"""Rows stored by day: which days are read, and that the newest rows found are those of the whole history."""

from pyspark.sql import functions as F

from proofline.sources.days import DAY_SECONDS, DayTable


def stored(spark, path):
    """Group a until day 99, b until day 90, c on day 3 alone."""
    rows = [("a", d * DAY_SECONDS + 5.0) for d in range(100)] + [("b", d * DAY_SECONDS + 7.0) for d in range(91)] + [("c", 3 * DAY_SECONDS + 1.0)]
    table = DayTable(str(path), "at")
    table.append(spark.createDataFrame(rows, "g string, at double"))
    return table


def test_newest_times(spark, tmp_path):
    table = stored(spark, tmp_path / "t")
    assert table.days(spark) == list(range(99, -1, -1))
    groups = lambda *names: spark.createDataFrame([(n,) for n in names], "g string")
    found = table.newest(spark, ["g"], groups("a", "b", "c", "none"))
    assert {tuple(r) for r in found.collect()} == {("a", 99 * DAY_SECONDS + 5), ("b", 90 * DAY_SECONDS + 7), ("c", 3 * DAY_SECONDS + 1)}
    assert table.newest(spark, ["g"], groups("none")).count() == 0
    # Later rows come; what was known before spares the search behind it.
    table.append(spark.createDataFrame([("b", 101 * DAY_SECONDS), ("d", 100 * DAY_SECONDS)], "g string, at double"))
    again = table.newest(spark, ["g"], groups("a", "b", "c", "d"), known=found)
    assert {tuple(r) for r in again.collect()} == {
        ("a", 99 * DAY_SECONDS + 5), ("b", 101 * DAY_SECONDS), ("c", 3 * DAY_SECONDS + 1), ("d", 100 * DAY_SECONDS)
    }


def test_only_the_needed_days_are_read(spark, tmp_path):
    table = stored(spark, tmp_path / "t")
    rows = table.read(spark, 97 * DAY_SECONDS + 6)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ">= 97" in plan
    assert sorted(r.at // DAY_SECONDS for r in rows.collect()) == [98, 99]
    assert table.read(spark).where(F.col("g") == "c").count() == 1
