"""What the wide stream stores and exchanges."""

from pathlib import Path

from catalog import jobs as catalog_jobs

SF = "/root/testdata/sf0.001"


def test_a_wide_stream_takes_little_disk(spark, tmp_path, monkeypatch):
    """Stored files and all that is exchanged: less than a vector of 118 numbers for each event."""
    monkeypatch.setattr(catalog_jobs, "scratch", lambda spark, name: str(tmp_path / name))
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert catalog_jobs.QUERIES["stream_assemble_wide"](spark, SF).count() == events
    files = [f for part in ("arriving", "out") for f in Path(tmp_path, "wide", part).rglob("*.parquet")]
    assert files
    assert sum(f.stat().st_size for f in files) + written() - before < events * 118 * 8
