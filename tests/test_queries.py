"""Every query of the entry point that has SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import pytest
from compare import assert_same

from veilframe import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    assert_same(queries.queries()[name](spark, small), queries.oracle_sql()[name], small)


def test_batches_write_every_customer(spark, small):
    table, counts = queries._batched(spark, queries.stored_rotated(spark, small), queries.migrate.BatchOptions())
    back = queries.codec.decrypt(table, queries.CUSTOMER, queries.NEWEST_ONLY, queries.TENANT).select("c_custkey", "c_name")
    want = spark.read.parquet(f"{small}/customer.parquet").select("c_custkey", "c_name")
    assert sorted(back.collect()) == sorted(want.collect())
    assert sum(r.migrated + r.skipped for r in counts.collect()) == want.count() > 120


def _jobs(spark, name, run):
    """Spark jobs that run starts in its thread."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_batches(spark, small):
    before = queries.stored_rotated(spark, small)
    few, many = (_jobs(spark, f"batches of {n}", lambda n=n: queries._batched(spark, before, queries.migrate.BatchOptions(n))[1].collect()) for n in (75, 10))
    assert 0 < few and many <= few + 4


def test_resumed_batches_are_written_at_once(spark, small, monkeypatch):
    from veilframe import queries_keys

    made, plain, options = [], queries_keys.written, queries.migrate.BatchOptions(10)
    monkeypatch.setattr(queries_keys, "written", lambda df, label: made.append(label) or plain(df, label))
    for name in ("planned", "batches"):  # batches of ten, so that the small table has many
        monkeypatch.setattr(queries.migrate, name, lambda *given, f=getattr(queries.migrate, name), **more: f(*given, options=options, **more))
    got = [tuple(r) for r in queries_keys.resume_batches(spark, small).collect()]
    assert [r[0] for r in got] == list(range(1, len(got) + 1)) and len(got) >= 15 and len(made) == 1
    assert all(a[2] < b[1] and a[3] + a[4] == 10 for a, b in zip(got, got[1:])) and [r[5] for r in got] == [True] * (len(got) - 1) + [False]


def test_upsert_takes_every_customer(spark, small, monkeypatch):
    seen, plain = [], queries.write.upsert
    monkeypatch.setattr(queries.write, "upsert", lambda stored, changes, *rest: seen.append(changes.count()) or plain(stored, changes, *rest))
    queries.upsert_keeps_bytes(spark, small)
    assert seen == [spark.read.parquet(f"{small}/customer.parquet").count()]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["c_custkey", "c_name"]
