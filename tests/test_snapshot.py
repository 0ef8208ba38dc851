import pytest

from pitpanel.sources import snapshot as sn


def run(spark, root, values, **options):
    calls = []

    def pull():
        calls.append(1)
        return spark.createDataFrame([(v,) for v in values], "value bigint"), [f"u{k}" for k in range(25)]

    options = {"dataset": "d", "vintage": "v1", "licence": "open", "publication_lag": "none", "params": {"a": 1}, **options}
    return sn.snapshot(spark, root, pull=pull, **options), calls


def values(df):
    return sorted(r[0] for r in df.collect())


def test_second_call_reads_and_refresh_writes_a_revision(spark, tmp_path):
    root = str(tmp_path)
    first, calls = run(spark, root, [1, 2, 3])
    again, none = run(spark, root, [7])
    assert values(first) == values(again) == [1, 2, 3] and calls == [1] and none == []
    fresh, calls = run(spark, root, [1, 2, 99], refresh=True)
    assert values(fresh) == [1, 2, 99] and calls == [1]
    assert values(sn.read_snapshot(spark, root, "d", "v1", 0)) == [1, 2, 3]
    assert [r["restated"] for r in sn.restatements(spark, root).orderBy("revision").collect()] == [False, True]
    changes = sn.restated_rows(spark, root, "d", "v1", keys=["value"], values=[], old=0, new=1)
    assert {r["value"]: r["change"] for r in changes.collect()} == {1: "same", 2: "same", 3: "removed", 99: "added"}


def test_vintages_are_separate_and_provenance_is_complete(spark, tmp_path):
    root = str(tmp_path)
    run(spark, root, [1])
    run(spark, root, [2], vintage="v2")
    assert values(sn.read_snapshot(spark, root, "d", "v1")) == [1] and values(sn.read_snapshot(spark, root, "d", "v2")) == [2]
    row = sn.latest_provenance(spark, root, "d", "v2")
    assert (row["rows"], row["request_count"], len(row["source_urls"]), row["params"]) == (1, 25, 25, {"a": "1"})
    assert sn.latest_provenance(spark, root, "other", "v1") is None
    with pytest.raises(LookupError):
        sn.read_snapshot(spark, root, "other", "v1")


def test_hash_ignores_order_and_partitions_but_not_content(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as g", "cast(id as string) s")
    base = sn.content_hash(df).first()
    assert sn.content_hash(df.repartition(7).select("s", "g", "id")).first() == base
    assert sn.content_hash(df.union(df.limit(1))).first()["content_hash"] != base["content_hash"]
    assert sn.content_hash(df.filter("id < 0")).first()["rows"] == 0


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_sinks(spark, tmp_path, fmt):
    sn.write_table(spark.range(5), str(tmp_path / fmt), fmt=fmt)
    reader = spark.read.option("header", True)
    assert getattr(reader, fmt)(str(tmp_path / fmt)).count() == 5
