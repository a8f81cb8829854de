"""File sources and sinks."""

from __future__ import annotations

import json

from ledgerlake.sources import files


def test_json_map_and_missing_file(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"counties": {"A": {"pop": 3, "area": 1.5}, "B": {"pop": None, "area": 2.0}}}))
    got = {r["name"]: (r["pop"], r["area"]) for r in files.read_json_map(spark, str(p), "counties", "pop: bigint, area: double").collect()}
    assert got == {"A": (3, 1.5), "B": (None, 2.0)}
    assert files.read_json_map(spark, str(tmp_path / "none.json"), "counties", "pop: bigint").count() == 0


def test_records_in_three_shapes(spark, tmp_path):
    for i, doc in enumerate(({"records": [{"fields": {"k": 1}}, {"fields": {"k": 2}}]}, [{"k": 1}, {"k": 2}], {"k": 1})):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(doc))
        assert [r["k"] for r in files.read_records(spark, str(p), "k: bigint").collect()] == ([1, 2] if i < 2 else [1])


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, 'q"t')], "k int, t string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), "k int, t string").collect())) == sorted(map(tuple, df.collect()))


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, t string")
    assert files.append_new(df, path, ["k"]).count() == 2
    assert files.append_new(df, path, ["k"]).count() == 0
    more = spark.createDataFrame([(2, "x"), (3, "y")], "k int, t string")
    assert [r["k"] for r in files.append_new(more, path, ["k"]).collect()] == [3]
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_alternative_paths(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"k": 7}))
    a, b, c = (str(tmp_path / f"{x}.json") for x in "abc")
    assert [r["k"] for r in files.read_json(spark, a, "k bigint", c, b).collect()] == [7]
    assert files.read_json(spark, a, "k bigint", c).count() == 0


def test_csv_export_keeps_the_order(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, f"a,{i}") for i in range(50)], "k int, n int, t string").repartition(4)
    files.write_csv(df.orderBy("k", "n"), str(tmp_path / "t"))
    lines = [x for p in sorted((tmp_path / "t").glob("part-*.csv")) for x in p.read_text().splitlines()[1:]]
    assert lines == [f'{k},{n},"a,{n}"' for k, n in sorted((i % 3, i) for i in range(50))]
