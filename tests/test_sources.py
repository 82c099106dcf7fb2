import json

import pytest
from pyspark.sql import functions as F

from strandline.sources import readers as R
from strandline.sources import sinks as W
from strandline.sources import token_files as P


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SMILES,y\n CC ,1.5\n,2\nCO,nan\nCN,1e3\n")
    path = str(tmp_path / "a.csv")
    assert [r.value for r in R.csv_column(spark, path, "SMILES", 2).collect()] == [" CC ", None]
    with pytest.raises(R.SchemaError):
        R.csv_column(spark, path, "nope")
    df = spark.read.csv(path, header=True)
    assert [tuple(r) for r in R.labelled(df, "SMILES", "y").collect()] == [("CC", 1.5), ("CN", 1000.0)]
    assert [tuple(r) for r in R.labelled(df, "SMILES", "y", 1).collect()] == [("CC", 1.5)]
    assert tuple(R.dropped(df, "SMILES", "y").first()) == (4, 1, 1, 2)


def test_required_columns():
    columns = ["a", "x.f0", "x.f1", "y.f0"]
    assert R.require_columns(columns, ["a"], {"x.": 2, "y.": 1})["x."] == ["x.f0", "x.f1"]
    for required, groups in ((["b"], {}), ([], {"x.": 3})):
        with pytest.raises(R.SchemaError):
            R.require_columns(columns, required, groups)


def test_wide_records(spark):
    df = spark.createDataFrame([(" t ", "1", "bad", "x", "RED", "k", "2", "oops"), ("u", "no", "1", "1", "a", "k", "1", "1")], "s string, y string, std string, n string, r string, k string, `d.0` string, `d.1` string")
    (row,) = R.wide_records(df, "s", "y", "std", "n", "r", "k", ["d.0", "d.1"]).collect()
    assert row[:6] == ("t", 1.0, 0.0, 1, "red", "k") and row.descriptors[0] == 2.0 and row.descriptors[1] != row.descriptors[1]


def test_text_files(spark, tmp_path):
    for name, text in (("a", "1\n\n2\n"), ("b", "3\n \n4\n5\n")):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in "ab"]
    assert [r.value for r in R.text_files(spark, paths).orderBy("file_no", "line_no").collect()] == list("12345")
    assert [r.value for r in R.text_files(spark, paths, skip=2, limit=4).orderBy("file_no", "line_no").collect()] == list("234")
    assert sorted(r.value for r in R.text_lines(spark, paths).collect()) == list("12345")


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"source": "a", "n": 1}\nnot json\n{"n": 2}\n{"source": " "}\n')
    rows = R.json_records(spark, str(tmp_path / "x.jsonl"), "source string, n long").collect()
    assert [r.n for r in rows] == [1, 2, None]
    df = spark.createDataFrame([('{"a": "x"}',), ("{broken",), ('{"a": "  "}',), ('{"b": 1}',)], "j string")
    assert [r.value for r in R.json_field(df, "j", "a").collect()] == ["x"]
    p = spark.createDataFrame([('{"target": "q", "source": "[A]"}',), ('{"source": "zz"}',)], "j string")
    assert [r.x for r in p.select(R.probe(p, "j", ["pselfies", "target", "source"], r"^\[").alias("x")).collect()] == ["[A]", None]


def test_token_corpus(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4])], "row_id long, ids array<int>")
    path = str(tmp_path / "c")
    assert W.write_token_corpus(df, path, extra={"tokenizer_sha256": "abc"}) == {"n_sequences": 2, "n_tokens": 4, "dtype": "uint16", "tokenizer_sha256": "abc"}
    assert sorted((r.row_id, r.n_tokens) for r in W.read_token_corpus(spark, path, "abc").collect()) == [(0, 3), (1, 1)]
    with pytest.raises(ValueError):
        W.read_token_corpus(spark, path, "other")
    for bad in ([], [70_000], [-1]):
        with pytest.raises(Exception, match="out of range"):
            W.write_token_corpus(spark.createDataFrame([(0, bad)], "row_id long, ids array<int>"), str(tmp_path / "bad"))


def test_hash_index(spark, tmp_path):
    df = spark.createDataFrame([(5,), (3,), (5,), (None,)], "h long")
    path = str(tmp_path / "i")
    assert W.write_hash_index(df, "h", path, "canonical")["n_entries"] == 2
    assert [r.h for r in R.hash_index(spark, path).orderBy("h").collect()] == [3, 5]
    assert R.index_space(spark, path) == "canonical"
    with pytest.raises(R.SchemaError):
        R.index_space(spark, path, "psmiles")
    df.select("h").write.mode("append").parquet(f"{path}/hashes")
    with pytest.raises(R.SchemaError):
        R.hash_index(spark, path)


def test_splits_and_chunks(spark, tmp_path):
    good = spark.createDataFrame([(0, i, "train" if i else "test") for i in range(4)], "split_no long, row_id long, part string")
    R.check_frozen_splits(good, 4)
    for bad in (good.where("row_id < 3"), good.unionByName(spark.createDataFrame([(0, 1, "test")], good.schema))):
        with pytest.raises(R.SchemaError):
            R.check_frozen_splits(bad, 4)
    path = str(tmp_path / "chunks")
    for chunk, n in ((0, 3), (1, 2), (1, 4)):  # the second try of chunk 1 replaces the first
        W.append_chunk(spark.range(n), path, chunk)
    assert spark.read.parquet(path).count() == 7
    W.write_splits(good, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("part = 'train'").count() == 3


def test_guards_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(i, i > 0) for i in range(10)], "id long, ok boolean")
    assert W.guard_drop(df, "ok", 0.1) is df
    with pytest.raises(ValueError):
        W.guard_drop(df, "ok", 0.05)
    with pytest.raises(ValueError):
        R.nonempty(df.where("false"), "it")
    W.write_report({"b": 1, "a": None}, df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r/metrics")).first().value) == {"a": None, "b": 1}
    wide = W.log_metrics(df.select("id"), df)
    assert wide.columns == ["id", "ok"] and wide.where("ok IS NULL").count() == 10
    W.write_lines(df.select(F.col("id").cast("string").alias("v"), "id"), "v", "id", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 10


def test_packed_token_files(spark, tmp_path):
    rows = [[i % 300 + 1] * (i % 7 + 1) for i in range(50)]
    prefix = str(tmp_path / "corpus")
    P.write_packed(rows, prefix)
    spark.dataSource.register(P.PackedTokens)
    got = spark.read.format("packed_tokens").option("rowsPerPartition", "7").load(prefix)
    assert got.rdd.getNumPartitions() == 8
    assert [r.ids for r in got.orderBy("row_id").collect()] == rows
    for bad in ([[]], [[70_000]]):
        with pytest.raises(ValueError):
            P.write_packed(bad, prefix)


def test_adopt_and_archive(tmp_path):
    from strandline.sources import adopt as A

    path = str(tmp_path / "f.csv")
    with pytest.raises(A.ConfirmationNeeded):
        A.adopt(path, "f", large=True)
    with pytest.raises(FileNotFoundError):
        A.adopt(path, "f")
    first = A.adopt(path, "f", large=True, confirmed=True, fetch=lambda p: open(p, "w").write("x") and None)
    assert first["bytes"] == 1 and A.adopt(path, "f") == first
    open(path, "w").write("xy")
    assert A.adopt(path, "f")["sha256"] != first["sha256"]
    assert A.archive(path, "s").endswith("f.s.csv") and A.archive(path, "s") is None
    open(path, "w").close()
    assert A.archive(path, "s").endswith("f.s.1.csv")
