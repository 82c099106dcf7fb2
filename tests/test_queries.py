"""Every query of the library against its SQL, and rows-only checks for those without."""

import os
import random
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import strandline.registry as registry

from . import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no testdata")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.ALIASES)))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = df.toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("name", ["accuracy", "ensemble_leakage", "tg_reward"])
def test_repeated_lines_in_the_order_of_the_table(spark, tmp_path, name):
    """Several rows of a line, in two files, met by a join that shuffles: the first row's target counts."""
    rng = random.Random(3)
    parts = pa.table({"p_partkey": list(range(50)), "p_retailprice": [900.0 + 7.25 * k for k in range(50)]})
    kinds = {"l_orderkey": 60, "l_partkey": 50, "l_suppkey": 9, "l_linenumber": 7}
    (tmp_path / "lineitem.parquet").mkdir()
    pq.write_table(parts, tmp_path / "part.parquet")
    for file in ("a", "b"):
        rows = {k: [rng.randrange(n) + 1 if k == "l_linenumber" else rng.randrange(n) for _ in range(500)] for k, n in kinds.items()}
        rows |= {"l_quantity": [float(rng.randint(1, 50)) for _ in range(500)], "l_extendedprice": [rng.randint(100000, 9000000) / 100 for _ in range(500)]}
        rows |= {"l_returnflag": ["R"] * 500, "l_linestatus": ["F"] * 500, "l_shipdate": [datetime(2000, 1, 1)] * 500}
        table = pa.table(rows)
        pq.write_table(table.set_column(3, "l_linenumber", table["l_linenumber"].cast("int32")), tmp_path / "lineitem.parquet" / f"{file}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # several make any_value whatever they meet first
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert oracle.rows(got) == oracle.rows(con.execute(registry.oracle_sql()[name]).df())


def _odd_lines(spark, folder, name, files, n=400, targets=lambda x: x, numbers=range(1, 8)):
    """The query over lines with odd values in files of these names, and its SQL on one thread."""
    rng = random.Random(9)
    pq.write_table(pa.table({"p_partkey": list(range(50)), "p_retailprice": [900.0 + 7.25 * k for k in range(50)]}), folder / "part.parquet")
    (folder / "lineitem.parquet").mkdir()
    for file in files:
        rows = {"l_orderkey": [rng.randrange(80) for _ in range(n)], "l_partkey": [rng.randrange(50) for _ in range(n)], "l_suppkey": [1] * n}
        rows |= {"l_linenumber": pa.array([rng.choice(numbers) for _ in range(n)], "int32"), "l_quantity": [float(rng.randint(1, 50)) for _ in range(n)]}
        rows |= {"l_extendedprice": [targets(rng.randint(100000, 9000000) / 100) for _ in range(n)], "l_returnflag": ["R"] * n, "l_linestatus": ["F"] * n, "l_shipdate": [datetime(2000, 1, 1)] * n}
        pq.write_table(pa.table(rows), folder / "lineitem.parquet" / f"{file}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return oracle.rows(registry.queries()[name](spark, str(folder)).toPandas()), oracle.rows(con.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["ensemble_leakage", "tg_reward"])
def test_line_numbers_without_a_prediction(spark, tmp_path, name):
    got, want = _odd_lines(spark, tmp_path, name, ["a"], numbers=[None, *range(10)])
    assert got == want


def test_leakage_over_lines_without_a_target(spark, tmp_path):
    got, want = _odd_lines(spark, tmp_path, "ensemble_leakage", ["a"], targets=lambda x: None if int(x) % 3 == 0 else x)
    assert got == want


@pytest.mark.parametrize("name", ["ensemble_leakage", "tg_reward"])
def test_repeated_lines_in_the_order_of_file_names(spark, tmp_path, name):
    """A blank comes before an exclamation mark, its escape behind it."""
    got, want = _odd_lines(spark, tmp_path, name, ["x!y", "x y", "p+q", "z%20", "z 1"])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
