import duckdb
import pytest

from fieldsift import scale


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, None, 1.0, 9.5, 2.25, 1.0], [float(i * 37 % 101) for i in range(400)]])
def test_quantiles_equal_interpolated_ones(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    (got,) = scale.quantiles(frame, "x", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    want = [con.execute(f"SELECT quantile_cont(x, {q}) FROM t").fetchone()[0] for q in (0.0, 0.1, 0.5, 0.93, 1.0)]
    assert list(got) == pytest.approx(want, abs=1e-12)


def test_quantiles_of_nothing(spark):
    (got,) = scale.quantiles(spark.createDataFrame([], "x double"), "x", {"a": 0.5}).collect()
    assert got.a is None
