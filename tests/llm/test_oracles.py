import random

import duckdb
from tests.llm.conftest import SF, rows_of

from fieldsift.llm import queries


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(tuple, plain.itertuples(index=False, name=None)), key=repr)


def test_sql_agrees_on_the_given_tables(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(sql).df()), name


def test_secret_sql_agrees_on_planted_secrets(spark, odd, tmp_path):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n, a=b64: "".join(rng.choice(a) for _ in range(n))
    texts = [f"é {key(rng.randrange(10, 70))} x {key(rng.randrange(10, 60), '0123456789ABCDEF')} token={key(9)}" for _ in range(60)]
    texts += ["secret='" + key(30) + "' " + key(50) + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + key(44), "PASSWORD: x AKIA" + "Q7" * 10, "a" * 30, None, ""]
    spark.createDataFrame(rows_of(texts), odd.schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_secrets"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(queries.ORACLE_SQL["op1_secrets"]).df())
    assert got.n_entropy.sum() > 20
