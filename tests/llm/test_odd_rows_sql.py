"""op3 and op8 on odd rows against their own SQL, and op10 on odd rows by value."""

import zlib

import duckdb
import pytest

from tests.llm.test_contracts import odd  # noqa: F401
from weftline.llm import mixing, toxicity, urlfilter


@pytest.mark.parametrize("module", [mixing, urlfilter], ids=["op3", "op8"])
def test_sql_on_odd_rows(spark, odd, module):  # noqa: F811
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{odd}/{name}.parquet/*.parquet'")
    found = con.execute(module.ORACLE_SQL)
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in module.contract(spark, odd).collect())


def test_op10_on_odd_rows(spark, odd):  # noqa: F811
    rows = toxicity.contract(spark, odd).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    texts = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()}
    blank = {i for i, t in texts if i is not None and not (t or "").strip() and sum(j == i for j, _ in texts) == 1}
    scores = {r["score"] for r in rows if r["doc_id"] in blank}
    assert len(scores) == 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
