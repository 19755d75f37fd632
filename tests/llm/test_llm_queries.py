"""Every query of the training-data operators on the smallest tables, against its SQL where there is one."""

import glob
import os

import duckdb
import pytest

from corpusloom.llm import queries
from tests.test_queries import canon

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["rec_id", "span_start", "span_end"],
    "p2_found": ["name_a", "name_b"],
    "p3_found": ["group_id", "field_name", "rec_id"],
    "p4_found": ["text_id_a", "text_id_b"],
    "p5_found": ["bib_id", "rec_id"],
    "p6_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = df.toPandas()
    assert len(got)
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for path in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        assert canon(got) == canon(con.execute(queries.SQL[name]).df())
