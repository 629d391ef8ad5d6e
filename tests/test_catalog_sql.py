import duckdb
import pytest
from pyspark.sql import functions as F

from glossweave.plans.catalog import base, sources


def test_sql_capitals_equal_those_of_the_query(spark):
    texts = ["straße", "ß", "ŉa", "ﬁn ǰ", "", "aéñ", "x\nß"] + [f"a{c}b" for c in base._LONG_CAPITALS]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.upper("t")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(?) AS t, unnest(range(0, ?)) AS i", [texts, len(texts)])
    assert [r[0] for r in con.execute(f"SELECT {base.upper_sql('t')} FROM x ORDER BY i").fetchall()] == want
    assert con.execute(f"SELECT {base.upper_sql('t')} FROM (SELECT NULL::VARCHAR AS t)").fetchone() == (None,)


@pytest.mark.parametrize("html, text", [("a &amp;&amp", "a &&"), ("&quot;a&quot", '"a"'), ("<b>x</b> &amp;amp; &am", "x &amp; &am")])
def test_sql_reads_references_without_semicolon(html, text):
    sql = sources._PLAIN.format("?::VARCHAR")
    assert duckdb.connect().execute(f"SELECT {sql}", [html]).fetchone()[0] == text
