import csv
import random

import pytest

from glossweave.sources import quoted


@pytest.mark.parametrize("split", [37, 200, 100_000])
def test_rows_equal_the_read_in_one_task(spark, tmp_path, split):
    r = random.Random(split)
    odd = ["a", 'say "x"', "two\nlines", "a,b", "", '"', '""\n"', "\n\n", "long " * 30 + "\n" + "more " * 20, "5 o'clock", ",\n,"]
    path = tmp_path / "t.csv"
    with path.open("w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "one", "two"])
        for k in range(300):
            w.writerow([k, r.choice(odd), r.choice(odd)])
            if k % 50 == 0:
                f.write("\n")
        f.write('300,5" wide,plain\n')
    want = {tuple(x) for x in spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=True).collect()}
    assert len(want) == 301
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = quoted.csv(spark, str(path))
        rows = [tuple(x) for x in got.collect()]
        numbers = sorted(x.record for x in quoted.records(spark, str(path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 301 and set(rows) == want and got.columns == ["id", "one", "two"]
    assert numbers == list(range(1, 303))
