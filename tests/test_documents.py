from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import documents as D
from verdigris.plans.documents import QUERIES


def test_numbers_after_an_isbn(spark):
    """They don't hide it, and a run without an ISBN of its own gives none."""
    want = {
        "ISBN: 978-0-306-40615-7 56.187.231.175": "9780306406157",
        "isbn 0-306-40615-2 1984 and": "0306406152",
        "ISBN-10: 0 8044 2957 X 12": "080442957X",
        "ISBN 978-0-306-40615-7": "9780306406157",
        "ISBN 97803064061571984": None,
        "ISBN 978-0-306-40615-8 1984": None,
        "ISBN: 123 4 or ISBN 030640615219 or ISBN 0306406152": "0306406152",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.isbn for r in df.select("t", X.find_isbn(F.col("t")).alias("isbn")).collect()} == want
    page = spark.createDataFrame([(1, "<p>ISBN: 978-0-306-40615-7</p><title>4501042323994846 Anth</title>")], "page_id long, html string")
    assert D.page_metadata(page).first().isbn == "9780306406157"


def test_scan_of_equal_addresses_is_repeatable(spark, tmp_path):
    """Pages of one address are placed by page_id, however the table is laid out."""
    rows = [(i, f"http://h/{'Aa'[i % 2]}{i // 40}") for i in range(200)]
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1].lower(), r[1], r[0])), 1)}
    for name, own in (("up", rows), ("down", rows[::-1]), ("mixed", rows[::3] + rows[2::3] + rows[1::3])):
        spark.createDataFrame(own, "page_id long, url string").repartition(3, "page_id").write.parquet(f"{tmp_path}/{name}/pages.parquet")
        found = QUERIES["scan_progress"](spark, f"{tmp_path}/{name}").collect()
        assert {r.page_id: r.current for r in found} == want and {r.total for r in found} == {200}


def test_csv_fields_are_found_once(spark, sf_dir):
    """A table's fields are one expression of the plan, not one for each use of them; ragged, quoted and empty texts keep their tables."""
    plan = QUERIES["csv_table"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract_all") == 1
    want = {
        'a,b\n1\n"x ""y"", z",2,3\n': '| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n| x "y", z | 2 | 3 |',
        "a\r\n\r\nb|c": "| a |\n| --- |\n| b\\|c |",
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.m for r in df.select("t", D.csv_markdown(F.col("t")).alias("m")).collect()} == want
