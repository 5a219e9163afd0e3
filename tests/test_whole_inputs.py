"""Queries read whole fixtures: every instrument, every line of a file, every year."""
from levybook.plans import all_queries  # noqa: F401
from levybook.plans.fixtures import Tables
from levybook.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_instruments(spark):
    t = Tables(spark, SF)
    got = QUERIES["b5_rate_geoid_all"].build(t)
    assert got.select("file").distinct().count() == 7 and got.count() == t.rate_history.count()
    assert QUERIES["e5_unmapped_rows_all"].build(t).count() > QUERIES["e5_unmapped_rows"].build(t).count()


def test_files_of_several_lines(spark):
    t = Tables(spark, SF)
    got = QUERIES["a1_rate_file_lines"].build(t)
    assert got.agg({"line_no": "max"}).first()[0] > 1
    assert got.count() == t.rate_history.where("seq % 17 <> 0 AND seq % 19 <> 0").count()


def test_all_years(spark):
    t = Tables(spark, SF)
    years = lambda df: {r[0] for r in df.select("fiscal_year").distinct().collect()}
    assert years(QUERIES["d15_replace_vintage_all"].build(t)) == {y for y in years(t.base_rows) if y % 3 != 1}
