"""A1, A2: lines that fit the layout and lines that do not, from one pass."""

from decimal import Decimal

from depotline.sources import csv_tables as CSV


def test_good_and_bad_lines(spark, tmpdir_path):
    lines = ["1,bolt,1050,7,x", "2,null,99,null,null", "", "   ", '3,"a, b ""c""",100,1, padded ', "x4,nut,1,1,d", "5,short", "6,long,1,1,d,extra"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmpdir_path}/item")
    good, bad = CSV.load_table(spark, f"{tmpdir_path}/item", "item")
    got = {r.i_id: (r.i_name, r.i_price, r.i_im_id, r.i_data) for r in CSV.from_scaled(good, "item").collect()}
    assert got == {1: ("bolt", Decimal("10.50"), 7, "x"), 2: (None, Decimal("0.99"), None, None),
                   3: ('a, b "c"', Decimal("1.00"), 1, " padded ")}
    assert sorted(r.text for r in bad.collect()) == ["5,short", "6,long,1,1,d,extra", "x4,nut,1,1,d"]
    rows = CSV.read_rows(spark, f"{tmpdir_path}/item", "item")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "InMemoryTableScan" not in plan
    assert rows.count() == 6


def test_written_lines_read_back(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "dock ", "a,b", Decimal("1.50"), Decimal("0.0425")), (2, None, ' "q" ', None, Decimal("0.1000"))],
                               "w_id int, w_name string, w_city string, w_ytd decimal(12,2), w_tax decimal(4,4)")
    CSV.csv_lines(df, "warehouse").write.text(f"{tmpdir_path}/w")
    good, bad = CSV.load_table(spark, f"{tmpdir_path}/w", "warehouse")
    back = CSV.from_scaled(good, "warehouse").select(*df.columns)
    assert bad.count() == 0 and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_empty_folder_of_lines(spark, tmpdir_path):
    spark.createDataFrame([], "value string").write.text(f"{tmpdir_path}/none")
    good, bad = CSV.load_table(spark, f"{tmpdir_path}/none", "orders")
    assert good.count() == 0 and bad.count() == 0
