"""A8: the printed lines of all eight kinds, on the small fixture."""

import os

from depotline.plans.client_run import run_log
from tests.fixture_data import fixture_state


def test_report_of_a_client_file(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    logs = os.path.join(tmpdir_path, "logs")
    os.makedirs(logs)
    with open(os.path.join(logs, "0.txt"), "w") as f:
        f.write("\n".join(["N,1,1,1,2", "1,1,5", "3,1,6", "P,1,1,1,50000.00", "O,1,1,1", "S,1,1,60,2", "I,1,1,2", "T", "R,1,1,1", "D,1,7"]))
    out = run_log(spark, st, logs, key=os.path.basename(tmpdir_path))
    rows = out["report"].orderBy("ord", "line_no").collect()
    texts = {}
    for r in rows:
        assert r.line_no == len(texts.setdefault(r.ord, []))  # numbered without gaps
        texts[r.ord].append(r.text)
    got = list(texts.values())
    assert got[0] == [
        "N 1 1 1", "1,1,5", "3,1,6",
        "\tCustomer identifier (W_ID: 1, D_ID: 1, C_ID: 1), C_LAST: Last, C_CREDIT: GC, C_DISCOUNT: 0.1507",
        "\tW_TAX: 0.1000, D_TAX: 0.2000", "\tO_ID: 11, O_ENTRY_D: 2000-01-01 00:00:00", "\tNUM_ITEMS: 2, TOTAL_AMOUNT: 3753.91",
        "\tITEM_NUMBER: 1, I_NAME: item1, SUPPLIER_WAREHOUSE: 1, QUANTITY: 5, OL_AMOUNT: 1000.00, S_QUANTITY: 15",
        "\tITEM_NUMBER: 3, I_NAME: item3, SUPPLIER_WAREHOUSE: 1, QUANTITY: 6, OL_AMOUNT: 2400.00, S_QUANTITY: 104"]
    assert got[1] == [
        "P 1 1 1 50000.00", "\t(a) Customer information:", "\t\tIdentifier: (C_W_ID,C_D_ID,C_ID)=(1, 1, 1)",
        "\t\tName: (C_FIRST,C_MIDDLE,C_LAST)=(John, A, Last)",
        "\t\tAddress: (C_STREET_1,C_STREET_2,C_CITY,C_STATE,C_ZIP)=(street1, street2, city1, st, 10000)",
        "\t\tOther info: C_PHONE=8000000, C_SINCE=2022-08-02 17:16:05, C_CREDIT=GC, C_CREDIT_LIM=50000.00, C_DISCOUNT=0.15, "
        "C_BALANCE=-49980.00",
        "\t(b) Warehouse information:", "\t\tW_STREET_1=street1, W_STREET_2=street2, W_CITY=city1, W_STATE=st, W_ZIP=800000",
        "\t(c) District information:", "\t\tD_STREET_1=street1, D_STREET_2=street2, D_CITY=city1, D_STATE=st, D_ZIP=800000",
        "\t(d) Payment: 50000.00"]
    assert got[2] == [
        "O 1 1 1", "\t(a) Customer name & balance: (C_FIRST,C_MIDDLE,C_LAST)=(John, A, Last), C_BALANCE: -49980.00",
        "\t(b) O_ID: 11, O_ENTRY_D: 2000-01-01 00:00:00, O_CARRIER_ID: null", "\t(c) For each item in the order 11",
        "\t\tOL_I_ID: 1, OL_SUPPLY_W_ID: 1, OL_QUANTITY: 5, OL_AMOUNT: 1000.00, OL_DELIVER_D: null",
        "\t\tOL_I_ID: 3, OL_SUPPLY_W_ID: 1, OL_QUANTITY: 6, OL_AMOUNT: 2400.00, OL_DELIVER_D: null"]
    assert got[3] == ["S 1 1 2 60", "\tTotal number of items in S where its stock quantity at W_ID is below the threshold: 2"]
    assert got[4] == [
        "I 1 1 2", "\tDistrict identifier: (1, 1)", "\tNumber of last orders to be examined: 2",
        "\t(a) Order number:(10) & entry date and time (2022-08-02 17:16:05)",
        "\t(b) Name of customer who placed this order (John, A, Last)", "\t(c) For each popular item in order 10:",
        "\t\tItem name: item2, Quantity ordered: 1",
        "\t(a) Order number:(11) & entry date and time (2000-01-01 00:00:00)",
        "\t(b) Name of customer who placed this order (John, A, Last)", "\t(c) For each popular item in order 11:",
        "\t\tItem name: item3, Quantity ordered: 6", "\t(d) For each distinct popular item:",
        "\t\tItem name: item2, Occurring percentage: 50.00%", "\t\tItem name: item3, Occurring percentage: 50.00%"]
    assert got[5] == ["T", "\t(a) Name of Customer: (John, A, Last)", "\t(b) Customer's Balance: -49980.000000",
                      "\t(c) Customer's Warehouse: ware1", "\t(d) Customer's District: district1"]
    assert got[6] == ["R 1 1 1", "\t(a) Customer identifier (1, 1, 1)", "\t(b) No related customer found"]
    assert got[7] == ["D 1 7"]


def test_reports_without_results(spark):
    """A customer without orders, a place without customers, an order without lines, nulls, no rows at all."""
    from depotline.operators import report as R
    cols = ("req_id long, c_w_id int, c_d_id int, c_id long, c_first string, c_middle string, c_last string, c_balance_cents long, "
            "o_id long, o_entry_d string, o_carrier_id int, ol_number int, ol_i_id long, ol_supply_w_id int, ol_quantity int, "
            "ol_amount_cents long, ol_delivery_d string")
    row = (5, 1, 1, 2, None, "B", "C", None) + (None,) * 9
    got = R.render_order_status(spark.createDataFrame([row], cols)).orderBy("line_no").collect()
    assert [r.text for r in got] == [
        "O 1 1 2", "\t(a) Customer name & balance: (C_FIRST,C_MIDDLE,C_LAST)=(null, B, C), C_BALANCE: null"]
    assert R.render_order_status(spark.createDataFrame([], cols)).count() == 0
    req = spark.createDataFrame([(5, 1, 1, 2, 20)], "req_id long, w_id int, d_id int, c_id long, last_l int")
    pop = spark.createDataFrame([(5, 1, 1, 3, None, None, None, None, None, None, None)],
                                "req_id long, w_id int, d_id int, o_id long, o_entry_d string, c_first string, c_middle string, "
                                "c_last string, i_id long, i_name string, max_qty int")
    shares = spark.createDataFrame([], "req_id long, i_name string, n_lines long, n_examined long")
    got = R.render_popular_items(req, pop, shares).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(7))
    assert got[3].text == "\t(a) Order number:(3) & entry date and time (null)"
    rel = spark.createDataFrame([(5, 2, 1, 9), (5, 3, 1, 4), (5, 2, 1, 4)], "req_id long, w_id int, d_id int, c_id long")
    got = R.render_related(req, rel).orderBy("line_no").collect()
    assert [r.text for r in got][2:] == ["\t(b) Related customer identifiers:", "\t(2, 1, 4)", "\t(3, 1, 4)", "\t(2, 1, 9)"]
