"""The small wholesale fixture (integer-encoded CSV: money x100, rates x10000)."""

import os

TS = "2022-08-02 17:16:05.211"

WAREHOUSE = ["1,ware1,street1,street2,city1,st,800000,1000,50000"]
DISTRICT = [f"1,{d},district{d},street1,street2,city1,st,800000,2000,0,{11 if d == 1 else 2}"
            for d in range(1, 11)]
CUSTOMER = [f"1,1,1,John,A,Last,street1,street2,city1,st,10000,8000000,{TS},GC,5000000,1507,2000,-1000,10,1,xxx"]
ITEM = [f"{i},item{i},{10000 + 10000 * i},10,item{i}_info" for i in range(1, 6)]
STOCK = [f"1,{i},{q},{ytd},{oc},0," + ",".join(f"dist{k}" for k in range(1, 11)) + ",miscellaneous"
         for i, q, ytd, oc in [(1, 20, 30000, 1), (2, 20, 30000, 1), (3, 10, 30000, 1),
                               (4, 5, 30000, 1), (5, 6, 30000, 1)]]
ORDER_KEYS = ([(1, 1, o) for o in range(1, 11)] + [(1, 2, 1), (1, 3, 1), (1, 3, 2)]
              + [(1, d, 1) for d in range(4, 11)])
ORDERS = [f"{w},{d},{o},1,{1 if (w, d, o) == (1, 3, 1) else 'null'},2,1,{TS}" for w, d, o in ORDER_KEYS]


def _line(w, d, o, n, i):
    return f"{w},{d},{o},{n},{i},null,{20000 if i == 1 else 30000},1,1,dist"


ORDERLINE = ([_line(1, 1, 1, 1, 1), _line(1, 1, 1, 2, 2)]
             + [_line(1, 1, o, 1, 1) for o in range(2, 10)] + [_line(1, 1, 10, 1, 2)]
             + [_line(1, d, 1, 1, 1) for d in range(2, 11)])

TABLES = {"warehouse": WAREHOUSE, "district": DISTRICT, "customer": CUSTOMER, "item": ITEM,
          "stock": STOCK, "orders": ORDERS, "orderline": ORDERLINE}


def write_fixture(root: str) -> dict:
    paths = {}
    for name, rows in TABLES.items():
        d = os.path.join(root, name)
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "part-0.csv"), "w") as f:
            f.write("\n".join(rows))
        paths[name] = d
    return paths


def fixture_state(spark, root: str):
    from depotline.sources.csv_tables import from_scaled, load_table, state_from_tables
    paths = write_fixture(root)
    t = {}
    for name, p in paths.items():
        good, bad = load_table(spark, p, name)
        assert bad.count() == 0, name
        t[name] = from_scaled(good, name)
    return state_from_tables(spark, t), t
