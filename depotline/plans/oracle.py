"""DuckDB oracle SQL for the registered queries.

The state derivation of ``depotline.sources.adapter`` is repeated here as CTEs
(plain window functions here, the skew-safe forms on the Spark side).  Money leaves as BIGINT cents, rates as INTEGER basis
points, timestamps as 'yyyy-MM-dd HH:mm:ss.SSS' text.
"""

from __future__ import annotations

TS = "'%Y-%m-%d %H:%M:%S.%g'"


def _state_ctes(order_filter: str = "TRUE") -> str:
    return f"""
x_wh AS (
  SELECT CAST(r_regionkey + 1 AS INTEGER) AS w_id, r_name AS w_name,
         '1 ' || r_name || ' way' AS w_street_1, 'dock ' AS w_street_2, lower(r_name) AS w_city,
         upper(substr(r_name, 1, 2)) AS w_state,
         lpad(CAST(CAST(r_regionkey + 1 AS INTEGER) AS VARCHAR), 5, '0') || '1111' AS w_zip,
         CAST(((r_regionkey % 20) + 1) / 100.0 AS DECIMAL(4,4)) AS w_tax
  FROM region),
x_dist0 AS (
  SELECT CAST(n_regionkey + 1 AS INTEGER) AS d_w_id,
         CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS d_id,
         n_nationkey AS d_nationkey, n_name AS d_name,
         '2 ' || n_name || ' road' AS d_street_1, 'hall ' AS d_street_2, lower(n_name) AS d_city,
         upper(substr(n_name, 1, 2)) AS d_state,
         lpad(CAST(n_nationkey AS VARCHAR), 5, '0') || '2222' AS d_zip,
         CAST(((n_nationkey % 100) + 1) / 1000.0 AS DECIMAL(4,4)) AS d_tax
  FROM nation),
x_cust AS (
  SELECT d_w_id AS c_w_id, d_id AS c_d_id, c_custkey AS c_id, c_mktsegment AS c_first,
         'OE' AS c_middle, c_name AS c_last, '3 ' || c_mktsegment || ' lane' AS c_street_1,
         'unit ' || CAST(c_custkey AS VARCHAR) AS c_street_2, d_city AS c_city, d_state AS c_state,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || '3333' AS c_zip, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS c_phone,
         TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(c_custkey % 3650 AS INTEGER)) AS c_since,
         'GC' AS c_credit, CAST(50000 AS DECIMAL(12,2)) AS c_credit_lim,
         CAST((c_custkey % 5) / 100.0 AS DECIMAL(4,4)) AS c_discount,
         CAST(c_acctbal AS DECIMAL(12,2)) AS c_balance
  FROM customer JOIN x_dist0 ON c_nationkey = d_nationkey),
x_ord AS (
  SELECT o_orderkey, c_w_id AS o_w_id, c_d_id AS o_d_id, o_custkey AS o_c_id,
         CASE WHEN o_orderstatus = 'F' THEN CAST((o_orderkey % 10) + 1 AS INTEGER) END AS o_carrier_id,
         o_orderdate AS o_entry_d,
         row_number() OVER (PARTITION BY c_w_id, c_d_id ORDER BY o_orderkey) AS o_id
  FROM orders JOIN x_cust ON o_custkey = c_id
  WHERE {order_filter}),
x_dist AS (
  SELECT x_dist0.*, CAST(coalesce(n, 0) + 1 AS BIGINT) AS d_next_o_id
  FROM x_dist0 LEFT JOIN (SELECT o_w_id, o_d_id, count(*) AS n FROM x_ord GROUP BY o_w_id, o_d_id) c
    ON d_w_id = o_w_id AND d_id = o_d_id),
x_ol AS (
  SELECT l_orderkey AS ol_orderkey, o_w_id AS ol_w_id, o_d_id AS ol_d_id, o_id AS ol_o_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS ol_number,
         l_partkey AS ol_i_id,
         CASE WHEN o_carrier_id IS NOT NULL THEN l_shipdate END AS ol_delivery_d,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS ol_amount, l_suppkey AS ol_suppkey,
         CAST(l_quantity AS INTEGER) AS ol_quantity
  FROM lineitem JOIN x_ord ON l_orderkey = o_orderkey),
x_olsup AS (
  SELECT x_ol.*, CAST(n_regionkey + 1 AS INTEGER) AS ol_supply_w_id
  FROM x_ol LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON ol_suppkey = s_suppkey),
x_item AS (
  SELECT p_partkey AS i_id, p_name AS i_name, CAST(p_retailprice AS DECIMAL(12,2)) AS i_price,
         p_size AS i_im_id, p_brand AS i_data
  FROM part)"""


ALL = _state_ctes()
BASE = _state_ctes("o_orderstatus IN ('F', 'O')")

DIST_REQ = """
x_req AS (
  SELECT CAST(d_nationkey AS BIGINT) AS req_id, d_w_id AS w_id, d_id, 60 AS threshold, 20 AS last_l,
         d_next_o_id - 20 AS o_lo, d_next_o_id AS o_hi
  FROM x_dist),
x_rlines AS (
  SELECT req_id, w_id, d_id, ol_o_id AS o_id, ol_i_id AS i_id, ol_quantity AS qty
  FROM x_req JOIN x_ol ON ol_w_id = w_id AND ol_d_id = d_id AND ol_o_id >= o_lo AND ol_o_id < o_hi),
x_rords AS (
  SELECT req_id, w_id, d_id, o_id, o_c_id, o_entry_d
  FROM x_req JOIN x_ord ON o_w_id = w_id AND o_d_id = d_id AND o_id >= o_lo AND o_id < o_hi),
x_pop AS (
  SELECT DISTINCT req_id, w_id, d_id, o_id, i_id, max_qty FROM (
    SELECT *, max(qty) OVER (PARTITION BY req_id, w_id, d_id, o_id) AS max_qty FROM x_rlines)
  WHERE qty = max_qty)"""

RELATED = """
x_oi AS (SELECT DISTINCT ol_w_id AS w, ol_d_id AS d, ol_o_id AS o, ol_i_id AS i FROM x_ol),
x_oc AS (SELECT x_oi.*, o_c_id AS c FROM x_oi JOIN x_ord ON o_w_id = w AND o_d_id = d AND o_id = o),
x_opairs AS (
  SELECT a.w AS aw, a.d AS ad, a.c AS ac, a.o AS ao, b.w AS bw, b.d AS bd, b.c AS bc, b.o AS bo
  FROM x_oc a JOIN x_oc b ON a.i = b.i AND a.w <> b.w
  GROUP BY a.w, a.d, a.c, a.o, b.w, b.d, b.c, b.o
  HAVING count(*) >= 2)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


READS = {
    "popular_items": with_ctes(ALL, DIST_REQ) + f"""
SELECT r.req_id, r.w_id, r.d_id, r.o_id, strftime(r.o_entry_d, {TS}) AS o_entry_d,
       c.c_first, c.c_middle, c.c_last, p.i_id, it.i_name, p.max_qty
FROM x_rords r
LEFT JOIN x_pop p ON p.req_id = r.req_id AND p.w_id = r.w_id AND p.d_id = r.d_id AND p.o_id = r.o_id
LEFT JOIN x_cust c ON c.c_w_id = r.w_id AND c.c_d_id = r.d_id AND c.c_id = r.o_c_id
LEFT JOIN x_item it ON it.i_id = p.i_id""",

    "popular_item_pct": with_ctes(ALL, DIST_REQ) + """
SELECT p.req_id, p.i_id, it.i_name, count(DISTINCT p.o_id) AS n_orders, e.n_examined,
       CAST(count(DISTINCT p.o_id) AS DOUBLE) / e.n_examined AS pct
FROM x_pop p
JOIN (SELECT req_id, count(*) AS n_examined FROM x_rords GROUP BY req_id) e ON e.req_id = p.req_id
LEFT JOIN x_item it ON it.i_id = p.i_id
GROUP BY p.req_id, p.i_id, it.i_name, e.n_examined""",

    "stock_level": with_ctes(ALL, DIST_REQ) + """
, x_ri AS (SELECT DISTINCT req_id, w_id, i_id FROM x_rlines),
x_st AS (
  SELECT x_ri.*, CAST(10 + (((i_id * 7 + w_id * 13) % 91) + 91) % 91 AS INTEGER) AS s_quantity
  FROM x_ri JOIN part ON p_partkey = i_id)
SELECT r.req_id, r.w_id, r.d_id, r.threshold, r.last_l, CAST(coalesce(s.n, 0) AS BIGINT) AS items_below
FROM x_req r LEFT JOIN (
  SELECT req_id, count(*) FILTER (WHERE s_quantity < 60) AS n FROM x_st GROUP BY req_id) s
  ON s.req_id = r.req_id""",

    "order_status": with_ctes(ALL) + f"""
, x_last AS (
  SELECT o.* FROM x_ord o
  JOIN (SELECT o_w_id, o_d_id, o_c_id, max(o_id) AS o_id FROM x_ord GROUP BY o_w_id, o_d_id, o_c_id) m
    USING (o_w_id, o_d_id, o_c_id, o_id))
SELECT c.c_id AS req_id, c.c_w_id, c.c_d_id, c.c_id, c.c_first, c.c_middle, c.c_last,
       CAST(c.c_balance * 100 AS BIGINT) AS c_balance_cents,
       l.o_id, strftime(l.o_entry_d, {TS}) AS o_entry_d, l.o_carrier_id,
       ol.ol_number, ol.ol_i_id, ol.ol_supply_w_id, ol.ol_quantity,
       CAST(ol.ol_amount * 100 AS BIGINT) AS ol_amount_cents,
       strftime(ol.ol_delivery_d, {TS}) AS ol_delivery_d
FROM x_cust c
LEFT JOIN x_last l ON l.o_w_id = c.c_w_id AND l.o_d_id = c.c_d_id AND l.o_c_id = c.c_id
LEFT JOIN x_olsup ol ON ol.ol_w_id = l.o_w_id AND ol.ol_d_id = l.o_d_id AND ol.ol_o_id = l.o_id""",

    "last_order": with_ctes(ALL) + f"""
SELECT o_w_id, o_d_id, o_c_id, o_id, strftime(o_entry_d, {TS}) AS o_entry_d, o_carrier_id
FROM x_ord o
WHERE o_id = (SELECT max(o_id) FROM x_ord m
              WHERE m.o_w_id = o.o_w_id AND m.o_d_id = o.o_d_id AND m.o_c_id = o.o_c_id)""",

    "top_balance": with_ctes(ALL) + """
SELECT CAST(row_number() OVER (ORDER BY c_balance DESC NULLS LAST, c_w_id, c_d_id, c_id) AS INTEGER) AS rank,
       c_w_id, c_d_id, c_id, c_first, c_middle, c_last, CAST(c_balance * 100 AS BIGINT) AS c_balance_cents,
       w.w_name, d.d_name
FROM x_cust
LEFT JOIN x_wh w ON w.w_id = c_w_id
LEFT JOIN x_dist d ON d.d_w_id = c_w_id AND d.d_id = c_d_id
QUALIFY rank <= 10""",

    "top_balance_by_district": with_ctes(ALL) + """
SELECT c_w_id, c_d_id,
       CAST(row_number() OVER (PARTITION BY c_w_id, c_d_id ORDER BY c_balance DESC NULLS LAST, c_id) AS INTEGER) AS rank,
       c_id, c_first, c_middle, c_last, CAST(c_balance * 100 AS BIGINT) AS c_balance_cents,
       w.w_name, d.d_name
FROM x_cust
LEFT JOIN x_wh w ON w.w_id = c_w_id
LEFT JOIN x_dist d ON d.d_w_id = c_w_id AND d.d_id = c_d_id
QUALIFY rank <= 10""",

    "related_customers": with_ctes(ALL, RELATED) + """
SELECT DISTINCT ac AS req_id, bw AS w_id, bd AS d_id, bc AS c_id FROM x_opairs WHERE ac % 50 = 0""",

    "related_pairs": with_ctes(ALL, RELATED) + """
SELECT DISTINCT aw AS w1, ad AS d1, ac AS c1, bw AS w2, bd AS d2, bc AS c2 FROM x_opairs WHERE aw < bw""",

    "related_customers_by_lines": with_ctes(ALL) + """
, x_lc AS (SELECT ol_w_id AS w, ol_d_id AS d, ol_o_id AS o, ol_i_id AS i, o_c_id AS c
           FROM x_ol JOIN x_ord ON o_w_id = ol_w_id AND o_d_id = ol_d_id AND o_id = ol_o_id)
SELECT DISTINCT ac AS req_id, bw AS w_id, bd AS d_id, bc AS c_id FROM (
  SELECT a.w AS aw, a.d AS ad, a.c AS ac, a.o AS ao, b.w AS bw, b.d AS bd, b.c AS bc, b.o AS bo
  FROM (SELECT DISTINCT w, d, c, o, i FROM x_lc WHERE c % 50 = 0) a JOIN x_lc b ON a.i = b.i AND a.w <> b.w
  GROUP BY a.w, a.d, a.c, a.o, b.w, b.d, b.c, b.o HAVING count(*) >= 2)""",

    "popular_item_pct_by_name": with_ctes(ALL, DIST_REQ) + """
, x_tied AS (SELECT * FROM (
    SELECT *, max(qty) OVER (PARTITION BY req_id, w_id, d_id, o_id) AS mq FROM x_rlines) WHERE qty = mq)
SELECT t.req_id, it.i_name, count(*) AS n_lines, e.n_examined, CAST(count(*) AS DOUBLE) / e.n_examined AS pct
FROM x_tied t JOIN x_item it ON it.i_id = t.i_id
JOIN (SELECT req_id, count(*) AS n_examined FROM x_rords GROUP BY req_id) e ON e.req_id = t.req_id
GROUP BY t.req_id, it.i_name, e.n_examined""",

    "pending_orders": with_ctes(ALL) + """
SELECT o_w_id, o_d_id, o_id, o_c_id FROM x_ord WHERE o_carrier_id IS NULL""",

    "oldest_pending": with_ctes(ALL) + """
SELECT o_w_id, o_d_id, min(o_id) AS o_id, arg_min(o_c_id, o_id) AS o_c_id
FROM x_ord WHERE o_carrier_id IS NULL GROUP BY o_w_id, o_d_id""",

    "order_amount": with_ctes(ALL) + """
SELECT o_w_id, o_d_id, o_id, CAST(coalesce(s, 0) * 100 AS BIGINT) AS amount_cents
FROM x_ord LEFT JOIN (
  SELECT ol_w_id, ol_d_id, ol_o_id, sum(ol_amount) AS s FROM x_ol GROUP BY ol_w_id, ol_d_id, ol_o_id) a
  ON ol_w_id = o_w_id AND ol_d_id = o_d_id AND ol_o_id = o_id""",

    "order_summary": with_ctes(ALL) + """
SELECT ol_w_id AS o_w_id, ol_d_id AS o_d_id, ol_o_id AS o_id, max(ol_quantity) AS max_quantity,
       array_to_string(list_reverse_sort(list(ol_i_id) FILTER (WHERE ol_quantity = mq)), ',') AS item_ids,
       CAST(sum(ol_amount) * 100 AS BIGINT) AS total_amount_cents
FROM (SELECT *, max(ol_quantity) OVER (PARTITION BY ol_w_id, ol_d_id, ol_o_id) AS mq FROM x_ol)
GROUP BY ol_w_id, ol_d_id, ol_o_id""",

    "customer_district": with_ctes(ALL) + """
SELECT c_w_id, c_d_id, c_id, c_first, c_middle, c_last, CAST(c_balance * 100 AS BIGINT) AS c_balance_cents,
       CAST(c_discount * 10000 AS INTEGER) AS c_discount_bp, d_name,
       CAST(d_tax * 10000 AS INTEGER) AS d_tax_bp, d_next_o_id
FROM x_cust JOIN x_dist ON c_w_id = d_w_id AND c_d_id = d_id""",

    "orders_orderline": with_ctes(ALL) + f"""
SELECT o_w_id, o_d_id, o_id, o_c_id, o_carrier_id, strftime(o_entry_d, {TS}) AS o_entry_d,
       ol_number, ol_i_id, ol_quantity, CAST(ol_amount * 100 AS BIGINT) AS ol_amount_cents,
       strftime(ol_delivery_d, {TS}) AS ol_delivery_d
FROM x_ord JOIN x_ol ON o_w_id = ol_w_id AND o_d_id = ol_d_id AND o_id = ol_o_id""",

    "stock_item": with_ctes(ALL) + """
SELECT w_id AS s_w_id, p_partkey AS s_i_id,
       CAST(10 + (((p_partkey * 7 + w_id * 13) % 91) + 91) % 91 AS INTEGER) AS s_quantity,
       p_type AS s_data, 'dist1-' || CAST(p_partkey AS VARCHAR) AS s_dist_01,
       'dist10-' || CAST(p_partkey AS VARCHAR) AS s_dist_10,
       p_name AS i_name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS i_price_cents
FROM part CROSS JOIN x_wh""",
}
ORACLE = dict(READS)


# --- replay of the derived log (base state: orders 'F'/'O') -------------------------

LOG = """
x_n AS (
  SELECT o_orderkey * 2 AS ord, c_w_id AS w_id, c_d_id AS d_id, c_id
  FROM orders JOIN x_cust ON o_custkey = c_id WHERE o_orderstatus = 'P'),
x_nl AS (
  SELECT l_orderkey * 2 AS ord,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS ol_number,
         l_partkey AS i_id, CAST(n_regionkey + 1 AS INTEGER) AS supply_w_id, CAST(l_quantity AS INTEGER) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'P'
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
x_cnt AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM region) AS nw),
x_ev AS (
  SELECT e.*, event_id * 2 + 1 AS ord, ((user_id % nc) + nc) % nc AS cc,
         CAST(((user_id % nw) + nw) % nw + 1 AS INTEGER) AS dw
  FROM events e, x_cnt),
x_pay AS (
  SELECT ord, c_w_id AS w_id, c_d_id AS d_id, c_id, CAST(value AS DECIMAL(12,2)) AS amount
  FROM x_ev JOIN x_cust ON cc = c_id WHERE event_type = 'purchase'),
x_stat AS (
  SELECT ord, c_w_id AS w_id, c_d_id AS d_id, c_id
  FROM x_ev JOIN x_cust ON cc = c_id WHERE event_type = 'view'),
x_asks AS (
  SELECT ord, substr('SITR', CAST(event_id % 4 + 1 AS INTEGER), 1) AS kind, c_w_id AS w_id, c_d_id AS d_id, c_id
  FROM x_ev JOIN x_cust ON cc = c_id WHERE event_type = 'click'),
x_dlv AS (
  SELECT ord, dw AS w_id, CAST(event_id % 10 + 1 AS INTEGER) AS carrier_id
  FROM x_ev WHERE event_type = 'signup'),
x_oid AS (
  SELECT x_n.*, x_dist.d_next_o_id + row_number() OVER (PARTITION BY x_n.w_id, x_n.d_id ORDER BY x_n.ord) - 1 AS o_id
  FROM x_n JOIN x_dist ON x_dist.d_w_id = x_n.w_id AND x_dist.d_id = x_n.d_id),
x_lines AS (
  SELECT nl.*, o.w_id, o.d_id, o.o_id,
         row_number() OVER (PARTITION BY supply_w_id, i_id ORDER BY nl.ord, ol_number) AS seq,
         10 + (((i_id * 7 + supply_w_id * 13) % 91) + 91) % 91 AS q0
  FROM x_nl nl JOIN x_oid o ON o.ord = nl.ord),
x_steps AS (
  WITH RECURSIVE st(supply_w_id, i_id, seq, q) AS (
    SELECT DISTINCT supply_w_id, i_id, CAST(0 AS BIGINT), q0 FROM x_lines
    UNION ALL
    SELECT l.supply_w_id, l.i_id, l.seq, CASE WHEN st.q - l.qty < 10 THEN st.q - l.qty + 100 ELSE st.q - l.qty END
    FROM st JOIN x_lines l ON l.supply_w_id = st.supply_w_id AND l.i_id = st.i_id AND l.seq = st.seq + 1)
  SELECT * FROM st),
x_lines2 AS (
  SELECT l.*, it.i_name, CAST(it.i_price * qty AS DECIMAL(12,2)) AS amount, b.q AS s_before, a.q AS s_after
  FROM x_lines l JOIN x_item it ON it.i_id = l.i_id
  JOIN x_steps b ON b.supply_w_id = l.supply_w_id AND b.i_id = l.i_id AND b.seq = l.seq - 1
  JOIN x_steps a ON a.supply_w_id = l.supply_w_id AND a.i_id = l.i_id AND a.seq = l.seq),
x_newo AS (
  SELECT o.ord, o.w_id, o.d_id, o.o_id, o.c_id, CAST(coalesce(a.s, 0) AS DECIMAL(18,2)) AS amount
  FROM x_oid o LEFT JOIN (SELECT ord, sum(amount) AS s FROM x_lines2 GROUP BY ord) a ON a.ord = o.ord),
x_pend AS (
  SELECT o_w_id AS w_id, o_d_id AS d_id, o_id, o_c_id AS c_id,
         row_number() OVER (PARTITION BY o_w_id, o_d_id ORDER BY o_id) AS k
  FROM x_ord WHERE o_carrier_id IS NULL),
x_pamt AS (
  SELECT p.*, CAST(coalesce(a.s, 0) AS DECIMAL(18,2)) AS amount
  FROM x_pend p LEFT JOIN (SELECT ol_w_id, ol_d_id, ol_o_id, sum(ol_amount) AS s FROM x_ol
                           GROUP BY ol_w_id, ol_d_id, ol_o_id) a
    ON a.ol_w_id = p.w_id AND a.ol_d_id = p.d_id AND a.ol_o_id = p.o_id),
x_p0 AS (SELECT d_w_id AS w_id, d_id, (SELECT count(*) FROM x_pend p WHERE p.w_id = d_w_id AND p.d_id = x_dist.d_id) AS p0
         FROM x_dist),
x_att AS (SELECT a.ord, a.w_id, d.d_id, a.carrier_id FROM x_dlv a JOIN x_dist d ON d.d_w_id = a.w_id)"""

# Delivery simulated step by step per district (recursive CTE): independent
# of the reflected-count formula used on the Spark side.
DELIVERY_SIM = """
x_evs AS (
  SELECT *, row_number() OVER (PARTITION BY w_id, d_id ORDER BY ord) AS seq FROM (
    SELECT ord, w_id, d_id, carrier_id, 1 AS is_att FROM x_att
    UNION ALL SELECT ord, w_id, d_id, NULL, 0 FROM x_newo)),
x_sim AS (
  WITH RECURSIVE sim(w_id, d_id, seq, qlen, succ, ok) AS (
    SELECT w_id, d_id, CAST(0 AS BIGINT), p0, CAST(0 AS BIGINT), false FROM x_p0
    UNION ALL
    SELECT e.w_id, e.d_id, e.seq,
           CASE WHEN e.is_att = 1 THEN greatest(s.qlen - 1, 0) ELSE s.qlen + 1 END,
           s.succ + CASE WHEN e.is_att = 1 AND s.qlen > 0 THEN 1 ELSE 0 END,
           e.is_att = 1 AND s.qlen > 0
    FROM sim s JOIN x_evs e ON e.w_id = s.w_id AND e.d_id = s.d_id AND e.seq = s.seq + 1)
  SELECT * FROM sim),
x_queue AS (
  SELECT w_id, d_id, k, o_id, c_id, amount FROM x_pamt
  UNION ALL
  SELECT n.w_id, n.d_id, p.p0 + row_number() OVER (PARTITION BY n.w_id, n.d_id ORDER BY n.ord),
         n.o_id, n.c_id, n.amount
  FROM x_newo n JOIN x_p0 p ON p.w_id = n.w_id AND p.d_id = n.d_id),
x_deliv AS (
  SELECT e.ord, e.w_id, e.d_id, e.carrier_id, q.o_id, q.c_id,
         CASE WHEN s.ok THEN CAST(q.amount * 100 AS BIGINT) END AS amount_cents
  FROM x_evs e JOIN x_sim s ON s.w_id = e.w_id AND s.d_id = e.d_id AND s.seq = e.seq
  LEFT JOIN x_queue q ON s.ok AND q.w_id = e.w_id AND q.d_id = e.d_id AND q.k = s.succ
  WHERE e.is_att = 1)"""

RB = with_ctes(BASE, LOG)

# Reads in the middle of the log: the last 20 orders of the district of every order-status record.
AS_OF = """
, x_asreq AS (
  SELECT s.ord AS req_id, s.w_id, s.d_id,
         d.d_next_o_id + (SELECT count(*) FROM x_n n WHERE n.w_id = s.w_id AND n.d_id = s.d_id AND n.ord < s.ord) AS o_hi
  FROM x_stat s JOIN x_dist d ON d.d_w_id = s.w_id AND d.d_id = s.d_id),
x_allol AS (
  SELECT ol_w_id AS w_id, ol_d_id AS d_id, ol_o_id AS o_id, ol_i_id AS i_id, ol_quantity AS qty FROM x_ol
  UNION ALL SELECT w_id, d_id, o_id, i_id, qty FROM x_lines2),
x_asl AS (
  SELECT r.req_id, r.w_id, r.d_id, l.o_id, l.i_id, l.qty
  FROM x_asreq r JOIN x_allol l ON l.w_id = r.w_id AND l.d_id = r.d_id AND l.o_id >= r.o_hi - 20 AND l.o_id < r.o_hi)"""

_OWN = ["street_1", "street_2", "city", "state", "zip"]


def _address(prefix: str) -> str:
    return ", ".join(f"{prefix}_{a}" for a in _OWN)


PAID = f"""
, x_paid AS (
  SELECT p.ord, p.w_id, p.d_id, p.c_id, c.c_first, c.c_middle, c.c_last, {_address('c.c')}, c.c_phone,
         strftime(c.c_since, {TS}) AS c_since, c.c_credit, CAST(c.c_credit_lim * 100 AS BIGINT) AS c_credit_lim_cents,
         CAST(c.c_discount * 10000 AS INTEGER) AS c_discount_bp, CAST(p.amount * 100 AS BIGINT) AS amount_cents,
         CAST((c.c_balance - sum(p.amount) OVER (PARTITION BY p.w_id, p.d_id, p.c_id ORDER BY p.ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 100 AS BIGINT) AS balance_after_cents,
         {_address('w.w')}, {_address('d.d')}
  FROM x_pay p JOIN x_cust c ON c.c_w_id = p.w_id AND c.c_d_id = p.d_id AND c.c_id = p.c_id
  JOIN x_wh w ON w.w_id = p.w_id JOIN x_dist d ON d.d_w_id = p.w_id AND d.d_id = p.d_id)"""

REPLAY = {
    "replay_order_ids": RB + """
SELECT ord, w_id, d_id, c_id, o_id FROM x_oid""",

    "new_order_lines": RB + """
SELECT ord, w_id, d_id, o_id, ol_number, i_id, i_name, supply_w_id, qty,
       CAST(s_before AS INTEGER) AS s_quantity_before, CAST(s_after AS INTEGER) AS s_quantity_after,
       'dist' || CAST(d_id AS VARCHAR) || '-' || CAST(i_id AS VARCHAR) AS ol_dist_info,
       CAST(amount * 100 AS BIGINT) AS amount_cents
FROM x_lines2""",

    "new_order_totals": RB + """
SELECT o.ord, o.w_id, o.d_id, o.o_id, o.c_id, c.c_last, c.c_credit,
       CAST(c.c_discount * 10000 AS INTEGER) AS c_discount_bp, CAST(w.w_tax * 10000 AS INTEGER) AS w_tax_bp,
       CAST(d.d_tax * 10000 AS INTEGER) AS d_tax_bp, coalesce(a.n, 0) AS n_items,
       CAST(coalesce(a.loc, 1) AS INTEGER) AS all_local,
       CAST(round(CAST(coalesce(a.s, 0) AS DECIMAL(18,2)) * (1 + d.d_tax + w.w_tax) * (1 - c.c_discount), 2) * 100
            AS BIGINT) AS total_cents
FROM x_oid o
LEFT JOIN (SELECT ord, sum(amount) AS s, count(*) AS n, min(CAST(supply_w_id = w_id AS INTEGER)) AS loc
           FROM x_lines2 GROUP BY ord) a ON a.ord = o.ord
JOIN x_cust c ON c.c_w_id = o.w_id AND c.c_d_id = o.d_id AND c.c_id = o.c_id
JOIN x_wh w ON w.w_id = o.w_id
JOIN x_dist d ON d.d_w_id = o.w_id AND d.d_id = o.d_id""",

    "stock_after": RB + """
SELECT supply_w_id AS s_w_id, i_id AS s_i_id,
       CAST(list_reduce(draws, lambda q, x: CASE WHEN q - x < 10 THEN q - x + 100 ELSE q - x END, q0) AS INTEGER) AS s_quantity,
       CAST(c AS BIGINT) AS s_ytd, CAST(n AS BIGINT) AS s_order_cnt, CAST(r AS BIGINT) AS s_remote_cnt
FROM (SELECT supply_w_id, i_id, any_value(q0) AS q0, sum(qty) AS c, count(*) AS n,
             list(qty ORDER BY ord, ol_number) AS draws, sum(CAST(supply_w_id <> w_id AS INTEGER)) AS r
      FROM x_lines GROUP BY supply_w_id, i_id)""",

    # step rule folded over the ordered draws (independent of the closed form)
    "replay_stock": RB + """
SELECT supply_w_id AS s_w_id, i_id AS s_i_id, count(*) AS n_draws,
       CAST(list_reduce(list(qty ORDER BY ord, ol_number),
                        lambda q, x: CASE WHEN q - x < 10 THEN q - x + 100 ELSE q - x END,
                        any_value(q0)) AS INTEGER) AS s_quantity
FROM x_lines GROUP BY supply_w_id, i_id""",

    "payment_effects": RB + """
SELECT c.c_w_id, c.c_d_id, c.c_id, CAST((c.c_balance - p.s) * 100 AS BIGINT) AS c_balance_cents,
       CAST(p.s * 100 AS BIGINT) AS c_ytd_payment_cents, p.n AS c_payment_cnt
FROM (SELECT w_id, d_id, c_id, sum(amount) AS s, count(*) AS n FROM x_pay GROUP BY w_id, d_id, c_id) p
JOIN x_cust c ON c.c_w_id = p.w_id AND c.c_d_id = p.d_id AND c.c_id = p.c_id""",

    "payment_receipts": RB + PAID + """
SELECT * FROM x_paid""",

    "delivery_effects": RB + """
SELECT a.ord, a.w_id, a.d_id, a.carrier_id, q.o_id, q.c_id, CAST(q.amount * 100 AS BIGINT) AS amount_cents
FROM (SELECT *, row_number() OVER (PARTITION BY w_id, d_id ORDER BY ord) AS k FROM x_att) a
LEFT JOIN x_pamt q ON q.w_id = a.w_id AND q.d_id = a.d_id AND q.k = a.k""",

    "replay_delivery": with_ctes(BASE, LOG, DELIVERY_SIM) + """
SELECT ord, w_id, d_id, carrier_id, o_id, c_id, amount_cents FROM x_deliv""",

    "replay_balance": with_ctes(BASE, LOG, DELIVERY_SIM) + """
, x_led AS (
  SELECT w_id, d_id, c_id, -CAST(amount * 100 AS BIGINT) AS delta, 'P' AS kind FROM x_pay
  UNION ALL SELECT w_id, d_id, c_id, amount_cents, 'D' FROM x_deliv WHERE o_id IS NOT NULL)
SELECT c.c_w_id, c.c_d_id, c.c_id, CAST(c.c_balance * 100 AS BIGINT) + l.d AS c_balance_cents,
       l.ytd AS c_ytd_payment_cents, l.np AS c_payment_cnt, l.nd AS c_delivery_cnt
FROM (SELECT w_id, d_id, c_id, sum(delta) AS d,
             CAST(coalesce(sum(-delta) FILTER (WHERE kind = 'P'), 0) AS BIGINT) AS ytd,
             count(*) FILTER (WHERE kind = 'P') AS np, count(*) FILTER (WHERE kind = 'D') AS nd
      FROM x_led GROUP BY w_id, d_id, c_id) l
JOIN x_cust c ON c.c_w_id = l.w_id AND c.c_d_id = l.d_id AND c.c_id = l.c_id""",

    "replay_ytd": RB + """
, x_d AS (
  SELECT d_w_id AS w_id, d_id, coalesce((SELECT sum(amount) FROM x_pay p WHERE p.w_id = d_w_id AND p.d_id = x_dist.d_id), 0) AS s
  FROM x_dist)
SELECT w_id, d_id, CAST(s * 100 AS BIGINT) AS d_ytd_cents,
       CAST(sum(s) OVER (PARTITION BY w_id) * 100 AS BIGINT) AS w_ytd_cents
FROM x_d""",

    "replay_reads": with_ctes(BASE, LOG, DELIVERY_SIM) + """
SELECT r.ord, r.w_id, r.d_id, r.c_id,
       greatest((SELECT max(o_id) FROM x_ord o WHERE o.o_w_id = r.w_id AND o.o_d_id = r.d_id AND o.o_c_id = r.c_id),
                (SELECT max(o_id) FROM x_oid n WHERE n.w_id = r.w_id AND n.d_id = r.d_id AND n.c_id = r.c_id
                   AND n.ord < r.ord)) AS o_id,
       CAST(c.c_balance * 100 AS BIGINT)
         - coalesce((SELECT CAST(sum(amount) * 100 AS BIGINT) FROM x_pay p
                     WHERE p.w_id = r.w_id AND p.d_id = r.d_id AND p.c_id = r.c_id AND p.ord < r.ord), 0)
         + coalesce((SELECT sum(amount_cents) FROM x_deliv x
                     WHERE x.w_id = r.w_id AND x.d_id = r.d_id AND x.c_id = r.c_id AND x.o_id IS NOT NULL
                       AND x.ord < r.ord), 0) AS balance_cents
FROM x_stat r JOIN x_cust c ON c.c_w_id = r.w_id AND c.c_d_id = r.d_id AND c.c_id = r.c_id""",

    "replay_errors": RB + """
SELECT event_id * 2 + 1 AS ord, ['N', 'N', 'P', 'D', 'S', 'I', 'R', 'N', 'P', 'O'][event_id % 10 + 1] AS txn_type,
       ['unknown customer', 'unknown item', 'unknown customer', 'unknown warehouse', 'unknown district', 'unknown district',
        'unknown customer', 'quantity below 1', 'amount not above 0', 'unknown customer'][event_id % 10 + 1] AS reason
FROM events WHERE event_type = 'error'
UNION ALL SELECT ord, 'P', 'amount not above 0' FROM x_pay WHERE amount <= 0
UNION ALL SELECT DISTINCT ord, 'N', 'quantity below 1' FROM x_nl WHERE qty < 1""",

    # balances added up for every customer at every place
    "replay_top_balance": with_ctes(BASE, LOG, DELIVERY_SIM) + """
, x_led AS (
  SELECT ord, c_id, -CAST(amount * 100 AS BIGINT) AS delta FROM x_pay
  UNION ALL SELECT ord, c_id, amount_cents FROM x_deliv WHERE o_id IS NOT NULL),
x_t AS (SELECT ord FROM x_asks WHERE kind = 'T'),
x_sums AS (SELECT t.ord, c_id, sum(delta) AS s FROM x_t t JOIN x_led l ON l.ord < t.ord GROUP BY t.ord, c_id),
x_bal AS (
  SELECT t.ord AS req_id, c.*, CAST(c.c_balance * 100 AS BIGINT) + coalesce(s.s, 0) AS c_balance_cents
  FROM x_t t CROSS JOIN x_cust c LEFT JOIN x_sums s ON s.ord = t.ord AND s.c_id = c.c_id)
SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY c_balance_cents DESC, c_w_id, c_d_id, c_id) AS INTEGER) AS rank,
       c_w_id, c_d_id, c_id, c_first, c_middle, c_last, CAST(c_balance_cents AS BIGINT) AS c_balance_cents, w_name, d_name
FROM x_bal LEFT JOIN x_wh w ON w.w_id = c_w_id LEFT JOIN x_dist d ON d.d_w_id = c_w_id AND d.d_id = c_d_id
QUALIFY rank <= 10""",

    "replay_related": RB + """
, x_oi AS (
  SELECT DISTINCT ol_w_id AS w, ol_d_id AS d, ol_o_id AS o, ol_i_id AS i, o_c_id AS c, -1 AS since
  FROM x_ol JOIN x_ord ON o_w_id = ol_w_id AND o_d_id = ol_d_id AND o_id = ol_o_id
  UNION ALL
  SELECT DISTINCT l.w_id, l.d_id, l.o_id, l.i_id, o.c_id, l.ord FROM x_lines l JOIN x_oid o ON o.ord = l.ord),
x_r AS (SELECT * FROM x_asks WHERE kind = 'R'),
x_op AS (
  SELECT a.w AS aw, a.c AS ac, b.w AS bw, b.d AS bd, b.c AS bc, any_value(a.since) AS s1, any_value(b.since) AS s2
  FROM x_oi a JOIN x_oi b ON a.i = b.i AND a.w <> b.w
  WHERE a.c IN (SELECT c_id FROM x_r)
  GROUP BY a.w, a.d, a.c, a.o, b.w, b.d, b.c, b.o HAVING count(*) >= 2)
SELECT DISTINCT r.ord AS req_id, bw AS w_id, bd AS d_id, bc AS c_id
FROM x_r r JOIN x_op ON ac = r.c_id AND aw = r.w_id AND s1 < r.ord AND s2 < r.ord""",

    # the latest order, and its carrier from the deliveries simulated step by step
    "replay_order_status": with_ctes(BASE, LOG, DELIVERY_SIM) + f"""
, x_all AS (
  SELECT o_w_id AS w_id, o_d_id AS d_id, o_id, o_c_id AS c_id, -1 AS since, o_carrier_id AS carrier,
         strftime(o_entry_d, {TS}) AS entry FROM x_ord
  UNION ALL SELECT w_id, d_id, o_id, c_id, ord, NULL, '2000-01-01 00:00:00.000' FROM x_oid),
x_last AS (
  SELECT r.ord, r.w_id, r.d_id, r.c_id, max(o_id) AS o_id
  FROM x_stat r LEFT JOIN x_all a ON a.w_id = r.w_id AND a.d_id = r.d_id AND a.c_id = r.c_id AND a.since < r.ord
  GROUP BY r.ord, r.w_id, r.d_id, r.c_id),
x_al AS (
  SELECT ol_w_id AS w_id, ol_d_id AS d_id, ol_o_id AS o_id, ol_number, ol_i_id, ol_supply_w_id, ol_quantity, ol_amount, ol_delivery_d
  FROM x_olsup
  UNION ALL SELECT w_id, d_id, o_id, ol_number, i_id, supply_w_id, qty, amount, NULL FROM x_lines2),
x_bal AS (
  SELECT r.ord, CAST(c.c_balance * 100 AS BIGINT)
         - coalesce((SELECT CAST(sum(amount) * 100 AS BIGINT) FROM x_pay p WHERE p.c_id = r.c_id AND p.ord < r.ord), 0)
         + coalesce((SELECT sum(amount_cents) FROM x_deliv x WHERE x.c_id = r.c_id AND x.o_id IS NOT NULL AND x.ord < r.ord), 0) AS bal
  FROM x_stat r JOIN x_cust c ON c.c_id = r.c_id)
SELECT l.ord AS req_id, l.w_id AS c_w_id, l.d_id AS c_d_id, l.c_id, c.c_first, c.c_middle, c.c_last,
       CAST(b.bal AS BIGINT) AS c_balance_cents, l.o_id, a.entry AS o_entry_d, coalesce(dv.carrier_id, a.carrier) AS o_carrier_id,
       al.ol_number, al.ol_i_id, al.ol_supply_w_id, al.ol_quantity, CAST(al.ol_amount * 100 AS BIGINT) AS ol_amount_cents,
       CASE WHEN al.ol_number IS NOT NULL THEN
         CASE WHEN dv.carrier_id IS NOT NULL THEN '2000-01-01 00:00:00.000' ELSE strftime(al.ol_delivery_d, {TS}) END END AS ol_delivery_d
FROM x_last l JOIN x_cust c ON c.c_id = l.c_id JOIN x_bal b ON b.ord = l.ord
LEFT JOIN x_all a ON a.w_id = l.w_id AND a.d_id = l.d_id AND a.o_id = l.o_id
LEFT JOIN x_deliv dv ON dv.w_id = l.w_id AND dv.d_id = l.d_id AND dv.o_id = l.o_id AND dv.ord < l.ord
LEFT JOIN x_al al ON al.w_id = l.w_id AND al.d_id = l.d_id AND al.o_id = l.o_id""",

    "replay_stock_level": RB + AS_OF + """
SELECT r.req_id, r.w_id, r.d_id, CAST(coalesce(s.n, 0) AS BIGINT) AS items_below
FROM x_asreq r LEFT JOIN (
  SELECT req_id, count(*) FILTER (WHERE coalesce(after, q0) < 60) AS n
  FROM (SELECT i.req_id, i.i_id, any_value(10 + (((i.i_id * 7 + i.w_id * 13) % 91) + 91) % 91) AS q0,
               arg_max(l.s_after, (l.ord, l.ol_number)) AS after
        FROM (SELECT DISTINCT req_id, w_id, i_id FROM x_asl) i
        LEFT JOIN x_lines2 l ON l.supply_w_id = i.w_id AND l.i_id = i.i_id AND l.ord < i.req_id
        GROUP BY i.req_id, i.i_id)
  GROUP BY req_id) s ON s.req_id = r.req_id""",

    "replay_popular_items": RB + AS_OF + """
SELECT req_id, count(DISTINCT o_id) AS n_orders, count(DISTINCT i_id) AS n_items, CAST(sum(qty) AS BIGINT) AS sum_qty
FROM (SELECT DISTINCT req_id, o_id, i_id, qty
      FROM (SELECT *, max(qty) OVER (PARTITION BY req_id, o_id) AS mq FROM x_asl) WHERE qty = mq)
GROUP BY req_id""",
}

ORACLE.update(REPLAY)


# --- checks, metrics, log, reports, ledger ----------------------------------------

MEAS = """
x_m AS (SELECT CAST(((user_id % 20) + 20) % 20 AS INTEGER) AS client, event_type AS txn_type,
               CAST(value AS DECIMAL(18,9)) AS elapsed FROM events),
x_ms AS (SELECT client, txn_type, elapsed,
                row_number() OVER (PARTITION BY client ORDER BY elapsed) - 1 AS ix,
                count(*) OVER (PARTITION BY client) AS n,
                row_number() OVER (PARTITION BY client, txn_type ORDER BY elapsed) - 1 AS tix,
                count(*) OVER (PARTITION BY client, txn_type) AS tn
         FROM x_m),
x_sum AS (
  SELECT client, count(*) AS n, CAST(sum(elapsed) AS DOUBLE) AS total_s,
         count(*) / CAST(sum(elapsed) AS DOUBLE) AS throughput, CAST(sum(elapsed) AS DOUBLE) / count(*) AS mean_s,
         CAST(max(elapsed) FILTER (WHERE ix = n * 50 // 100) AS DOUBLE) AS median_s,
         CAST(max(elapsed) FILTER (WHERE ix = n * 95 // 100) AS DOUBLE) AS p95_s,
         CAST(max(elapsed) FILTER (WHERE ix = n * 99 // 100) AS DOUBLE) AS p99_s
  FROM x_ms GROUP BY client),
x_typ AS (
  SELECT client, txn_type, count(*) AS n,
         count(*) / CAST(sum(elapsed) AS DOUBLE) AS throughput, CAST(sum(elapsed) AS DOUBLE) / count(*) AS mean_s,
         CAST(max(elapsed) FILTER (WHERE tix = tn * 50 // 100) AS DOUBLE) AS median_s,
         CAST(max(elapsed) FILTER (WHERE tix = tn * 99 // 100) AS DOUBLE) AS p99_s
  FROM x_ms GROUP BY client, txn_type HAVING sum(elapsed) > 0)"""

_PK = [("region", ["r_regionkey"]), ("nation", ["n_nationkey"]), ("customer", ["c_custkey"]),
       ("supplier", ["s_suppkey"]), ("part", ["p_partkey"]), ("orders", ["o_orderkey"]),
       ("lineitem", ["l_orderkey", "l_linenumber"]), ("events", ["event_id"])]
_FK = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
       ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


def _pk_sql() -> str:
    parts = []
    for t, keys in _PK:
        k = " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in keys)
        parts.append(f"SELECT '{t}' AS tbl, {k} AS key, count(*) AS n FROM {t} "
                     f"GROUP BY {', '.join(keys)} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


def _fk_sql(kept: dict[str, str] | None = None) -> str:
    """``kept``: condition of the parent rows that are not missing, by table."""
    parts = []
    for c, cc, p, pc in _FK:
        where = (kept or {}).get(p, "true")
        also = (kept or {}).get(c, "true")
        parts.append(f"SELECT '{c}->{p}' AS fk, CAST({cc} AS VARCHAR) AS key, count(*) AS n_rows FROM {c} "
                     f"WHERE {cc} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL AND {where}) AND {cc} IS NOT NULL AND {also} "
                     f"GROUP BY {cc}")
    return "\nUNION ALL\n".join(parts)


def _money_text(col: str) -> str:
    return (f"(CASE WHEN {col} < 0 THEN '-' ELSE '' END || CAST(abs({col}) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({col}) % 100 AS VARCHAR), 2, '0'))")


MISC = {
    "check_pk": _pk_sql(),
    "check_fk": _fk_sql(),
    "check_fk_orphans": _fk_sql({"customer": "c_custkey % 7 <> 0", "part": "p_partkey % 11 <> 0"}),
    "latency_summary": "WITH " + MEAS + "\nSELECT * FROM x_sum",
    "latency_by_type": "WITH " + MEAS + "\nSELECT * FROM x_typ",
    "throughput_fleet": "WITH " + MEAS + """
SELECT txn_type, min(throughput) AS min_tput, max(throughput) AS max_tput, round(avg(throughput), 6) AS avg_tput,
       count(*) AS n_clients
FROM (SELECT 'ALL' AS txn_type, throughput FROM x_sum UNION ALL SELECT txn_type, throughput FROM x_typ)
GROUP BY txn_type""",
    "measure_log": "WITH " + MEAS + "\nSELECT * FROM x_sum",
    "measure_log_types": "WITH " + MEAS + "\nSELECT * FROM x_typ",
    "log_records": RB + """
, x_rec AS (
  SELECT ord, 'N' AS txn_type, w_id, d_id, c_id, NULL AS carrier_id, NULL AS threshold, NULL AS last_l, NULL AS amount_cents,
         (SELECT count(*) FROM x_nl WHERE x_nl.ord = x_n.ord) AS n_lines FROM x_n
  UNION ALL SELECT ord, 'P', w_id, d_id, c_id, NULL, NULL, NULL, CAST(amount * 100 AS BIGINT), NULL FROM x_pay
  UNION ALL SELECT ord, 'D', w_id, NULL, NULL, carrier_id, NULL, NULL, NULL, NULL FROM x_dlv
  UNION ALL SELECT ord, 'O', w_id, d_id, c_id, NULL, NULL, NULL, NULL, NULL FROM x_stat
  UNION ALL SELECT ord, kind, CASE WHEN kind <> 'T' THEN w_id END, CASE WHEN kind <> 'T' THEN d_id END,
                   CASE WHEN kind = 'R' THEN c_id END, NULL, CASE WHEN kind = 'S' THEN 60 END,
                   CASE WHEN kind IN ('S', 'I') THEN 20 END, NULL, NULL FROM x_asks)
SELECT row_number() OVER (ORDER BY x_rec.ord) AS seq, x_rec.* EXCLUDE (ord), l.line_sum, l.supply_sum, NULL AS reason
FROM x_rec LEFT JOIN (SELECT ord, CAST(sum(ol_number * (i_id * 100 + qty)) AS BIGINT) AS line_sum,
                             CAST(sum(ol_number * supply_w_id) AS BIGINT) AS supply_sum FROM x_nl GROUP BY ord) l
  ON l.ord = x_rec.ord""",
    "txlog_counts": RB + """
SELECT 'N' AS txn_type, (SELECT count(*) FROM x_n) AS n_records, (SELECT count(*) FROM x_nl) AS n_lines
UNION ALL SELECT 'P', (SELECT count(*) FROM x_pay), 0
UNION ALL SELECT 'D', (SELECT count(*) FROM x_dlv), 0
UNION ALL SELECT 'O', (SELECT count(*) FROM x_stat), 0""",
    "ledger_post": """
WITH x_nc AS (SELECT count(*) AS n FROM customer),
x_tr AS (SELECT ((user_id % n) + n) % n AS f, ((event_id % n) + n) % n AS t,
                CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) AS a
         FROM events, x_nc),
x_post AS (SELECT f AS acct, -a AS d FROM x_tr UNION ALL SELECT t, a FROM x_tr)
SELECT c_custkey AS acct, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT) + coalesce(s, 0) AS balance_cents,
       coalesce(np, 0) AS n_postings
FROM customer LEFT JOIN (SELECT acct, sum(d) AS s, count(*) AS np FROM x_post GROUP BY acct) p
  ON p.acct = c_custkey""",
    "check_invariants": with_ctes(BASE, LOG, DELIVERY_SIM) + """
, x_ytd AS (
  SELECT d_w_id AS w_id, d_id,
         CAST(coalesce((SELECT sum(amount) FROM x_pay p WHERE p.w_id = d_w_id AND p.d_id = x_dist.d_id), 0) * 100
              AS BIGINT) AS d_ytd_cents
  FROM x_dist)
SELECT 'o_id_dense' AS "check", g.w_id, g.d_id, CAST(g.lo AS VARCHAR) || ',' || CAST(g.hi AS VARCHAR) || ',' ||
       CAST(g.n AS VARCHAR) AS detail
FROM (SELECT w_id, d_id, min(o_id) AS lo, max(o_id) AS hi, count(*) AS n FROM x_oid GROUP BY w_id, d_id) g
JOIN x_dist d ON d.d_w_id = g.w_id AND d.d_id = g.d_id
WHERE g.lo <> d.d_next_o_id OR g.hi - g.lo + 1 <> g.n
UNION ALL
SELECT 'delivered_once', w_id, d_id, CAST(o_id AS VARCHAR) || ',' || CAST(count(*) AS VARCHAR)
FROM x_deliv WHERE o_id IS NOT NULL GROUP BY w_id, d_id, o_id HAVING count(*) > 1
UNION ALL
SELECT 'stock_range', w_id, d_id, CAST(supply_w_id AS VARCHAR) || ',' || CAST(i_id AS VARCHAR) || ',' ||
       CAST(s_after AS VARCHAR)
FROM x_lines2 WHERE s_after < 10 OR s_after > 109
UNION ALL
SELECT 'ytd_balance', y.w_id, CAST(NULL AS INTEGER), CAST(sum(y.d_ytd_cents) AS VARCHAR) || ',' || CAST(max(p.a) AS VARCHAR)
FROM x_ytd y JOIN (SELECT w_id, CAST(sum(amount) * 100 AS BIGINT) AS a FROM x_pay GROUP BY w_id) p ON p.w_id = y.w_id
GROUP BY y.w_id HAVING sum(y.d_ytd_cents) <> max(p.a)""",

    # the final state, from the records of the whole log at once
    "chain_two_batches": with_ctes(BASE, LOG, DELIVERY_SIM) + """
, x_led AS (
  SELECT w_id, d_id, c_id, -CAST(amount * 100 AS BIGINT) AS delta, 1 AS np, 0 AS nd FROM x_pay
  UNION ALL SELECT w_id, d_id, c_id, amount_cents, 0, 1 FROM x_deliv WHERE o_id IS NOT NULL),
x_bal AS (SELECT w_id, d_id, c_id, sum(delta) AS d, sum(np) AS np, sum(nd) AS nd FROM x_led GROUP BY w_id, d_id, c_id),
x_sent AS (SELECT w_id, d_id, o_id, carrier_id FROM x_deliv WHERE o_id IS NOT NULL),
x_allo AS (
  SELECT o_w_id AS w_id, o_d_id AS d_id, o_id, o_c_id AS c_id, o_carrier_id AS carrier FROM x_ord
  UNION ALL SELECT w_id, d_id, o_id, c_id, NULL FROM x_oid),
x_fino AS (
  SELECT o.w_id, o.d_id, o.o_id, o.c_id, coalesce(s.carrier_id, o.carrier) AS carrier
  FROM x_allo o LEFT JOIN x_sent s ON s.w_id = o.w_id AND s.d_id = o.d_id AND s.o_id = o.o_id),
x_finl AS (
  SELECT ol_w_id AS w_id, ol_d_id AS d_id, ol_o_id AS o_id, ol_amount AS amount FROM x_ol
  UNION ALL SELECT w_id, d_id, o_id, amount FROM x_lines2)
SELECT 'customer' AS tbl, c_w_id AS w_id, c_d_id AS d_id, x_cust.c_id AS id,
       CAST(CAST(c_balance * 100 AS BIGINT) + coalesce(b.d, 0) AS BIGINT) AS v1, CAST(coalesce(b.np, 0) AS BIGINT) AS v2,
       CAST(coalesce(b.nd, 0) AS BIGINT) AS v3
FROM x_cust LEFT JOIN x_bal b ON b.w_id = c_w_id AND b.d_id = c_d_id AND b.c_id = x_cust.c_id
UNION ALL
SELECT 'district', d_w_id, d_id, 0,
       d_next_o_id + (SELECT count(*) FROM x_n WHERE x_n.w_id = d_w_id AND x_n.d_id = x_dist.d_id),
       CAST(coalesce((SELECT sum(amount) FROM x_pay p WHERE p.w_id = d_w_id AND p.d_id = x_dist.d_id), 0) * 100 AS BIGINT), 0
FROM x_dist
UNION ALL
SELECT 'warehouse', x_wh.w_id, 0, 0,
       CAST(coalesce((SELECT sum(amount) FROM x_pay p WHERE p.w_id = x_wh.w_id), 0) * 100 AS BIGINT), 0, 0
FROM x_wh
UNION ALL SELECT 'order', w_id, d_id, o_id, c_id, carrier, 0 FROM x_fino
UNION ALL
SELECT 'lines', l.w_id, l.d_id, l.o_id, count(*), CAST(sum(l.amount) * 100 AS BIGINT), count(o.carrier)
FROM x_finl l JOIN x_fino o ON o.w_id = l.w_id AND o.d_id = l.d_id AND o.o_id = l.o_id GROUP BY l.w_id, l.d_id, l.o_id
UNION ALL
SELECT 'stock', supply_w_id, 0, i_id,
       CAST(list_reduce(list(qty ORDER BY ord, ol_number), lambda q, x: CASE WHEN q - x < 10 THEN q - x + 100 ELSE q - x END,
                        any_value(q0)) AS BIGINT), CAST(sum(qty) AS BIGINT), count(*)
FROM x_lines GROUP BY supply_w_id, i_id""",

    # the seeded faults, from the state before the log
    "audit_snapshots": RB + """
, x_gone AS (SELECT o_w_id, o_d_id, o_id FROM x_ord WHERE o_carrier_id IS NOT NULL AND o_id % 59 = 0),
x_kept AS (SELECT * FROM x_ord WHERE NOT (o_carrier_id IS NOT NULL AND o_id % 59 = 0)),
x_keptl AS (SELECT x_ol.* FROM x_ol ANTI JOIN x_gone ON ol_w_id = o_w_id AND ol_d_id = o_d_id AND ol_o_id = o_id),
x_keptc AS (SELECT * FROM x_cust WHERE c_id % 97 <> 0)
SELECT 'district_lost' AS "check", d_w_id AS w_id, d_id, CAST(NULL AS BIGINT) AS id FROM x_dist WHERE d_w_id = 3 AND d_id = 1
UNION ALL SELECT 'next_o_id_falls', d_w_id, d_id, NULL FROM x_dist WHERE d_id = 2
UNION ALL SELECT 'orders_added', d_w_id, d_id, NULL FROM x_dist WHERE d_id = 2
UNION ALL SELECT 'ytd_change', w_id, NULL, NULL FROM x_wh
WHERE w_id = 2 OR w_id = 3 AND coalesce((SELECT sum(amount) FROM x_pay p WHERE p.w_id = 3 AND p.d_id = 1), 0) <> 0
UNION ALL SELECT 'customer_lost', c_w_id, c_d_id, c_id FROM x_cust WHERE c_id % 97 = 0
UNION ALL SELECT 'balance_change', c_w_id, c_d_id, c_id FROM x_keptc WHERE c_id % 89 = 0
UNION ALL SELECT 'delivery_count', c_w_id, c_d_id, c_id FROM x_keptc WHERE c_id % 83 = 0
UNION ALL SELECT 'payment_count', c_w_id, c_d_id, c_id FROM x_keptc WHERE c_id % 79 = 0
UNION ALL SELECT 'order_lost', o_w_id, o_d_id, o_id FROM x_gone
UNION ALL SELECT 'carrier_changed', o_w_id, o_d_id, o_id FROM x_kept WHERE o_carrier_id IS NOT NULL AND o_id % 53 = 0
UNION ALL SELECT 'order_changed', o_w_id, o_d_id, o_id FROM x_kept WHERE o_id % 71 = 0
UNION ALL SELECT 'line_lost', ol_w_id, ol_d_id, ol_o_id FROM x_ol
SEMI JOIN x_gone ON ol_w_id = o_w_id AND ol_d_id = o_d_id AND ol_o_id = o_id
UNION ALL SELECT 'line_changed', ol_w_id, ol_d_id, ol_o_id FROM x_keptl WHERE ol_o_id % 47 = 0 AND ol_number = 1""",
}

def _rate_text(col: str) -> str:
    return f"('0.' || lpad(CAST({col} AS VARCHAR), 4, '0'))"


TAB = "chr(9) || "


def _report(source: str, lines: list[tuple[str, str]], ord_col: str = "ord") -> str:
    """One SELECT for each (line number, text) over the rows of ``source``."""
    return "\nUNION ALL ".join(f"SELECT {ord_col} AS ord, CAST({n} AS INTEGER) AS line_no, {text} AS text FROM {source}" for n, text in lines)


def _addressed(prefix: str, name: str) -> str:
    return " || ', ' || ".join(f"'{name}_{a.upper()}=' || {prefix}_{a}" for a in _OWN)


_TUPLE = " || ', ' || "
MISC["report_lines"] = RB + PAID + "\n" + _report("x_paid", [
    (0, f"printf('P %d %d %d ', w_id, d_id, c_id) || {_money_text('amount_cents')}"),
    (1, TAB + "'(a) Customer information:'"),
    (2, TAB + TAB + "printf('Identifier: (C_W_ID,C_D_ID,C_ID)=(%d, %d, %d)', w_id, d_id, c_id)"),
    (3, TAB + TAB + "printf('Name: (C_FIRST,C_MIDDLE,C_LAST)=(%s, %s, %s)', c_first, c_middle, c_last)"),
    (4, TAB + TAB + "'Address: (C_STREET_1,C_STREET_2,C_CITY,C_STATE,C_ZIP)=(' || "
        + _TUPLE.join(f"c_{a}" for a in _OWN) + " || ')'"),
    (5, TAB + TAB + f"'Other info: C_PHONE=' || c_phone || ', C_SINCE=' || substr(c_since, 1, 19) || ', C_CREDIT=' || c_credit "
        f"|| ', C_CREDIT_LIM=' || {_money_text('c_credit_lim_cents')} || ', C_DISCOUNT=' || {_money_text('((c_discount_bp + 50) // 100)')} "
        f"|| ', C_BALANCE=' || {_money_text('balance_after_cents')}"),
    (6, TAB + "'(b) Warehouse information:'"), (7, TAB + TAB + _addressed("w", "W")),
    (8, TAB + "'(c) District information:'"), (9, TAB + TAB + _addressed("d", "D")),
    (10, TAB + f"'(d) Payment: ' || {_money_text('amount_cents')}")])

MISC["new_order_report"] = RB + """
, x_tot AS (
  SELECT o.ord, o.w_id, o.d_id, o.o_id, o.c_id, c.c_last, c.c_credit,
         CAST(c.c_discount * 10000 AS INTEGER) AS c_bp, CAST(w.w_tax * 10000 AS INTEGER) AS w_bp,
         CAST(d.d_tax * 10000 AS INTEGER) AS d_bp, coalesce(a.n, 0) AS n_items,
         CAST(round(CAST(coalesce(a.s, 0) AS DECIMAL(18,2)) * (1 + d.d_tax + w.w_tax) * (1 - c.c_discount), 2) * 100
              AS BIGINT) AS total_cents
  FROM x_oid o
  LEFT JOIN (SELECT ord, sum(amount) AS s, count(*) AS n FROM x_lines2 GROUP BY ord) a ON a.ord = o.ord
  JOIN x_cust c ON c.c_w_id = o.w_id AND c.c_d_id = o.d_id AND c.c_id = o.c_id
  JOIN x_wh w ON w.w_id = o.w_id
  JOIN x_dist d ON d.d_w_id = o.w_id AND d.d_id = o.d_id),
x_item_rows AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.ord ORDER BY ol_number) AS k, t.n_items
  FROM x_lines2 l JOIN x_tot t ON t.ord = l.ord)
""" + _report("x_tot", [
    (0, "printf('N %d %d %d', w_id, d_id, c_id)"),
    ("n_items + 1", TAB + "printf('Customer identifier (W_ID: %d, D_ID: %d, C_ID: %d), C_LAST: %s, C_CREDIT: %s, C_DISCOUNT: ', "
     "w_id, d_id, c_id, c_last, c_credit) || " + _rate_text("c_bp")),
    ("n_items + 2", TAB + f"'W_TAX: ' || {_rate_text('w_bp')} || ', D_TAX: ' || {_rate_text('d_bp')}"),
    ("n_items + 3", TAB + "printf('O_ID: %d, O_ENTRY_D: 2000-01-01 00:00:00', o_id)"),
    ("n_items + 4", TAB + f"printf('NUM_ITEMS: %d, TOTAL_AMOUNT: ', n_items) || {_money_text('total_cents')}"),
]) + "\nUNION ALL " + _report("x_item_rows", [
    ("k", "printf('%d,%d,%d', i_id, supply_w_id, qty)"),
    ("n_items + 4 + k", TAB + "printf('ITEM_NUMBER: %d, I_NAME: %s, SUPPLIER_WAREHOUSE: %d, QUANTITY: %d, OL_AMOUNT: ', i_id, i_name, "
     f"supply_w_id, qty) || {_money_text('CAST(amount * 100 AS BIGINT)')} || printf(', S_QUANTITY: %d', CAST(s_after AS INTEGER))")])

MISC["report_deliveries"] = RB + "\n" + _report("x_dlv", [(0, "printf('D %d %d', w_id, carrier_id)")])

MISC["report_order_status"] = f"""
WITH x_os AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY ol_number) AS k FROM ({REPLAY['replay_order_status']}))
""" + _report("x_os WHERE k = 1", [
    (0, "printf('O %d %d %d', c_w_id, c_d_id, c_id)"),
    (1, TAB + "printf('(a) Customer name & balance: (C_FIRST,C_MIDDLE,C_LAST)=(%s, %s, %s), C_BALANCE: ', c_first, c_middle, c_last) || "
     + _money_text("c_balance_cents"))], "req_id") + "\nUNION ALL " + _report("x_os WHERE k = 1 AND o_id IS NOT NULL", [
    (2, TAB + "printf('(b) O_ID: %d, O_ENTRY_D: ', o_id) || substr(o_entry_d, 1, 19) || ', O_CARRIER_ID: ' || "
     "coalesce(CAST(o_carrier_id AS VARCHAR), 'null')"),
    (3, TAB + "printf('(c) For each item in the order %d', o_id)")], "req_id") + "\nUNION ALL " + _report("x_os WHERE ol_number IS NOT NULL", [
    ("3 + k", TAB + TAB + "printf('OL_I_ID: %d, OL_SUPPLY_W_ID: %d, OL_QUANTITY: %d, OL_AMOUNT: ', ol_i_id, ol_supply_w_id, ol_quantity) || "
     + _money_text("ol_amount_cents") + " || ', OL_DELIVER_D: ' || coalesce(substr(ol_delivery_d, 1, 19), 'null')")], "req_id")


def _asked(kind: str, sql: str) -> str:
    """A query on every order-status record, asked by the records of ``kind`` instead."""
    return sql.replace("FROM x_stat s JOIN", f"FROM (SELECT * FROM x_asks WHERE kind = '{kind}') s JOIN")


MISC["report_stock_level"] = f"WITH x_sl AS ({_asked('S', REPLAY['replay_stock_level'])})\n" + _report("x_sl", [
    (0, "printf('S %d %d 20 60', w_id, d_id)"),
    (1, TAB + "printf('Total number of items in S where its stock quantity at W_ID is below the threshold: %d', items_below)")], "req_id")

MISC["report_popular_items"] = RB + _asked("I", AS_OF) + f""",
x_exam AS (
  SELECT r.req_id, r.w_id, r.d_id, o.* EXCLUDE (w, d)
  FROM x_asreq r JOIN (
    SELECT o_w_id AS w, o_d_id AS d, o_id, o_c_id, strftime(o_entry_d, '%Y-%m-%d %H:%M:%S') AS entry FROM x_ord
    UNION ALL SELECT w_id, d_id, o_id, c_id, '2000-01-01 00:00:00' FROM x_oid) o
  ON o.w = r.w_id AND o.d = r.d_id AND o.o_id >= r.o_hi - 20 AND o.o_id < r.o_hi),
x_tied AS (
  SELECT t.req_id, t.o_id, t.i_id, t.qty, it.i_name
  FROM (SELECT *, max(qty) OVER (PARTITION BY req_id, o_id) AS mq FROM x_asl) t JOIN x_item it ON it.i_id = t.i_id WHERE qty = mq),
x_share AS (
  SELECT t.req_id, i_name, count(*) AS n, any_value(e.n) AS n_exam
  FROM x_tied t JOIN (SELECT req_id, count(*) AS n FROM x_exam GROUP BY req_id) e ON e.req_id = t.req_id GROUP BY t.req_id, i_name),
x_text AS (
  SELECT req_id, 0 AS s, 0 AS o, 0 AS j, 0 AS i, '' AS name, printf('I %d %d 20', w_id, d_id) AS text FROM x_asreq
  UNION ALL SELECT req_id, 0, 0, 1, 0, '', {TAB}printf('District identifier: (%d, %d)', w_id, d_id) FROM x_asreq
  UNION ALL SELECT req_id, 0, 0, 2, 0, '', {TAB}'Number of last orders to be examined: 20' FROM x_asreq
  UNION ALL SELECT req_id, 1, o_id, 0, 0, '', {TAB}printf('(a) Order number:(%d) & entry date and time (%s)', o_id, entry) FROM x_exam
  UNION ALL SELECT req_id, 1, o_id, 1, 0, '', {TAB}printf('(b) Name of customer who placed this order (%s, %s, %s)', c_first, c_middle, c_last)
            FROM x_exam JOIN x_cust c ON c.c_id = o_c_id
  UNION ALL SELECT req_id, 1, o_id, 2, 0, '', {TAB}printf('(c) For each popular item in order %d:', o_id) FROM x_exam
  UNION ALL SELECT DISTINCT req_id, 1, o_id, 3, i_id, '', {TAB}{TAB}printf('Item name: %s, Quantity ordered: %d', i_name, qty) FROM x_tied
  UNION ALL SELECT req_id, 2, 0, 0, 0, '', {TAB}'(d) For each distinct popular item:' FROM x_asreq
  UNION ALL SELECT req_id, 3, 0, 0, 0, i_name, {TAB}{TAB}printf('Item name: %s, Occurring percentage: ', i_name)
                   || {_money_text('((n * 20000 + n_exam) // (2 * n_exam))')} || '%' FROM x_share)
SELECT req_id AS ord, CAST(row_number() OVER (PARTITION BY req_id ORDER BY s, o, j, i, name) - 1 AS INTEGER) AS line_no, text FROM x_text"""

MISC["report_top_balance"] = RB + f"""
, x_tb AS (SELECT * FROM ({REPLAY['replay_top_balance']})),
x_places AS (SELECT ord FROM x_asks WHERE kind = 'T')
""" + _report("x_places", [(0, "'T'")]) + "\nUNION ALL " + _report("x_tb", [
    ("rank * 4 - 3", TAB + "printf('(a) Name of Customer: (%s, %s, %s)', c_first, c_middle, c_last)"),
    ("rank * 4 - 2", TAB + f"'(b) Customer''s Balance: ' || {_money_text('c_balance_cents')} || '0000'"),
    ("rank * 4 - 1", TAB + "'(c) Customer''s Warehouse: ' || w_name"),
    ("rank * 4", TAB + "'(d) Customer''s District: ' || d_name")], "req_id")

MISC["report_related"] = RB + f"""
, x_rel AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY c_id, w_id, d_id) AS k FROM ({REPLAY['replay_related']})),
x_rq AS (SELECT ord, w_id, d_id, c_id, ord IN (SELECT req_id FROM x_rel) AS found FROM x_asks WHERE kind = 'R')
""" + _report("x_rq", [
    (0, "printf('R %d %d %d', w_id, d_id, c_id)"),
    (1, TAB + "printf('(a) Customer identifier (%d, %d, %d)', w_id, d_id, c_id)"),
    (2, TAB + "CASE WHEN found THEN '(b) Related customer identifiers:' ELSE '(b) No related customer found' END")
]) + "\nUNION ALL " + _report("x_rel", [("2 + k", TAB + "printf('(%d, %d, %d)', w_id, d_id, c_id)")], "req_id")


_CSV = {  # the files' columns, money in whole cents and rates in 1/10000
    "district": ("x_dist", ["d_w_id", "d_id"], "CAST(d_ytd AS BIGINT)", "CAST(d_tax * 10000 AS BIGINT)",
                 "d_w_id, d_id, d_name, d_street_1, d_street_2, d_city, d_state, d_zip, CAST(d_tax * 10000 AS BIGINT), 0, d_next_o_id"),
    "customer": ("x_cust", ["c_w_id", "c_d_id", "c_id"], "CAST(c_balance * 100 AS BIGINT)", "CAST(c_discount * 10000 AS BIGINT)",
                 "c_w_id, c_d_id, c_id, c_first, c_middle, c_last, c_street_1, c_street_2, c_city, c_state, c_zip, c_phone, "
                 f"strftime(c_since, {TS}), c_credit, CAST(c_credit_lim * 100 AS BIGINT), CAST(c_discount * 10000 AS BIGINT), "
                 "CAST(c_balance * 100 AS BIGINT), 0, 0, 0, 'null'"),
    "item": ("x_item", ["i_id"], "CAST(i_price * 100 AS BIGINT)", "CAST(NULL AS BIGINT)",
             "i_id, i_name, CAST(i_price * 100 AS BIGINT), i_im_id, i_data"),
}


def _csv_sql() -> str:
    parts = []
    for name, (table, keys, money, rate, columns) in _CSV.items():
        if name == "district":
            money = "CAST(0 AS BIGINT)"
        key = f"concat_ws(',', {', '.join(keys)})"
        parts.append(f"SELECT '{name}' AS tbl, {key} AS key, {money} AS money_cents, {rate} AS rate_bp, CAST(NULL AS VARCHAR) AS text FROM {table}")
        parts.append(f"SELECT '{name}', NULL, NULL, NULL, 'x' || concat_ws(',', {columns}) FROM {table} WHERE {keys[-1]} % 7 = 0")
        parts.append(f"SELECT '{name}', NULL, NULL, NULL, concat_ws(',', {columns}) || ',0' FROM {table} WHERE {keys[-1]} % 5 = 0")
    return "\nUNION ALL\n".join(parts)


MISC["csv_tables"] = with_ctes(ALL) + "\n" + _csv_sql()

ORACLE.update(MISC)
