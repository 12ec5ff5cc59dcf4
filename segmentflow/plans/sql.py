"""DuckDB SQL of the shared steps, written as common table expressions."""

from __future__ import annotations

from segmentflow.plans.state import CENTRES, DRIFT, IDS, NAMES

RAW = """raw AS (
    SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey::VARCHAR AS invoice_no,
           l_partkey::VARCHAR AS stock_code,
           CASE WHEN l_partkey % 37 <> 0 THEN p_name END AS description,
           CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
           o_orderdate AS invoice_date,
           CASE WHEN l_partkey % 41 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS unit_price,
           CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS customer_id,
           CASE WHEN l_suppkey % 29 <> 0 THEN n_name END AS country
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
         JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
         JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR l_orderkey % 97 = 0)"""
ARRIVED = RAW.replace("SELECT CASE WHEN l_returnflag", "SELECT 2 * (line_no - 1) + c.copy AS arrival, CASE WHEN l_returnflag", 1).replace(
    "FROM lineitem JOIN", "FROM (SELECT *, row_number() OVER () AS line_no FROM lineitem) JOIN", 1
)
LEDGER = f"""{RAW}, ledger AS (
    SELECT invoice_no, stock_code, coalesce(description, 'Unknown product') AS description, quantity, invoice_date,
           unit_price, customer_id, coalesce(country, 'Unspecified') AS country, quantity * unit_price AS total_price
    FROM (SELECT DISTINCT * FROM raw)
    WHERE customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND invoice_no NOT LIKE 'C%'
      AND invoice_date >= TIMESTAMP '1995-01-01' AND invoice_date < TIMESTAMP '1996-01-01')"""
CALENDAR = """cal AS (
    SELECT n::INTEGER AS cycle_number,
           CASE WHEN n = 0 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1995-04-01' + to_months((n - 1)::INTEGER) END AS period_start,
           TIMESTAMP '1995-04-01' + to_months(n::INTEGER) AS period_end,
           TIMESTAMP '1995-04-01' + to_months(n::INTEGER) - INTERVAL 90 DAY AS window_start
    FROM range(10) AS t(n))"""
BASE = f"{LEDGER}, {CALENDAR}"
PANEL = f"""{BASE}, panel AS (
    SELECT p.*, ln(1 + recency) AS log_r, ln(1 + frequency) AS log_f, ln(1 + monetary) AS log_m,
           CASE WHEN recency > 90 THEN 'Hibernating / Lost' ELSE 'Within 90-day window' END AS lifecycle_status,
           CASE WHEN current_orders > 0 THEN 'Active' ELSE 'Inactive' END AS activity_status,
           CASE WHEN recency <= 30 THEN '0-30 days' WHEN recency <= 60 THEN '31-60 days'
                WHEN recency <= 90 THEN '61-90 days' ELSE '91+ days: hibernating/lost' END AS recency_bucket
    FROM (
        SELECT cycle_number, customer_id, min(invoice_date) AS first_purchase, max(invoice_date) AS latest_purchase,
               count(DISTINCT invoice_no) FILTER (invoice_date >= window_start) / 3.0::DOUBLE AS frequency,
               coalesce(sum(total_price) FILTER (invoice_date >= window_start), 0) / 3 AS monetary,
               count(DISTINCT description) FILTER (invoice_date >= window_start) / 3.0::DOUBLE AS products,
               coalesce(sum(quantity) FILTER (invoice_date >= window_start), 0) / 3 AS window_quantity,
               (count(DISTINCT invoice_no) FILTER (invoice_date >= period_start))::DOUBLE AS current_orders,
               coalesce(sum(total_price) FILTER (invoice_date >= period_start), 0) AS current_revenue,
               (count(DISTINCT description) FILTER (invoice_date >= period_start))::DOUBLE AS current_products,
               coalesce(sum(quantity) FILTER (invoice_date >= period_start), 0) AS current_quantity,
               date_diff('day', max(invoice_date)::DATE, any_value(period_end)::DATE)::INTEGER AS recency,
               (max(invoice_date) >= any_value(window_start))::INTEGER AS bought_in_window,
               (min(invoice_date) >= any_value(period_start))::INTEGER AS is_new
        FROM ledger JOIN cal ON invoice_date < period_end
        GROUP BY cycle_number, customer_id) AS p)"""

_D = ", ".join(
    f"pow(log_r - ({r} + cycle_number * {DRIFT}), 2) + pow(log_f - {f}, 2) + pow(log_m - {m}, 2) AS d{k}"
    for k, (r, f, m) in enumerate(CENTRES)
)
_U = ", ".join(
    f"CASE WHEN cycle_number = 0 THEN (idx = {k})::INTEGER::DOUBLE ELSE (1 / d{k}) / (1 / d0 + 1 / d1 + 1 / d2 + 1 / d3) END AS u{k}"
    for k in range(4)
)


def index_of(names: str = "d0 d1 d2 d3") -> str:
    a, b, c, d = names.split()
    return f"CASE WHEN {a} <= least({b}, {c}, {d}) THEN 0 WHEN {b} <= least({c}, {d}) THEN 1 WHEN {c} <= {d} THEN 2 ELSE 3 END"


def pick(values: tuple[str, ...], index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ASSIGNED = f"""{PANEL}, dist AS (SELECT *, {_D} FROM panel),
indexed AS (SELECT *, {index_of()} AS idx FROM dist),
assigned AS (SELECT *, {_U}, {pick(IDS, 'idx')} AS stable_cluster_id, {pick(NAMES, 'idx')} AS segment_name FROM indexed)"""
STATE = f"""{ASSIGNED}, paired AS (
    SELECT a.*, greatest(a.u0, a.u1, a.u2, a.u3) AS top_membership,
           b.stable_cluster_id AS prev_id, b.segment_name AS prev_name, b.idx AS prev_idx, b.activity_status AS prev_activity,
           b.recency AS prev_recency, b.frequency AS prev_frequency, b.monetary AS prev_monetary,
           b.log_r AS prev_log_r, b.log_f AS prev_log_f, b.log_m AS prev_log_m,
           CASE WHEN b.frequency > 0 THEN a.frequency / b.frequency - 1 END AS frequency_change,
           CASE WHEN b.monetary > 0 THEN a.monetary / b.monetary - 1 END AS monetary_change,
           CASE WHEN a.cycle_number >= 2 AND a.idx = b.idx THEN greatest(a.u0, a.u1, a.u2, a.u3) - greatest(b.u0, b.u1, b.u2, b.u3) END AS membership_change
    FROM assigned a LEFT JOIN assigned b ON b.customer_id = a.customer_id AND b.cycle_number = a.cycle_number - 1),
reasoned AS (
    SELECT *, concat_ws('; ',
        CASE WHEN membership_change <= -0.1 + 1e-12 AND (frequency_change <= -0.25 + 1e-12 OR monetary_change <= -0.25 + 1e-12)
             THEN 'membership fell by 0.10 or more and frequency or spending by 25% or more' END,
        CASE WHEN frequency_change <= -0.5 + 1e-12 AND monetary_change <= -0.5 + 1e-12
             THEN 'frequency and spending both fell by 50% or more' END,
        CASE WHEN recency > 30 THEN 'more than 30 days since the last purchase' END) AS risk_reasons
    FROM paired),
state AS (
    SELECT *, CASE WHEN recency > 90 THEN 'Lost' WHEN recency > 60 THEN 'Slipping' WHEN risk_reasons <> '' THEN 'At risk'
                   WHEN prev_id IS NULL THEN 'No prior comparison' ELSE 'No risk flag' END AS risk_status,
           CASE WHEN is_new = 1 OR prev_id IS NULL THEN 'New' WHEN stable_cluster_id <> prev_id THEN 'Existing Migrated'
                ELSE 'Existing Stable' END AS transition_status
    FROM reasoned)"""
ASOF = """seen AS (
    SELECT customer_id, country, invoice_no, min(invoice_date) AS first_seen FROM ledger GROUP BY ALL),
counted AS (
    SELECT cycle_number, customer_id, country, count(*) AS n FROM seen JOIN cal ON first_seen < period_end GROUP BY ALL),
home AS (
    SELECT cycle_number, customer_id, country, n FROM counted
    QUALIFY row_number() OVER (PARTITION BY cycle_number, customer_id ORDER BY n DESC, country) = 1)"""
ROWS = """labelled AS (
    SELECT s.cycle_number, s.stable_cluster_id, s.segment_name, l.*
    FROM ledger l JOIN cal ON invoice_date >= period_start AND invoice_date < period_end
         JOIN state s ON s.cycle_number = cal.cycle_number AND s.customer_id = l.customer_id)"""
REVERSED = """rows AS (SELECT DISTINCT * FROM raw WHERE customer_id IS NOT NULL AND unit_price > 0),
    ordered AS (SELECT *, row_number() OVER (ORDER BY invoice_date, invoice_no, stock_code, quantity, description, country) AS no FROM rows),
    s AS (SELECT *, sum(quantity) OVER w AS running FROM ordered WINDOW w AS (PARTITION BY customer_id, stock_code, unit_price ORDER BY no)),
    h AS (SELECT *, running - least(min(running) OVER w, 0) AS on_hand FROM s WINDOW w AS (PARTITION BY customer_id, stock_code, unit_price ORDER BY no)),
    c AS (SELECT *, CASE WHEN quantity < 0 THEN coalesce(lag(on_hand) OVER w, 0) - on_hand ELSE 0 END AS consumed FROM h WINDOW w AS (PARTITION BY customer_id, stock_code, unit_price ORDER BY no))"""


def with_(*steps: str) -> str:
    return "WITH " + ", ".join(steps) + "\n"
