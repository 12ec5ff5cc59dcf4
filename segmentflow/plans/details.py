"""Registered customer, product, market and registry reports, and audits of the reports, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.operators import behaviour, cleaning, features, markets, quality, registry, replay, snapshot, summaries, sweep, validity
from segmentflow.operators.calendar import in_periods
from segmentflow.plans import reports, sql
from segmentflow.plans import state as st
from segmentflow.plans.register import day, r, registered

MARKET = "CASE WHEN country < 'I' THEN 'Early' ELSE 'Late' END"


# Customers


@registered(
    "customer_report",
    sql.with_(sql.STATE, sql.ASOF)
    + """SELECT s.cycle_number, s.customer_id, h.country, strftime(first_purchase, '%Y-%m-%d') AS first_purchase, strftime(latest_purchase, '%Y-%m-%d') AS latest_purchase,
       recency, round(frequency, 4) AS frequency, round(monetary, 4) AS monetary, stable_cluster_id, segment_name, prev_name AS previous_segment, b.baseline_segment,
       transition_status, risk_status, risk_reasons, round(current_orders, 4) AS orders, round(current_revenue, 2) AS revenue, round(top_membership, 6) AS top_membership
    FROM state s LEFT JOIN home h ON h.cycle_number = s.cycle_number AND h.customer_id = s.customer_id
    LEFT JOIN (SELECT customer_id, segment_name AS baseline_segment FROM state WHERE cycle_number = 0) b ON b.customer_id = s.customer_id""",
)
def customer_report(spark, sf_dir):
    """Every customer-cycle in full: country, purchases, measures, segment now, before and at the baseline, risk."""
    rows = st.state(spark, sf_dir)
    at_baseline = rows.where("cycle_number = 0").select("customer_id", F.col("segment_name").alias("baseline_segment"))
    home = st.asof(spark, sf_dir).select("cycle_number", "customer_id", "country")
    return rows.join(home, ["cycle_number", "customer_id"], "left").join(at_baseline, "customer_id", "left").select(
        "cycle_number", "customer_id", "country", day("first_purchase"), day("latest_purchase"), "recency", r("frequency"), r("monetary"),
        "stable_cluster_id", "segment_name", F.col("prev_segment_name").alias("previous_segment"), "baseline_segment",
        "transition_status", "risk_status", "risk_reasons", r("current_orders", 4, "orders"), r("current_revenue", 2, "revenue"), r("top_membership", 6),
    )


@registered(
    "customer_top_products",
    sql.with_(sql.LEDGER)
    + """, t AS (SELECT customer_id, description, round(sum(total_price), 2) AS revenue, round(sum(quantity), 4) AS quantity, count(DISTINCT invoice_no) AS orders FROM ledger GROUP BY customer_id, description)
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY revenue DESC, description)::INTEGER AS place FROM t QUALIFY place <= 5""",
)
def customer_top_products(spark, sf_dir):
    """The five products each customer spent most on."""
    totals = st.ledger(spark, sf_dir).groupBy("customer_id", "description").agg(
        r(F.sum("total_price"), 2, "revenue"), r(F.sum("quantity"), 4, "quantity"), F.count_distinct("purchase_invoice_no").alias("orders")
    )
    order = Window.partitionBy("customer_id").orderBy(F.desc("revenue"), "description")
    return totals.withColumn("place", F.row_number().over(order)).where("place <= 5")


@registered(
    "search_hits",
    sql.with_(sql.STATE, sql.ASOF)
    + """, c AS (SELECT customer_id, arg_max(country, cycle_number) AS country FROM home GROUP BY customer_id),
    hits AS (SELECT customer_id, country FROM c WHERE customer_id::VARCHAR ILIKE '%c%' OR country ILIKE '%c%' ORDER BY customer_id LIMIT 25)
    SELECT 'customer' AS kind, customer_id::VARCHAR AS value, country AS detail FROM hits
    UNION ALL SELECT DISTINCT 'segment', segment_name, NULL FROM state WHERE segment_name ILIKE '%c%'
    UNION ALL SELECT DISTINCT 'cycle', 'Cycle_' || cycle_number, NULL FROM state""",
)
def search_hits(spark, sf_dir):
    """Customers, segments and cycles that hold a term; customers by their latest as-of country."""
    customers = st.asof(spark, sf_dir).groupBy("customer_id").agg(F.max_by("country", "cycle_number").alias("country"))
    rows = st.segments(spark, sf_dir)
    return reports.search(customers, rows, rows.select(F.concat(F.lit("Cycle_"), "cycle_number").alias("cycle")), "c")


@registered(
    "assignment_metadata",
    sql.with_(sql.STATE)
    + """, ids AS (SELECT stable_cluster_id, max(cycle_number) AS last_cycle, arg_max(segment_name, cycle_number) AS label FROM state GROUP BY stable_cluster_id)
    SELECT cycle_number, customer_id, stable_cluster_id, label, CASE WHEN last_cycle = (SELECT max(cycle_number) FROM state) THEN 'current' ELSE 'retired' END AS status,
       last_value(CASE WHEN current_orders > 0 THEN cycle_number END IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY cycle_number
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INTEGER AS last_fitted_cycle FROM state JOIN ids USING (stable_cluster_id)""",
)
def assignment_metadata(spark, sf_dir):
    """Each assignment with the last cycle its customer bought in, and whether its id still stands, under its latest name."""
    rows = st.segments(spark, sf_dir)
    ids = rows.groupBy("stable_cluster_id").agg(F.max("cycle_number").alias("last_cycle"), F.max_by("segment_name", "cycle_number").alias("label"))
    latest = F.max("last_cycle").over(Window.partitionBy(F.lit(0)))  # one row per id
    known = ids.withColumn("status", F.when(F.col("last_cycle") == latest, "current").otherwise("retired"))
    fitted = behaviour.last_fitted_cycle(rows, F.col("current_orders") > 0)
    return fitted.join(known, "stable_cluster_id").select("cycle_number", "customer_id", "stable_cluster_id", "label", "status", "last_fitted_cycle")


# Cycles, segments, products, markets


@registered(
    "cycle_segments",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, segment_name, customers, revenue,
       (sum(customers) OVER (PARTITION BY cycle_number))::BIGINT AS cycle_customers
    FROM (SELECT cycle_number, segment_name, count(*) AS customers, round(sum(current_revenue), 2) AS revenue FROM state GROUP BY ALL) JOIN cal USING (cycle_number)""",
)
def cycle_segments(spark, sf_dir):
    """Periods with their segments and customers."""
    counted = st.segments(spark, sf_dir).groupBy("cycle_number", "segment_name").agg(
        F.count("*").alias("customers"), r(F.sum("current_revenue"), 2, "revenue")
    )
    whole = F.sum("customers").over(Window.partitionBy("cycle_number"))  # one row per cycle and segment
    return counted.withColumn("cycle_customers", whole).join(st.cycles(spark), "cycle_number").select(
        "cycle_number", day("period_start"), day("period_end"), "segment_name", "customers", "revenue", "cycle_customers"
    )


@registered(
    "latest_segments",
    sql.with_(sql.STATE)
    + """SELECT cycle_number, segment_name, count(*) AS customers, round(sum(current_revenue), 2) AS revenue, count(*) FILTER (risk_status IN ('At risk', 'Slipping')) AS at_risk
    FROM state WHERE cycle_number = (SELECT max(cycle_number) FROM state) GROUP BY ALL""",
)
def latest_segments(spark, sf_dir):
    """Segments of the last cycle that has customers."""
    rows = st.state(spark, sf_dir)
    last = rows.agg(F.max("cycle_number")).first()[0]
    return rows.where(F.col("cycle_number") == F.lit(last)).groupBy("cycle_number", "segment_name").agg(
        F.count("*").alias("customers"), r(F.sum("current_revenue"), 2, "revenue"),
        F.count_if(F.col("risk_status").isin(*summaries.AT_RISK)).alias("at_risk"),
    )


@registered(
    "centre_paths",
    sql.with_(sql.STATE)
    + """, m AS (SELECT cycle_number, stable_cluster_id, count(*) AS n, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM state GROUP BY ALL),
    grid AS (SELECT g::INTEGER AS cycle_number, stable_cluster_id FROM (SELECT DISTINCT stable_cluster_id FROM m), range(10) AS t(g))
    SELECT cycle_number, stable_cluster_id, coalesce(n, 0)::BIGINT AS customers, n IS NULL AS gap, round(r, 6) AS recency, round(f, 6) AS frequency, round(m, 6) AS monetary,
       round(r - lag(r) OVER w, 6) + 0.0 AS recency_change, round(f - lag(f) OVER w, 6) + 0.0 AS frequency_change, round(m - lag(m) OVER w, 6) + 0.0 AS monetary_change
    FROM grid LEFT JOIN m USING (cycle_number, stable_cluster_id) WINDOW w AS (PARTITION BY stable_cluster_id ORDER BY cycle_number)""",
)
def centre_paths(spark, sf_dir):
    """Each id on the whole grid of cycles, gaps left empty, with the change since the cycle before."""
    means = st.segments(spark, sf_dir).groupBy("cycle_number", "stable_cluster_id").agg(
        F.count("*").alias("n"), F.avg("recency").alias("r"), F.avg("frequency").alias("f"), F.avg("monetary").alias("m")
    )
    numbers = F.sequence(F.lit(0), F.lit(st.cycles(spark).agg(F.max("cycle_number")).first()[0]))
    grid = means.select("stable_cluster_id").distinct().select("stable_cluster_id", F.explode(numbers).alias("cycle_number"))
    path = Window.partitionBy("stable_cluster_id").orderBy("cycle_number")
    named = (("r", "recency"), ("f", "frequency"), ("m", "monetary"))
    return grid.join(means, ["cycle_number", "stable_cluster_id"], "left").select(
        "cycle_number", "stable_cluster_id", F.coalesce("n", F.lit(0)).alias("customers"), F.col("n").isNull().alias("gap"),
        *[r(c, 6, name) for c, name in named],
        *[r(F.col(c) - F.lag(c).over(path), 6, f"{name}_change") for c, name in named],
    )


@registered(
    "portfolio_by_segment",
    sql.with_(sql.STATE, sql.ROWS)
    + """SELECT segment_name, products, orders, quantity, revenue, round(revenue / sum(revenue) OVER (), 6) AS share FROM (
       SELECT segment_name, count(DISTINCT description) AS products, count(DISTINCT invoice_no) AS orders, round(sum(quantity), 4) AS quantity, round(sum(total_price), 2) AS revenue FROM labelled GROUP BY segment_name)""",
)
def portfolio_by_segment(spark, sf_dir):
    """Breadth and revenue of each segment's products, and its share of all revenue."""
    rows = summaries.labelled_rows(st.ledger(spark, sf_dir), st.cycles(spark), st.segments(spark, sf_dir))
    totals = rows.groupBy("segment_name").agg(*_breadth(), r(F.sum("quantity"), 4, "quantity"), r(F.sum("total_price"), 2, "revenue"))
    whole = F.sum("revenue").over(Window.partitionBy(F.lit(0)))  # one row per segment
    return totals.withColumn("share", r(F.try_divide(F.col("revenue"), whole), 6, "share"))


@registered(
    "products_by_cycle",
    sql.with_(sql.BASE)
    + """SELECT cycle_number, count(DISTINCT description) AS products, count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS customers, round(sum(quantity), 4) AS quantity,
       round(sum(total_price), 2) AS revenue FROM ledger JOIN cal ON invoice_date >= period_start AND invoice_date < period_end GROUP BY cycle_number""",
)
def products_by_cycle(spark, sf_dir):
    rows = in_periods(st.ledger(spark, sf_dir), st.cycles(spark))
    return rows.groupBy("cycle_number").agg(
        *_breadth(), F.count_distinct("customer_id").alias("customers"), r(F.sum("quantity"), 4, "quantity"), r(F.sum("total_price"), 2, "revenue")
    )


def _breadth() -> list[Column]:
    return [F.count_distinct("description").alias("products"), F.count_distinct("purchase_invoice_no").alias("orders")]


@registered(
    "market_quality",
    sql.with_(sql.STATE, sql.ASOF)
    + f"""SELECT cycle_number, {MARKET} AS market, count(*) AS customers, count(DISTINCT country) AS countries, round(avg(CASE WHEN cycle_number > 0 THEN top_membership END), 6) AS mean_membership,
       round(avg((risk_status IN ('At risk', 'Slipping'))::INTEGER), 6) AS at_risk_share, round(avg((segment_name = 'Champions')::INTEGER), 6) AS champions_share,
       round(avg((segment_name = 'Hibernating / Lost')::INTEGER), 6) AS lost_share FROM state JOIN home USING (cycle_number, customer_id) GROUP BY ALL""",
)
def market_quality(spark, sf_dir):
    """Certainty, risk and composition of each market's customers; the markets here are stated by the country's name."""
    rows = st.state(spark, sf_dir).join(st.asof(spark, sf_dir).select("cycle_number", "customer_id", "country"), ["cycle_number", "customer_id"])

    def share(condition: Column, name: str) -> Column:
        return r(F.avg(condition.cast("int")), 6, name)

    return rows.groupBy("cycle_number", F.when(F.col("country") < "I", "Early").otherwise("Late").alias("market")).agg(
        F.count("*").alias("customers"), F.count_distinct("country").alias("countries"),
        r(F.avg(F.when(F.col("cycle_number") > 0, F.col("top_membership"))), 6, "mean_membership"),
        share(F.col("risk_status").isin(*summaries.AT_RISK), "at_risk_share"),
        share(F.col("segment_name") == "Champions", "champions_share"),
        share(F.col("segment_name") == "Hibernating / Lost", "lost_share"),
    )


@registered(
    "schema_overview",
    sql.with_(sql.STATE, sql.ASOF)
    + """SELECT 'table' AS kind, 'ledger' AS name, count(*) AS rows FROM ledger UNION ALL SELECT 'table', 'panel', count(*) FROM panel UNION ALL SELECT 'table', 'state', count(*) FROM state
    UNION ALL SELECT 'table', 'country_asof', count(*) FROM home UNION ALL SELECT 'country', country, count(*) FROM home GROUP BY country""",
)
def schema_overview(spark, sf_dir):
    """Rows of the stored tables, and customer-cycles of each country to filter by."""
    asof = st.asof(spark, sf_dir)
    tables = {"ledger": st.ledger(spark, sf_dir), "panel": st.rfm(spark, sf_dir), "state": st.state(spark, sf_dir), "country_asof": asof}
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit("table").alias("kind"), F.lit(n).alias("name"), "rows") for n, t in tables.items()]
    countries = asof.groupBy("country").agg(F.count("*").alias("rows")).select(F.lit("country").alias("kind"), F.col("country").alias("name"), "rows")
    return reduce(DataFrame.unionByName, [*counts, countries])


# Audits


@registered(
    "reversal_reconciliation",
    sql.with_(sql.RAW, sql.REVERSED)
    + """SELECT year(invoice_date)::INTEGER AS year, count(*) FILTER (quantity < 0 AND consumed < -quantity) AS unmatched_rows,
       round(coalesce(sum(-quantity - consumed) FILTER (quantity < 0), 0), 4) AS unmatched_units, round(coalesce(sum((-quantity - consumed) * unit_price) FILTER (quantity < 0), 0), 2) AS unmatched_value,
       round(coalesce(sum(quantity * unit_price) FILTER (quantity > 0), 0), 2) AS gross_sales, round(sum(CASE WHEN quantity > 0 THEN quantity ELSE -consumed END * unit_price), 2) AS net_sales FROM c GROUP BY ALL""",
)
def reversal_reconciliation(spark, sf_dir):
    """Returns per year that meet no earlier purchase, and sales before and after matched returns."""
    back, left = F.col("quantity") < 0, -F.col("quantity") - F.col("consumed")
    net = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(-F.col("consumed"))

    def total(value: Column, digits: int, name: str) -> Column:
        return r(F.coalesce(F.sum(value), F.lit(0.0)), digits, name)

    return st.reversed_rows(spark, sf_dir).groupBy(F.year("invoice_date").alias("year")).agg(
        F.count_if(back & (left > 0)).alias("unmatched_rows"),
        total(F.when(back, left), 4, "unmatched_units"),
        total(F.when(back, left * F.col("unit_price")), 2, "unmatched_value"),
        total(F.when(~back, F.col("quantity") * F.col("unit_price")), 2, "gross_sales"),
        total(net * F.col("unit_price"), 2, "net_sales"),
    )


@registered(
    "run_invariants",
    sql.with_(sql.STATE)
    + """, sizes AS (SELECT cycle_number, count(*) AS n FROM state GROUP BY ALL)
    SELECT 'recency differs from the last purchase' AS rule, (SELECT count(*) FROM state JOIN cal USING (cycle_number) WHERE date_diff('day', latest_purchase::DATE, period_end::DATE) <> recency) AS violations
    UNION ALL SELECT 'last purchase before the first', (SELECT count(*) FROM state WHERE latest_purchase < first_purchase)
    UNION ALL SELECT 'memberships of another number', (SELECT count(*) FROM state WHERE u0 IS NULL OR u1 IS NULL OR u2 IS NULL OR u3 IS NULL)
    UNION ALL SELECT 'membership outside 0 to 1', (SELECT count(*) FROM state WHERE least(u0, u1, u2, u3) < 0 OR greatest(u0, u1, u2, u3) > 1 + 1e-12)
    UNION ALL SELECT 'assigned below the highest membership', (SELECT count(*) FROM state WHERE list_extract([u0, u1, u2, u3], idx + 1) < greatest(u0, u1, u2, u3))
    UNION ALL SELECT 'cycle without customers', (SELECT count(*) FROM cal WHERE cycle_number NOT IN (SELECT cycle_number FROM sizes))
    UNION ALL SELECT 'fewer customers than the cycle before', (SELECT count(*) FROM sizes a JOIN sizes b ON b.cycle_number = a.cycle_number - 1 WHERE a.n < b.n)
    UNION ALL SELECT 'centre without mass', (SELECT count(*) FROM (SELECT 1 FROM state, range(4) AS t(k) GROUP BY cycle_number, k HAVING sum(list_extract([u0, u1, u2, u3], k + 1)) <= 1e-8))
    UNION ALL SELECT 'several ids for one centre', (SELECT count(*) FROM (SELECT 1 FROM state GROUP BY cycle_number, idx HAVING count(DISTINCT stable_cluster_id) > 1))
    UNION ALL SELECT 'several centres for one id', (SELECT count(*) FROM (SELECT 1 FROM state GROUP BY cycle_number, stable_cluster_id HAVING count(DISTINCT idx) > 1))""",
)
def run_invariants(spark, sf_dir):
    return quality.run_invariants(st.segments(spark, sf_dir), st.cycles(spark), len(st.CENTRES))


@registered(
    "report_reconciliation",
    sql.with_(sql.STATE, sql.ASOF, sql.ROWS)
    + f""", people AS (SELECT cycle_number, count(*)::DOUBLE AS n, count(DISTINCT customer_id)::DOUBLE AS d FROM state GROUP BY ALL),
    money AS (SELECT cycle_number, round(sum(total_price), 2) AS v FROM ledger JOIN cal ON invoice_date >= period_start AND invoice_date < period_end GROUP BY ALL),
    checks AS (
    SELECT cycle_number, 'registry winners' AS item, sum(w)::DOUBLE AS reported, any_value(n) AS expected FROM (SELECT cycle_number, idx, count(*) AS w FROM assigned GROUP BY ALL) JOIN people USING (cycle_number) GROUP BY cycle_number
    UNION ALL SELECT cycle_number, 'market and behaviour classes', count(*)::DOUBLE, any_value(people.n) FROM state JOIN home USING (cycle_number, customer_id) JOIN people USING (cycle_number) GROUP BY cycle_number
    UNION ALL SELECT cycle_number, 'unique customer rows', d, n FROM people
    UNION ALL SELECT cycle_number, 'segment revenue', round(sum(current_revenue), 2), any_value(v) FROM state JOIN money USING (cycle_number) GROUP BY cycle_number
    UNION ALL SELECT cycle_number, 'product revenue', round(sum(total_price), 2), any_value(v) FROM labelled JOIN money USING (cycle_number) GROUP BY cycle_number)
    SELECT *, abs(reported - expected) < 0.01 AS agrees FROM checks""",
)
def report_reconciliation(spark, sf_dir):
    """Totals of each report against the table it must add up to, per cycle."""
    rows, ledger, cycles = st.segments(spark, sf_dir), st.ledger(spark, sf_dir), st.cycles(spark)
    asof = st.asof(spark, sf_dir)
    grouped = asof.select("cycle_number", "country").distinct().withColumn("market", F.when(F.col("country") < "I", "Early").otherwise("Late"))
    products = summaries.product_summary(summaries.labelled_rows(ledger, cycles, rows))
    segments = summaries.segment_summary(summaries.customer_summary(st.state(spark, sf_dir)))

    def value(table: DataFrame, total: Column, digits: int = 2) -> DataFrame:
        return table.groupBy("cycle_number").agg(r(total, digits, "value"))

    people, money = value(rows, F.count("*")), value(in_periods(ledger, cycles), F.sum("total_price"))
    checks = {
        "registry winners": (value(registry.registry(rows, st.fitted(spark)), F.sum("winners")), people),
        "market and behaviour classes": (value(markets.cross_classes(st.state(spark, sf_dir), asof, grouped).where("market is not null"), F.count("*")), people),
        "unique customer rows": (value(rows, F.count_distinct("customer_id")), people),
        "segment revenue": (value(segments, F.sum("revenue")), money),
        "product revenue": (value(products, F.sum("revenue")), money),
    }
    sides = [
        side.select("cycle_number", F.lit(name).alias("item"), *[(F.col("value") if i == j else F.lit(None).cast("double")).alias(c) for j, c in enumerate(("reported", "expected"))])
        for name, pair in checks.items()
        for i, side in enumerate(pair)
    ]
    met = reduce(DataFrame.unionByName, sides).groupBy("cycle_number", "item").agg(F.max("reported").alias("reported"), F.max("expected").alias("expected"))
    return met.withColumn("agrees", F.abs(F.col("reported") - F.col("expected")) < 0.01)


@registered("explained_variance")
def explained_variance(spark, sf_dir):
    """Each component's share of the baseline's variance, by its fit and by the variance of its projected rows."""
    rows = st.rfm(spark, sf_dir).where("cycle_number = 0")
    scaled = features.fit_min_max(rows).apply(rows)
    columns = [f"scaled_{c}" for c in snapshot.FEATURES]
    fit = features.fit_pca(scaled, tuple(columns))
    whole = sum((F.var_samp(c) for c in columns[1:]), F.var_samp(columns[0]))
    shares = [
        F.struct(F.lit(i + 1).alias("component"), F.lit(round(float(e), 6)).alias("explained"), r(F.try_divide(F.var_samp(f"pc{i + 1}"), whole), 6, "projected"))
        for i, e in enumerate(fit.explained)
    ]
    return fit.apply(scaled).agg(F.array(*shares).alias("s")).select(F.explode("s").alias("s")).select("s.*")


# The fitted run: random starts and iterations, so rows only


@registered("fitted_registry")
def fitted_registry(spark, sf_dir):
    """Every fitted centre with its membership mass and winners, beside its cycle's quality."""
    run = st.fitted_run(spark, sf_dir)
    measures = run["quality"].select("cycle_number", "k", "source", r("objective", 6), r("xie_beni", 6), "iterations")
    centres = run["centres"].select("cycle_number", "cluster_index", "stable_cluster_id", "segment_name")
    return registry.registry(run["assignments"], centres).join(measures, "cycle_number").select(
        "cycle_number", "cluster_index", "stable_cluster_id", "segment_name", r("membership_mass"), "winners", "soft_only",
        "k", "source", "objective", "xie_beni", "iterations",
    )


@registered("fitted_lineage")
def fitted_lineage(spark, sf_dir):
    return st.fitted_run(spark, sf_dir)["lineage"]


@registered("fitted_candidates")
def fitted_candidates(spark, sf_dir):
    return st.fitted_run(spark, sf_dir)["candidates"]


@registered("fit_audit")
def fit_audit(spark, sf_dir):
    """Rules of the fitted run with their violations; memberships are computed again from the stored centres."""
    run = st.fitted_run(spark, sf_dir)
    return quality.fit_violations(run["assignments"], run["centres"], run["lineage"], run["candidates"])


@registered("centre_replay")
def centre_replay(spark, sf_dir):
    """Every candidate of every cycle fitted again from its stored start and masses."""
    run = st.fitted_run(spark, sf_dir)
    return replay.candidates_again(run["assignments"], run["centres"], run["candidates"])


@registered("identity_replay")
def identity_replay(spark, sf_dir):
    """Overlaps, link costs, ids and events of every cycle computed again."""
    run = st.fitted_run(spark, sf_dir)
    return replay.identities_again(run["assignments"], run["centres"], run["lineage"], run["overlaps"])


@registered("fit_replay")
def fit_replay(spark, sf_dir):
    """Memberships, objective, Xie-Beni index and condition counts of every fitted cycle computed again (V5)."""
    run = st.fitted_run(spark, sf_dir)
    return replay.cycles_again(run["assignments"], run["centres"], run["quality"])


# The order of the source

INSIDE = "invoice_date >= TIMESTAMP '1995-01-01' AND invoice_date < TIMESTAMP '1996-01-01'"


@registered(
    "duplicate_examples",
    sql.with_(sql.ARRIVED)
    + f""", same AS (
        SELECT *, row_number() OVER w AS occurrence, min(arrival) OVER w AS first_row FROM raw WHERE {INSIDE}
        WINDOW w AS (PARTITION BY invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country ORDER BY arrival))
    SELECT arrival, first_row, occurrence, invoice_no, stock_code, quantity, unit_price, customer_id::BIGINT AS customer_id,
           strftime(invoice_date, '%Y-%m-%d') AS invoice_date
    FROM same WHERE occurrence > 1 ORDER BY arrival LIMIT 20""",
)
def duplicate_examples(spark, sf_dir):
    """The first twenty repeats of whole rows in the period, each with the row that it repeats."""
    found = cleaning.duplicate_examples(st.arrived_ledger(spark, sf_dir).where(INSIDE), "arrival", limit=20)
    return found.select(
        "arrival", "first_row", "occurrence", "invoice_no", "stock_code", "quantity", "unit_price", F.col("customer_id").cast("long").alias("customer_id"), day("invoice_date")
    )


@registered(
    "out_of_order_rows",
    sql.with_(sql.ARRIVED)
    + """SELECT count(*) AS rows, (count(*) FILTER (invoice_date < before))::BIGINT AS out_of_order_rows
    FROM (SELECT invoice_date, lag(invoice_date) OVER (ORDER BY arrival) AS before FROM raw)""",
)
def out_of_order_rows(spark, sf_dir):
    """Rows of the source that are earlier than the row before them."""
    rows = st.arrived_ledger(spark, sf_dir)
    return cleaning.out_of_order_rows(rows, "arrival").crossJoin(F.broadcast(rows.agg(F.count("*").alias("rows"))))  # one row each


@registered(
    "first_and_last_invoices",
    sql.with_(sql.ARRIVED)
    + f""", once AS (
        SELECT min(arrival) AS arrival, invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country FROM raw
        WHERE customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0 AND invoice_no NOT LIKE 'C%' AND {INSIDE} GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date, arrival) AS up,
                      row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date DESC, arrival DESC) AS down FROM once)
    SELECT customer_id::BIGINT AS customer_id, max(invoice_no) FILTER (up = 1) AS first_invoice, max(invoice_no) FILTER (down = 1) AS last_invoice,
           (max(arrival) FILTER (up = 1))::BIGINT AS first_row, (max(arrival) FILTER (down = 1))::BIGINT AS last_row, count(*) AS rows
    FROM placed GROUP BY customer_id""",
)
def first_and_last_invoices(spark, sf_dir):
    """Each customer's first and last sale in the stable order of date and source."""
    sales = cleaning.clean(st.arrived_ledger(spark, sf_dir), st.CONFIG.baseline_start, st.CONFIG.end, arrival="arrival")
    return cleaning.first_and_last(sales, "arrival")


# Quality

_APART = "sqrt(pow(a.log_r - b.log_r, 2) + pow(a.log_f - b.log_f, 2) + pow(a.log_m - b.log_m, 2))"


@registered(
    "cohort_silhouettes",
    sql.with_(sql.STATE)
    + f""", c AS (SELECT cycle_number, customer_id, idx, log_r, log_f, log_m, top_membership, unnest(list_filter(['All customers', CASE WHEN current_orders > 0 THEN 'Purchased this month' END,
        CASE WHEN recency <= 90 THEN 'Purchased within 90 days' END, CASE WHEN recency > 90 THEN 'No purchase for over 90 days' END], lambda x: x IS NOT NULL)) AS cohort FROM state),
    away AS (SELECT a.cycle_number, a.cohort, a.customer_id, a.idx, b.idx AS k, count(*) AS n, sum({_APART}) AS s
             FROM c a JOIN c b ON a.cycle_number = b.cycle_number AND a.cohort = b.cohort GROUP BY ALL),
    ab AS (SELECT cycle_number, cohort, customer_id, any_value(idx) AS idx, max(CASE WHEN k = idx THEN n END) AS n, max(CASE WHEN k = idx AND n > 1 THEN s / (n - 1) END) AS i, min(CASE WHEN k <> idx THEN s / n END) AS o
           FROM away GROUP BY cycle_number, cohort, customer_id),
    sil AS (SELECT cycle_number, cohort, avg(CASE WHEN o IS NULL THEN NULL WHEN n = 1 THEN 0 ELSE coalesce((o - i) / nullif(greatest(o, i), 0), 0) END) AS v FROM ab GROUP BY ALL)
    SELECT cycle_number, cohort, count(*) AS customers, count(DISTINCT idx) AS occupied, round(avg(top_membership), 6) AS mean_membership, round(any_value(v), 5) AS mean_silhouette
    FROM c JOIN sil USING (cycle_number, cohort) GROUP BY cycle_number, cohort""",
)
def cohort_silhouettes(spark, sf_dir):
    """Size, occupied labels, membership and Euclidean silhouette of every overlapping cohort of a cycle."""
    bought = F.when(F.col("current_orders") > 0, 1).otherwise(0).alias("current_orders")
    found = validity.cohort_silhouettes(st.kinds(spark, sf_dir, "recency", bought), ["cycle_number"], weight="n")
    return found.select("cycle_number", "cohort", "customers", "occupied", r("mean_membership", 6), r("mean_silhouette", 5))


@registered(
    "separation_by_cycle",
    sql.with_(sql.ASSIGNED)
    + """, g AS (SELECT cycle_number, idx, count(*) AS n, avg(log_r) AS a, avg(log_f) AS b, avg(log_m) AS c FROM assigned GROUP BY ALL),
    d AS (SELECT s.cycle_number, s.idx, avg(sqrt(pow(log_r - a, 2) + pow(log_f - b, 2) + pow(log_m - c, 2))) AS s, sum(pow(log_r - a, 2) + pow(log_f - b, 2) + pow(log_m - c, 2)) AS w
          FROM assigned s JOIN g USING (cycle_number, idx) GROUP BY ALL),
    m AS (SELECT cycle_number, avg(log_r) AS a, avg(log_f) AS b, avg(log_m) AS c, count(*) AS n FROM assigned GROUP BY ALL),
    t AS (SELECT cycle_number, count(*) AS k, sum(w) AS w, sum(g.n * (pow(g.a - m.a, 2) + pow(g.b - m.b, 2) + pow(g.c - m.c, 2))) AS between_, any_value(m.n) AS n
          FROM g JOIN d USING (cycle_number, idx) JOIN m USING (cycle_number) GROUP BY cycle_number),
    r AS (SELECT x.cycle_number, x.idx, max((p.s + q.s) / sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2))) AS worst
          FROM g x JOIN g y ON x.cycle_number = y.cycle_number AND x.idx <> y.idx JOIN d p ON p.cycle_number = x.cycle_number AND p.idx = x.idx
               JOIN d q ON q.cycle_number = y.cycle_number AND q.idx = y.idx GROUP BY ALL)
    SELECT cycle_number, n AS customers, k::INTEGER AS k, round(avg(worst), 5) AS davies_bouldin, round((any_value(between_) / (k - 1)) / (any_value(w) / (n - k)), 4) AS calinski_harabasz
    FROM t JOIN r USING (cycle_number) GROUP BY cycle_number, n, k""",
)
def separation_by_cycle(spark, sf_dir):
    """Davies-Bouldin and Calinski-Harabasz indices of every cycle."""
    found = validity.scores_by_key(st.segments(spark, sf_dir), "cycle_number")
    return found.select("cycle_number", F.col("n").alias("customers"), "k", r("davies_bouldin", 5), r("calinski_harabasz", 4))


# Choice of K; random starts, so rows only


@registered("baseline_k_table")
def baseline_k_table(spark, sf_dir):
    """Inertia, silhouette, bend and sizes of every K tried on the baseline's customers."""
    return st.fitted_run(spark, sf_dir)["k_table"]


@registered("country_k_table")
def country_k_table(spark, sf_dir):
    """The same for the baseline's countries (C4, Q20)."""
    found = st.country_features(spark, sf_dir)
    return spark.createDataFrame([tuple(row.values()) for row in markets.fit_groups(found)[2]], sweep.K_TABLE)


@registered("random_fuzzy_fits")
def random_fuzzy_fits(spark, sf_dir):
    """Plain fuzzy c-means of every cycle's last customers from ten random memberships."""
    rows = st.segments(spark, sf_dir).where(f"cycle_number = {st.CONFIG.cycles - 1}").select("customer_id", "point")
    fits = sweep.fit_random(rows, len(st.IDS), list(range(10)))
    told = [(f.source, float(f.objective), float(f.xie_beni), f.iterations, f.converged) for f in fits]
    return spark.createDataFrame(told, "source string, objective double, xie_beni double, iterations int, converged boolean")


# Repeats and the registry


_WITH_COPIES = (
    sql.ASSIGNED.replace("SELECT DISTINCT * FROM raw", "SELECT *, count(*) AS copies FROM raw GROUP BY ALL", 1)
    .replace("quantity * unit_price AS total_price", "quantity * unit_price AS total_price, copies", 1)
    .replace("/ 3 AS monetary,", "/ 3 AS monetary, coalesce(sum((copies - 1) * total_price) FILTER (invoice_date >= window_start), 0) / 3 AS added,", 1)
)


@registered(
    "duplicate_assignments",
    sql.with_(_WITH_COPIES)
    + f""", b AS (SELECT cycle_number, log_r, log_f, monetary, idx, monetary + added AS monetary_with FROM assigned),
    m AS (SELECT *, ln(1 + monetary_with) AS lw FROM b),
    w AS (SELECT *, {", ".join(f"pow(log_r - ({c[0]} + cycle_number * {st.DRIFT}), 2) + pow(log_f - {c[1]}, 2) + pow(lw - {c[2]}, 2) AS w{k}" for k, c in enumerate(st.CENTRES))} FROM m)
    SELECT cycle_number, count(*) AS customers, count(*) FILTER (monetary_with > monetary) AS customers_with_repeats,
           count(*) FILTER ({sql.index_of("w0 w1 w2 w3")} <> idx) AS changed_assignments, round(sum(monetary_with - monetary), 2) AS monetary_change FROM w GROUP BY cycle_number""",
)
def duplicate_assignments(spark, sf_dir):
    """Customers whose cluster would change if exact repeats were kept, under the same centres (V8)."""
    both = quality.duplicate_assignments(
        st.raw_ledger(spark, sf_dir), st.rfm(spark, sf_dir), st.cycles(spark), st.centres_at(F.col("cycle_number")), st.CONFIG.baseline_start, st.CONFIG.end
    )
    return both.groupBy("cycle_number").agg(
        F.count("*").alias("customers"), F.count_if(F.col("monetary_with") > F.col("monetary")).alias("customers_with_repeats"),
        F.count_if(F.col("cluster_without") != F.col("cluster_with")).alias("changed_assignments"), r(F.sum(F.col("monetary_with") - F.col("monetary")), 2, "monetary_change"),
    )


@registered("registry_audit")
def registry_audit(spark, sf_dir):
    """The fitted run's registry and its digests against assignments, lineage and panel."""
    run = st.fitted_run(spark, sf_dir)
    return registry.registry_violations(run["registry"], run["assignments"], run["lineage"], st.rfm(spark, sf_dir))


@registered(
    "identity_links",
    sql.with_(sql.ASSIGNED)
    + """, long AS (SELECT cycle_number, k::INTEGER AS k, CASE k WHEN 0 THEN u0 WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END AS u, recency, frequency, monetary FROM assigned, range(4) AS t(k)),
    m AS (SELECT cycle_number, k, sum(u * u * recency) / nullif(sum(u * u), 0) AS r, sum(u * u * frequency) / nullif(sum(u * u), 0) AS f, sum(u * u * monetary) / nullif(sum(u * u), 0) AS m
          FROM long GROUP BY ALL),
    n AS (SELECT *, """
    + f"{sql.pick(st.IDS, 'k')} AS id, {sql.pick(st.NAMES, 'k')} AS name"
    + """ FROM m)
    SELECT a.cycle_number, a.id AS stable_cluster_id, b.name AS old_name, a.name AS new_name, a.name = b.name AS kept_name, round(a.r - b.r, 4) + 0.0 AS recency_change,
           round(a.f - b.f, 4) + 0.0 AS frequency_change, round(a.m - b.m, 3) + 0.0 AS monetary_change
    FROM n a JOIN n b ON a.id = b.id AND a.cycle_number = b.cycle_number + 1""",
)
def identity_links(spark, sf_dir):
    """Names and weighted measures of every id that goes on."""
    found = registry.identity_links(st.segments(spark, sf_dir), st.fitted(spark))
    return found.select(
        "cycle_number", "stable_cluster_id", "old_name", "new_name", "kept_name", r("recency_change", 4), r("frequency_change", 4), r("monetary_change", 3)
    )
