"""Operators of the retail jobs against direct computations."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.functions import membership, profiles
from segmentflow.operators import behaviour, calendar, cleaning, clustering, features, lineage, naming, order_stats, quality, reversals, snapshot, sweep, validity
from segmentflow.plans import details, reports
from segmentflow.sources import sinks
from segmentflow.sources.ledger import LEDGER_SCHEMA, read_ledger


def numpy_memberships(x, c):
    d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    u = 1 / np.maximum(d2, 1e-300)
    u /= u.sum(axis=1, keepdims=True)
    for i in np.flatnonzero((d2 <= 1e-24).any(axis=1)):
        u[i] = (d2[i] <= 1e-24) / (d2[i] <= 1e-24).sum()
    return u, d2


def points_df(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "customer_id long, point array<double>")


CENTRES = np.array([[1, 1, 0], [1, -1, 0], [-1, 1, 0], [-1, -1, 0]], dtype=float)


def four_groups(extra=()):
    rng = np.random.default_rng(20261025)
    x = np.vstack([c + rng.normal(0, 0.035, (35, 3)) for c in CENTRES])
    return np.vstack([x, np.array(extra, dtype=float).reshape(-1, 3)])


def test_memberships_and_exact_hits(spark):
    x = np.vstack([four_groups(), CENTRES[:1]])
    u, d2 = numpy_memberships(x, CENTRES)
    d = membership.squared_distances(F.col("point"), membership.centre_array(CENTRES))
    rows = points_df(spark, x).select("customer_id", membership.memberships(d).alias("u"), membership.first_min(d).alias("k")).orderBy("customer_id").collect()
    assert np.allclose([r.u for r in rows], u, atol=1e-12) and list(rows[-1].u) == [1.0, 0.0, 0.0, 0.0]
    assert [r.k for r in rows] == d2.argmin(axis=1).tolist()
    with pytest.raises(ValueError):
        membership.memberships(d, 1.0)


@pytest.mark.parametrize("extra, sizes", [((), [4]), (((0, 0, 0),), [3, 5]), (((3, 0, 0),), [4, 5]), (((0, 0, 3),), [3, 4, 5])])
def test_four_branches_of_the_cycle_update(spark, extra, sizes):
    x = four_groups(extra)
    df = points_df(spark, x)
    met = clustering.conditions(df, CENTRES)
    assert clustering.candidate_sizes(4, *met, len(x)) == sizes
    masses = np.full(4, 35.0)
    tried = clustering.starts(df, CENTRES, sizes, masses)
    assert sorted({len(s.centres) for s in tried}) == sizes and all((s.carried is not None) == (s.source == "keep") for s in tried)
    fit, fits, met_rows = clustering.update(df, CENTRES, masses)
    assert tuple(n > 0 for n in met_rows[:2]) == met
    u, d2 = numpy_memberships(x, fit.centres)
    assert fit.objective == pytest.approx(float((u**2 * d2).sum()), abs=1e-9)
    assert fit.xie_beni == pytest.approx(clustering.xie_beni(fit.objective, len(x), fit.centres))
    assert fit.xie_beni == min(f.xie_beni for f in fits if f.converged)


def test_a_centre_without_new_mass_stays(spark):
    x = four_groups()[:70]
    fits = clustering.fit_starts(points_df(spark, x), [clustering.Start("keep", CENTRES, np.full(4, 10.0))])
    assert np.allclose(fits[0].centres[2:], CENTRES[2:])


def test_plain_fuzzy_objective_falls(spark):
    df = points_df(spark, four_groups())
    start = CENTRES + 0.3
    first = clustering.fuzzy_sums(df, [start], 2.0)[0]["objective"]
    fit = clustering.fit_fuzzy(df, start)
    assert fit.converged and fit.objective < first and np.allclose(np.sort(fit.centres, axis=0), np.sort(CENTRES, axis=0), atol=0.05)


def test_elbow_and_kmeans(spark):
    found = sweep.kmeans(points_df(spark, four_groups()), list(range(2, 7)), starts=3)
    costs = {k: p.cost for k, p in found.items()}
    assert clustering.elbow(costs) == clustering.elbow(costs, True) == 4 and costs[4] < costs[2]


def test_kmeans_of_many_starts_reaches_the_optimum_of_a_line(spark, monkeypatch):
    """On a line the best partition is known: cuts of the sorted values, by dynamic programming."""
    rng = np.random.default_rng(8)
    x = np.sort(np.concatenate([rng.normal(m, s, n) for m, s, n in ((0, 1, 40), (6, 0.5, 25), (9, 1, 30), (20, 3, 25))]))
    first, second = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
    cost = lambda a, b: second[b] - second[a] - (first[b] - first[a]) ** 2 / (b - a)
    best = {1: [cost(0, b) if b else 0.0 for b in range(len(x) + 1)]}
    for k in range(2, 7):
        best[k] = [min((best[k - 1][a] + cost(a, b) for a in range(k - 1, b)), default=math.inf) for b in range(len(x) + 1)]
    df = points_df(spark, x[:, None])
    found = sweep.kmeans(df, list(range(2, 7)), starts=30)
    assert all(found[k].cost == pytest.approx(best[k][-1], rel=1e-9) and sum(found[k].sizes) == len(x) for k in found) and sorted(found) == list(range(2, 7))
    table = sweep.k_table(df, found, "customer_id")
    for row in table:
        label = ((x[:, None] - found[row["k"]].centres.ravel()[None]) ** 2).argmin(axis=1)
        d = np.abs(x[:, None] - x[None])
        inside = [d[i, label == label[i]].sum() / max((label == label[i]).sum() - 1, 1) for i in range(len(x))]
        outside = [min(d[i, label == k].mean() for k in set(label) if k != label[i]) for i in range(len(x))]
        value = np.mean([0 if (label == label[i]).sum() == 1 else (o - a) / max(o, a) for i, (a, o) in enumerate(zip(inside, outside))])
        assert row["silhouette"] == pytest.approx(value, abs=1e-9)
        assert row["sizes"] == sorted(np.bincount(label).tolist(), reverse=True) and row["singletons"] == (np.bincount(label) == 1).sum()
    assert sum(r["selected"] for r in table) == sum(r["best_silhouette"] for r in table) == 1
    same = points_df(spark, np.ones((5, 2)))
    assert sweep.kmeans(same, [2, 3]) == {}  # one distinct point has no two clusters


def test_fuzzy_fits_from_random_memberships_equal_numpy(spark):
    x = four_groups()
    df = points_df(spark, x)
    drawn = df.select("customer_id", *[sweep.random_memberships(F.col("customer_id"), 4, F.lit(s)).alias(f"u{s}") for s in (3, 9)]).orderBy("customer_id").collect()
    fits = sweep.fit_random(df, 4, [3, 9])
    for fit, seed in zip(fits, (3, 9)):
        u = np.array([r[f"u{seed}"] for r in drawn])
        assert np.allclose(u.sum(axis=1), 1) and u.std() > 0.05
        last = None
        for updates in range(1, 301):
            centres = (u**2).T @ x / (u**2).sum(axis=0)[:, None]
            u, d2 = numpy_memberships(x, centres)
            objective = (u**2 * d2).sum()
            if last is not None and abs(last - objective) <= 0.01:
                break
            last = objective
        assert fit.iterations == updates and np.allclose(fit.centres, centres, atol=1e-8) and fit.objective == pytest.approx(objective)
    assert [f.objective for f in sweep.fit_random(df.repartition(7), 4, [3, 9])] == pytest.approx([f.objective for f in fits])
    with pytest.raises(ValueError):
        sweep.random_starts(df, 1, [1])


def test_silhouettes_and_scores(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(m, 0.6, (20, 3)) for m in (0, 2, 5)])
    label = np.repeat([0, 1, 2], 20)
    df = points_df(spark, x).withColumn("cluster_index", (F.col("customer_id") / 20).cast("int")).withColumn("g", F.lit(1))

    def silhouette(power):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** power
        out = []
        for i in range(len(x)):
            a = d[i][label == label[i]].sum() / 19
            b = min(d[i][label == k].mean() for k in range(3) if k != label[i])
            out.append((b - a) / max(a, b))
        return np.array(out)

    got = validity.squared_silhouette(df, ["g"]).orderBy("customer_id").collect()
    assert np.allclose([r.silhouette for r in got], silhouette(2), atol=1e-9)
    exact = validity.exact_silhouette(df).orderBy("customer_id").collect()
    assert np.allclose([r.silhouette for r in exact], silhouette(1), atol=1e-9)
    blocks = validity.exact_silhouette(df, ["g"], block_rows=7).orderBy("customer_id").collect()
    assert np.allclose([r.silhouette for r in blocks], silhouette(1), atol=1e-9)
    assert validity.exact_silhouette(df.limit(0)).count() == 0
    means = np.array([x[label == k].mean(axis=0) for k in range(3)])
    s = np.array([np.sqrt(((x[label == k] - means[k]) ** 2).sum(axis=1)).mean() for k in range(3)])
    gap = np.sqrt(((means[:, None] - means[None]) ** 2).sum(axis=2))
    db = np.mean([max((s[i] + s[j]) / gap[i, j] for j in range(3) if j != i) for i in range(3)])
    within = sum(((x[label == k] - means[k]) ** 2).sum() for k in range(3))
    ch = (20 * ((means - x.mean(axis=0)) ** 2).sum() / 2) / (within / 57)
    scores = validity.scores(df)
    assert scores["davies_bouldin"] == pytest.approx(db) and scores["calinski_harabasz"] == pytest.approx(ch)
    assert validity.scores(df.where("cluster_index = 0"))["davies_bouldin"] is None


def test_assignment_is_optimal():
    rng = np.random.default_rng(7)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)]:
        cost = rng.random((n, m))
        pairs = lineage.assign_least_cost(cost)
        small, big = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(pairs) == small and sum(cost[a, b] for a, b in pairs) == pytest.approx(best)


def test_identities_survive_relabelling_and_splits():
    overlap = np.eye(4)[:, [2, 0, 3, 1]]
    ids, rows, number = lineage.match_identities(CENTRES, CENTRES[[2, 0, 3, 1]], overlap, ["CL-001", "CL-002", "CL-003", "CL-004"], 5)
    assert ids == ["CL-003", "CL-001", "CL-004", "CL-002"] and number == 5 and {r["event"] for r in rows} == {"continued"}
    far = np.vstack([CENTRES[:3], [[9, 9, 9]]])
    ids, rows, number = lineage.match_identities(CENTRES, far, np.diag([1.0, 1.0, 1.0, 0.0]), ["a", "b", "c", "d"], 5)
    assert ids[3] == "CL-005" and number == 6 and {"retired", "created"} <= {r["event"] for r in rows}
    split = np.vstack([CENTRES[:1] + 0.1, CENTRES[:1] - 0.1, CENTRES[1:]])
    shared = np.vstack([[0.6, 0.3, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 0.9, 0.2], [0, 0, 0, 0.1, 0.9]])
    ids, rows, number = lineage.match_identities(CENTRES, split, shared, ["a", "b", "c", "d"], 5)
    events = {(r["previous_id"], r["current_id"]): r["event"] for r in rows}
    assert ids == ["a", "CL-005", "b", "c", "d"] and events["a", "CL-005"] == "split contribution"
    assert events["c", "d"] == events["d", "c"] == "split/merge contribution"
    merged = lineage.match_identities(CENTRES[:2], CENTRES[:1], np.array([[0.9], [0.2]]), ["a", "b"], 3)[1]
    assert ("b", "a", "merge contribution") in {(r["previous_id"], r["current_id"], r["event"]) for r in merged}


def test_tiny_centres_split_along_the_first_axis(spark):
    rows = points_df(spark, CENTRES[:3].astype(float))
    found = clustering.starts(rows, CENTRES.astype(float), [5], np.ones(4))
    assert len(found) == 4 and all(len(s.centres) == 5 for s in found)
    assert np.allclose(found[3].centres[[4, 3]], CENTRES[3] + np.array([[1e-3, 0, 0], [-1e-3, 0, 0]]))


def test_rank_shares_of_many_ties_in_few_ranges(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 3000) / 4
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {(r.g, r.v): r.rank_share for r in snapshot.rank_share(df, "v", "g").collect()}
    for g in (0, 1):
        own = values[g::2]
        for v in np.unique(own):
            assert got[g, v] == pytest.approx(((own < v).sum() + ((own == v).sum() + 1) / 2) / len(own))


def test_names_are_unique_and_follow_profiles():
    profile = naming.CentreProfile
    many = [profile(5, 9, 900, 1.0, 1.0), profile(8, 8, 800, 0.8, 0.8), profile(50, 2, 100, 0.2, 0.2), profile(200, 0, 0)]
    names = naming.names_of(many)
    assert names[0] == "Champions" and names[3] == "Hibernating / Lost" and len(set(names)) == 4
    assert naming.names_of(many[::-1]) == names[::-1]
    twins = naming.names_of([profile(200, 0, 0), profile(300, 0, 0)])
    assert len(set(twins)) == 2 and all(t.startswith("Hibernating / Lost") for t in twins)
    assert naming.rank_sum_names(many)[0] == "Champions"


def test_reversals_equal_the_sequential_loop(spark):
    rng = random.Random(3)
    rows = [(n, float(rng.randint(1, 6)), str(rng.randint(1, 2)), float(rng.choice([1.5, 2.0])), float(rng.choice([-3, -2, -1, 1, 2, 4]))) for n in range(600)]
    got = {r.n: r.consumed for r in reversals.match_reversals(spark.createDataFrame(rows, "n long, customer_id double, stock_code string, unit_price double, quantity double"), "n").collect()}
    stock = {}
    for n, c, s, p, q in rows:
        have = stock.get((c, s, p), 0.0)
        used = min(have, -q) if q < 0 else 0.0
        stock[c, s, p] = have + q if q > 0 else have - used
        assert got[n] == pytest.approx(used)


def test_cleaning_edges(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(1995, 5, 1)
    row = ("1", "A", "thing", 1.0, day, 2.0, 7.0, "X")
    rows = [row, row, ("C2", *row[1:]), ("", *row[1:]), (*row[:3], -1.0, *row[4:]), (*row[:5], 0.0, *row[6:]), (*row[:6], None, "X"), (*row[:6], 7.5, "X"),
            (*row[:5], float("nan"), *row[6:]), (*row[:3], float("inf"), *row[4:]), (" 3 ", None, None, 1.0, day, 2.0, 8.0, None), (*row[:4], None, *row[5:])]
    raw = spark.createDataFrame(rows, LEDGER_SCHEMA)
    kept = cleaning.clean(raw, "1995-01-01", "1996-01-01").orderBy("customer_id").collect()
    assert [(k.invoice_no, k.stock_code, k.description, k.country, k.total_price) for k in kept] == [("1", "A", "thing", "X", 2.0), ("3", "nan", "Unknown product", "Unspecified", 2.0)]
    assert cleaning.clean(raw, "1995-01-01", "1996-01-01", deduplicate=False).count() == 3
    report = cleaning.cleaning_report(raw, "1995-01-01", "1996-01-01").first()
    assert (report.raw_rows, report.duplicates_removed, report.qualifying_rows, report.rejected_rows) == (12, 1, 2, 9)
    with pytest.raises(ValueError, match="country"):
        cleaning.normalise(raw.drop("country"))
    path = str(tmp_path / "ledger.csv")
    raw.write.option("header", True).csv(path)
    assert cleaning.clean(read_ledger(spark, path, "csv"), "1995-01-01", "1996-01-01").count() == 2


def test_row_order_checks(spark):
    import datetime as dt

    days = [1, 2, 2, 1, 5, 4, 6, 6, 3]
    rows = [("1", "A", "t", 1.0, dt.datetime(1995, 1, d), 1.0, 1.0, "X", n) for n, d in enumerate(days)]
    df = spark.createDataFrame(rows, "invoice_no string, stock_code string, description string, quantity double, invoice_date timestamp, unit_price double, customer_id double, country string, n long")
    assert cleaning.out_of_order_rows(df, "n", buckets=4).first()[0] == 3
    found = [(r.n, r.first_row) for r in cleaning.duplicate_examples(df, "n").collect()]
    assert found == [(2, 1), (3, 0), (7, 6)]


def test_calendar_and_variants(spark, sf_dir):
    config = calendar.CycleConfig()
    rows = calendar.calendar(spark, config).orderBy("cycle_number").collect()
    assert len(rows) == 10 and str(rows[0].period_start)[:10] == "1995-01-01" and str(rows[9].period_end)[:10] == config.end == "1996-01-01"
    assert all(a.period_end == b.period_start for a, b in zip(rows, rows[1:])) and all((r.snapshot_date - r.window_start).days == 90 for r in rows)
    months = calendar.calendar(spark, calendar.CycleConfig(window_mode="months")).orderBy("cycle_number").first()
    assert str(months.window_start)[:10] == "1995-01-01"
    short = spark.sql("select timestamp '1999-01-01' as invoice_date")
    with pytest.raises(ValueError):
        calendar.require_coverage(short, config)


def test_scaling_and_projection(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    df = spark.createDataFrame([(*map(float, r), 4.0) for r in x], "a double, b double, c double, k double")
    scaling = features.fit_min_max(df, ("a", "k"))
    row = scaling.apply(df).agg(F.min("scaled_a"), F.max("scaled_a"), F.max("scaled_k")).first()
    assert row[0] == 0 and row[1] == pytest.approx(1) and row[2] == 0
    robust = features.fit_robust(df, ("a", "k"))
    assert robust.shift[0] == pytest.approx(np.median(x[:, 0])) and robust.width[0] == pytest.approx(np.subtract(*np.percentile(x[:, 0], [75, 25]))) and robust.width[1] == 0
    pca = features.fit_pca(df, ("a", "b", "c"), 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(pca.loadings), np.abs(vectors[:, ::-1].T[:2]), atol=1e-8) and pca.explained[0] == pytest.approx(values[-1] / values.sum())
    assert pca.apply(df).agg(F.avg("pc1")).first()[0] == pytest.approx(0, abs=1e-9)


def test_profile_names(spark):
    names = ["Champions · centre 2", "Developing at Risk", "Loyalist at Risk · x", None, "Other"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = df.select(profiles.public_name(F.col("n")), profiles.base_name(F.col("n")), profiles.display_rank(F.col("n")), sinks.slug(F.col("n"))).orderBy("i").collect()
    assert [g[0] for g in got] == ["High-Value Regulars", "Light Buyers at Risk", "Valuable Customers at Risk · x", "", "Other"]
    assert [g[2] for g in got] == [1, 7, 3, 9, 9] and got[0][3] == "champions_centre_2"


def test_membership_details_round_trip(spark):
    df = spark.createDataFrame([([0.25, 0.75],)], "u array<double>")
    details = membership.membership_details(F.col("u"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("y")))
    text = df.select(F.to_json(details).alias("j")).unionByName(spark.createDataFrame([("{bad",), (None,)], "j string"))
    got = [r[0] for r in text.select(membership.membership_in(membership.parse_details(F.col("j")), F.lit("b"))).collect()]
    assert got == [0.75, 0.0, 0.0]


def test_quality_jobs(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "k int, v double")
    assert quality.same_rows(a, a.orderBy(F.desc("k"))) and not quality.same_rows(a, a.distinct())
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, 0.0)], "k int, v double")
    r = quality.residuals(a.distinct(), b, ["k"], {"v": 0.1}).first()
    assert r.largest == 0.5 and r.unpaired == 1 and not r.holds
    with pytest.raises(ValueError):
        quality.require_unique(a, ["k"])
    with pytest.raises(ValueError):
        quality.require_none(spark.createDataFrame([("rule", 2)], "rule string, violations long"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 3, float("inf")), (1, 1, 2.0), (1, 2, float("nan"))], "cycle_number int, x int, v double")
    run = str(tmp_path / "run")
    sinks.write_table(sinks.sink_ready(df), run, "t")
    assert sinks.read_table(spark, run, "t").where("v is not null").count() == 1
    ids = {(r.cycle_number, r.x): r.id for r in sinks.with_surrogate_ids(df, "id", ["x"]).collect()}
    assert ids == {(0, 3): 1, (1, 1): 2, (1, 2): 3}
    sinks.derive_run(spark, run, str(tmp_path / "next"), ["t"], {"m": df})
    with pytest.raises(Exception):
        sinks.derive_run(spark, run, str(tmp_path / "next"), ["t"], {})
    meta = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in sinks.upsert_metadata(meta, spark.createDataFrame([("b", "3")], meta.schema)).collect()} == {("a", "1"), ("b", "3")}


def test_paging_is_stable_and_complete(spark):
    df = spark.range(120).select(F.col("id").alias("k"), F.lit("An_x").alias("name"))
    seen = [r.k for p in (1, 2, 3) for r in reports.page(df, reports.matches({"name": "aN_"}), ["k"], p, 50).collect()]
    assert seen == list(range(120))
    assert reports.browse(df, {"name": "nx"}, "k").count() == 0 and reports.top(df, "k", "name", 3).count() == 3


def test_behaviour_variants(spark):
    rows = [(1, 7, 0, "Inactive", 40, [0.6, 0.4], [0.2, 0.5, 0.3], "CL-001", "CL-001", "Active"), (1, 8, 1, "Active", 5, [0.6, 0.4], None, "CL-001", None, None)]
    df = spark.createDataFrame(rows, "cycle_number int, customer_id int, is_new int, activity_status string, recency int, u array<double>, prev_u array<double>, stable_cluster_id string, prev_stable_cluster_id string, prev_activity_status string")
    kept = behaviour.keep_inactive_memberships(df, F.array(F.lit(1), F.lit(2)))
    got = df.select("customer_id", kept.alias("u"), behaviour.transition("activity").alias("t"), behaviour.recency_label(F.lit("Light"), F.col("recency")).alias("n")).orderBy("customer_id").collect()
    assert list(got[0].u) == pytest.approx([0.625, 0.375]) and got[0].t == "Inactive" and got[0].n == "Light At Risk"
    assert list(got[1].u) == [0.6, 0.4] and got[1].t == "New"


def test_rank_share_averages_ties(spark):
    df = spark.createDataFrame([(0, v) for v in (3.0, 1.0, 3.0, 2.0)], "cycle_number int, v double")
    got = sorted((r.v, r.rank_share) for r in snapshot.rank_share(df, "v").collect())
    assert got == [(1.0, 0.25), (2.0, 0.5), (3.0, 0.875), (3.0, 0.875)]


def test_replace_table_swaps_and_keeps_the_old_one_on_failure(spark, tmp_path):
    path = str(tmp_path / "run")
    old = spark.createDataFrame([(0, "a"), (1, "b")], "cycle_number int, v string")
    sinks.replace_table(old, path, "t")
    again = sinks.read_table(spark, path, "t")
    sinks.replace_table(again.withColumn("v", F.upper("v")), path, "t")
    assert sorted(r["v"] for r in sinks.read_table(spark, path, "t").collect()) == ["A", "B"]
    broken = old.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        sinks.replace_table(broken, path, "t")
    assert sorted(r["v"] for r in sinks.read_table(spark, path, "t").collect()) == ["A", "B"]
    assert [f.name for f in (tmp_path / "run").iterdir() if "__old" in f.name] == []


def test_run_invariants_count_planted_faults(spark):
    cycles = spark.createDataFrame([(0, "2020-02-01"), (1, "2020-03-01"), (2, "2020-04-01")], "cycle_number int, period_end string")
    row = "cycle_number int, customer_id long, first_purchase string, latest_purchase string, recency int, u array<double>, cluster_index int, stable_cluster_id string"
    state = spark.createDataFrame(
        [
            (0, 1, "2020-01-01", "2020-01-02", 30, [1.0, 0.0], 0, "a"),
            (0, 2, "2020-01-05", "2020-01-02", 30, [1.0, 0.0], 0, "b"),
            (1, 1, "2020-01-01", "2020-01-02", 1, [0.4, 0.6], 0, "a"),
            (1, 2, "2020-01-01", "2020-02-29", 1, [1.2, 0.1, -0.3], 1, "a"),
        ],
        row,
    )
    found = {r["rule"]: r["violations"] for r in quality.run_invariants(state, cycles, 2).collect()}
    assert found == {
        "recency differs from the last purchase": 1,
        "last purchase before the first": 1,
        "memberships of another number": 1,
        "membership outside 0 to 1": 1,
        "assigned below the highest membership": 2,
        "cycle without customers": 1,
        "fewer customers than the cycle before": 0,
        "centre without mass": 2,
        "several ids for one centre": 1,
        "several centres for one id": 1,
    }
    assert {r["violations"] for r in quality.run_invariants(state.limit(0), cycles, 2).where("rule <> 'cycle without customers'").collect()} == {0}


def test_explained_variance_is_that_of_the_projected_rows(spark, sf_dir):
    found = sorted(tuple(r) for r in details.explained_variance(spark, sf_dir).collect())
    assert [c for c, _, _ in found] == [1, 2, 3] and sum(e for _, e, _ in found) <= 1 + 1e-6
    assert all(e == pytest.approx(p, abs=2e-6) for _, e, p in found)
    assert found[0][1] >= found[1][1] >= found[2][1] >= 0


def test_arrival_numbers_follow_files_and_rows(spark, tmp_path):
    """Many files and many splits; numbers are gapless and in the order of names and rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from segmentflow.sources.arrival import numbered_csv, numbered_parquet

    sizes, n = [700, 1, 0, 1500, 30], 0
    for kind in ("parquet", "csv"):
        (tmp_path / kind).mkdir()
    for i, size in enumerate(sizes):
        own = list(range(n, n + size))
        n += size
        pq.write_table(pa.table({"v": pa.array(own, pa.int64()), "a.b": pa.array(["x"] * size)}), tmp_path / "parquet" / f"part-{i}.parquet", row_group_size=100)
        (tmp_path / "csv" / f"part-{i}.csv").write_text("v,w\n" + "".join(f"{v},text {v}\n" for v in own))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "2048")
        for rows in (numbered_parquet(spark, str(tmp_path / "parquet")), numbered_csv(spark, str(tmp_path / "csv"))):
            got = rows.select(F.col("v").cast("long"), "arrival").collect()
            assert sorted(r.arrival for r in got) == list(range(n)) and all(r.v == r.arrival for r in got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_first_of_equal_rows_is_kept_and_crowded_repeats_are_shown(spark, tmp_path):
    row = ("1", "a", "d", 1.0, datetime.datetime(2020, 1, 5), 2.0, 7.0, "X")
    late = ("2", "b", "d", 1.0, datetime.datetime(2020, 1, 5), 2.0, 7.0, "X")
    rows = [(*r, i) for i, r in enumerate([late, row, row, late, *[row] * 50])]
    df = spark.createDataFrame(rows, T.StructType([*LEDGER_SCHEMA.fields, T.StructField("arrival", T.LongType())])).repartition(4)
    shown = cleaning.duplicate_examples(df, "arrival", limit=5).collect()
    assert [(r.arrival, r.first_row, r.occurrence) for r in shown] == [(2, 1, 2), (3, 0, 2), (4, 1, 3), (5, 1, 4), (6, 1, 5)]
    sales = cleaning.clean(df, "2020-01-01", "2021-01-01", arrival="arrival")
    assert sorted(r.arrival for r in sales.collect()) == [0, 1]
    ends = cleaning.first_and_last(sales, "arrival").first()
    assert (ends.first_invoice, ends.last_invoice, ends.first_row, ends.last_row) == ("2", "1", 0, 1)
    assert cleaning.out_of_order_rows(df.limit(0), "arrival").first()[0] == 0
    assert cleaning.out_of_order_rows(df.withColumn("invoice_date", F.when(F.col("arrival") % 2 == 0, F.col("invoice_date"))), "arrival").first()[0] == 0


@pytest.mark.parametrize("small, cuts", [(100_000, 200), (20, 8), (3, 4)])
def test_order_statistics_of_ties_skew_and_gaps(spark, monkeypatch, small, cuts):
    """One crowded value, long tails, tiny and null groups; small ranges make every round of refinement run."""
    monkeypatch.setattr(order_stats, "SMALL_RANGE", small)
    monkeypatch.setattr(order_stats, "CUTS", cuts)
    rng = np.random.default_rng(4)
    groups = {
        1: np.concatenate([np.full(300, 5.0), rng.exponential(4, 300)]), 2: rng.normal(size=501), 3: np.array([7.0]), 4: np.array([-1.0, 2.0]),
        5: np.full(400, 1.5), None: rng.integers(0, 9, 200).astype(float), 6: np.array([-1e300, 1e300, 0.0, 1e-300]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (2, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    shares = {"least": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "most": 1.0}
    for linear in (False, True):
        got = {r.g: r for r in order_stats.order_statistics(df, ["g"], "v", shares, linear).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert got[g].n == len(vs)
            for name, p in shares.items():
                want = np.quantile(vs, p) if linear else np.sort(vs)[math.floor((len(vs) - 1) * p)]
                assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
    whole = order_stats.order_statistics(df.where("g = 2"), [], "v", {"median": 0.5}).first()
    assert whole.median == np.sort(groups[2])[250]


def test_surrogate_ids_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(g, x) for g in range(3) for x in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "cycle_number int, x int")
    got = {(r.cycle_number, r.x): r.id for r in sinks.with_surrogate_ids(df, "id", ["x"]).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows), 1)}
