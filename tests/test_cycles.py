"""The cycle loop, market groups and the registry: invariants on small panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentflow.functions.membership import membership_details
from segmentflow.operators import clustering, lineage, markets, quality, registry, replay
from segmentflow.plans import cycles, state


def test_cycle_loop_invariants(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(2):
        for i in range(60):
            g = i % 3
            r, f, m = [5, 45, 150][g] + int(rng.integers(0, 8)), [6, 2, 0][g] + rng.random() / 3, [900, 200, 0][g] + float(rng.integers(0, 40))
            lr, lf, lm = np.log1p([r, f, m])
            rows.append((c, i, r, float(f), float(m), *map(float, (lr, lf, lm, lr * lf, lr * lm, lf * lm))))
    panel = spark.createDataFrame(rows, "cycle_number int, customer_id long, recency int, frequency double, monetary double, log_r double, log_f double, log_m double, rf_score double, rm_score double, fm_score double")
    run = cycles.run(panel, most_clusters=5, seeds=2)
    got = run.assignments.select("cycle_number", "customer_id", "u", "cluster_index", "stable_cluster_id", "segment_name").collect()
    assert len(got) == 120 and all(sum(g.u) == pytest.approx(1) for g in got)
    assert all(max(g.u) == 1 for g in got if g.cycle_number == 0)
    by = {c: {x["stable_cluster_id"] for x in run.centres if x["cycle_number"] == c} for c in (0, 1)}
    assert by[0] and by[0] & by[1] and [q["k"] for q in run.quality] == [len(by[0]), len(by[1])]
    assert sum(x["selected"] for x in run.candidates) == 1
    index = {(x["cycle_number"], x["stable_cluster_id"]): x["cluster_index"] for x in run.centres}
    assert all(x["current_index"] == index[1, x["current_id"]] for x in run.lineage if x["current_id"]) and all(
        x["previous_index"] == index[0, x["previous_id"]] for x in run.lineage if x["previous_id"]
    )
    tables = run.tables()
    audit = lambda **changed: {r["rule"]: r["violations"] for r in quality.fit_violations(*[{**tables, **changed}[n] for n in ("assignments", "centres", "lineage", "candidates")]).collect()}
    assert set(audit().values()) == {0}
    moved = tables["centres"].withColumn("centre", F.transform("centre", lambda x: x + F.col("cluster_index") * 0.5))
    assert audit(centres=moved)["memberships differ from the centres"] == 60
    swapped = tables["assignments"].withColumn("cluster_index", F.expr("pmod(cluster_index + 1, size(u))"))
    assert audit(assignments=swapped)["assigned to a farther centre"] == 120
    none = tables["candidates"].withColumn("selected", F.lit(False))
    assert audit(candidates=none)["not one candidate selected"] == 1 and audit(candidates=none)["selected candidate without the least index"] == 1
    again = spark.createDataFrame([(1, None, run.centres[0]["stable_cluster_id"], None, 0.01, None, "created", 0, None, 0), (1, "a", "b", 0.1, 0.5, 0.2, "continued", 1, 0, 0)], tables["lineage"].schema)
    found = audit(lineage=again)
    assert [found[n] for n in ("created id used before", "link below the least overlap", "primary link between two ids")] == [1, 1, 1]
    assert audit(centres=tables["centres"].unionByName(tables["centres"]))["two centres under one id"] == len(run.centres)
    # The replay agrees with the run, and sees each planted fault.
    again = lambda f, *names, **changed: [r.asDict() for r in f(*[{**tables, **changed}[n] for n in names]).collect()]
    fits = lambda **changed: again(replay.candidates_again, "assignments", "centres", "candidates", **changed)
    links = lambda **changed: again(replay.identities_again, "assignments", "centres", "lineage", "overlaps", **changed)
    cycle = lambda **changed: again(replay.cycles_again, "assignments", "centres", "quality", **changed)
    assert len(fits()) == len(run.candidates) and all(r["holds"] for rows in (fits(), links(), cycle()) for r in rows) and len(links()) == len(cycle()) == 1
    keep = F.col("source") == "keep"
    for column, change in {
        "fitted": F.transform("fitted", lambda c: F.transform(c, lambda v: v + 1e-6)), "objective": F.col("objective") + 1e-6, "xie_beni": F.col("xie_beni") * 1.001,
        "iterations": F.col("iterations") + 1, "carried": F.transform("carried", lambda m: m + 50.0), "start": F.transform("start", lambda c: F.transform(c, lambda v: v + 0.05)),
    }.items():
        wrong = tables["candidates"].withColumn(column, F.when(keep, change).otherwise(F.col(column)))
        assert [r["source"] for r in fits(candidates=wrong) if not r["holds"]] == ["keep"], column
    for name, change in {"overlaps": {"overlap": F.col("overlap") + 1e-6}, "lineage": {"cost": F.col("cost") + 1e-6}}.items():
        assert not links(**{name: tables[name].withColumns(change)})[0]["holds"]
    assert not links(lineage=tables["lineage"].withColumn("event", F.lit("retired")))[0]["holds"]
    renamed = tables["centres"].withColumn("stable_cluster_id", F.when(F.col("cycle_number") == 1, F.translate("stable_cluster_id", "12", "21")).otherwise(F.col("stable_cluster_id")))
    assert links(centres=renamed)[0]["wrong_ids"] == 2
    for column in ("condition_one", "condition_two", "left_out", "n"):
        assert not cycle(quality=tables["quality"].withColumn(column, F.col(column) + 1))[0]["holds"], column
    assert cycle(assignments=tables["assignments"].withColumn("u", F.reverse("u")))[0]["membership_mismatches"] > 0
    for c in (0, 1):
        names = [x["segment_name"] for x in run.centres if x["cycle_number"] == c]
        assert len(names) == len(set(names))
        order = [x["stable_cluster_id"] for x in run.centres if x["cycle_number"] == c]
        assert len(order) == len(set(order))


@pytest.mark.parametrize("extra", [((0.0, 0.0, 0.0),), ((3.0, 0.0, 0.0),), ((0.0, 0.0, 3.0),)])
def test_update_equals_a_direct_computation(spark, extra):
    """All starts of all branches: moving centres leave out rows by the cycle before, other sizes are plain fuzzy c-means."""
    centres = np.array([[1, 1, 0], [1, -1, 0], [-1, 1, 0], [-1, -1, 0]], dtype=float)
    rng = np.random.default_rng(20261025)
    x = np.vstack([*[c + rng.normal(0.02, 0.05, (35, 3)) for c in centres], extra])
    df = spark.createDataFrame([(p.tolist(),) for p in x], "point array<double>")
    carried = np.array([35.0, 10.0, 0.0, 70.0])
    gaps = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2)

    def shares(c):
        d = gaps(c)
        return np.where((d <= 1e-24).any(axis=1, keepdims=True), d <= 1e-24, (1 / np.maximum(d, 1e-300)) / (1 / np.maximum(d, 1e-300)).sum(axis=1, keepdims=True))

    u = shares(centres)
    far = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)).max(axis=1) / 2
    out = (np.abs(u - 0.25).max(axis=1) <= 0.05) & (np.sqrt(gaps(centres)) > far).all(axis=1)
    fit, fits, met = clustering.update(df, centres, carried)
    assert met[2] == out.sum()
    for f in fits:
        now, last = f.start, None
        for updates in range(1, 301):
            u = shares(now)
            if f.carried is None:
                now = (u**2).T @ x / (u**2).sum(axis=0)[:, None]
            else:
                w, won = (u**2)[~out], np.array([u[~out & (u.argmax(axis=1) == k), k].sum() for k in range(4)])
                share = np.divide(won, f.carried + won, out=np.zeros(4), where=won > 0)[:, None]
                now = (1 - share) * f.start + share * (w.T @ x[~out] / w.sum(axis=0)[:, None])
            objective = (shares(now) ** 2 * gaps(now)).sum()
            if last is not None and abs(last - objective) <= 0.01:
                break
            last = objective
        assert f.iterations == updates and np.allclose(f.centres, now, atol=1e-9) and f.objective == pytest.approx(objective, abs=1e-9)
    sizes = [len(f.centres) for f in fits]
    assert sizes == sorted(sizes) and fit.xie_beni == min(f.xie_beni for f in fits)


def test_least_pairs_equal_augmenting_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        k, j = rng.integers(1, 7, 2)
        cost, allowed = rng.random((k, j)) * 1.4, rng.random((k, j)) < 0.7
        wide = np.zeros((k + j, k + j))
        wide[:k, :j], wide[:k, j:], wide[k:, :j] = np.where(allowed, cost, 1e6), 0.5, 0.5
        pairs = [(a, b) for a, b in lineage.assign_least_cost(wide) if a < k and b < j and allowed[a, b]]
        price, found = replay.least_pairs(cost, allowed, 0.5)
        assert found == sorted(pairs) and price == pytest.approx(sum(cost[p] for p in pairs) + 0.5 * (k + j - 2 * len(pairs)))


def test_market_groups_are_frozen_and_checked(spark):
    rng = np.random.default_rng(6)
    rows = [(c, f"N{i}", 1000.0 * (i % 3 + 1), 50.0 * (i % 2 + 1), 0.1 * (i % 4), *map(float, np.array([i % 3, i % 3, i % 2, i % 3, i % 2, 0.1 * (i % 4)]) + rng.random(6) / 20)) for c in range(2) for i in range(12)]
    schema = "cycle_number int, country string, revenue double, revenue_per_customer double, raw_repeat double, " + ", ".join(f"{f} double" for f in markets.MARKET_FEATURES)
    df = spark.createDataFrame(rows, schema)
    scaling, centres, table = markets.fit_groups(df, most=6, seeds=2)
    assert sum(t["selected"] for t in table) == 1 and table[0]["inertia"] >= table[-1]["inertia"]
    grouped = markets.grouped(df, scaling, centres)
    assert grouped.where("market is null").count() == 0 and grouped.where(f"market = '{markets.MARKET_NAMES[0]}'").count() > 0
    assert markets.group_fit(grouped).count() == 2
    with pytest.raises(ValueError):
        markets.fit_groups(df.where("country in ('N1', 'N2', 'N3')"))
    with pytest.raises(ValueError):
        markets.fit_groups(df.withColumn("log_revenue", F.lit(float("nan"))))


def test_registry_and_label_plan(spark, sf_dir):
    rows = state.assigned(state.rfm(spark, sf_dir))
    centres = spark.createDataFrame([(c, k, i, n) for c in range(10) for k, (i, n) in enumerate(zip(state.IDS, state.NAMES))], "cycle_number int, cluster_index int, stable_cluster_id string, segment_name string")
    found = registry.registry(rows, centres)
    assert found.count() == 40 and found.agg(F.sum("winners")).first()[0] == rows.count()
    masses = found.groupBy("cycle_number").agg(F.sum("membership_mass").alias("m"), F.sum("winners").alias("w"))
    assert masses.where("abs(m - w) > 1e-6").count() == 0
    plan = spark.createDataFrame([(1, "CL-001", "Best", 1)], "cycle_number int, stable_cluster_id string, display_label string, label_order int")
    assert registry.with_label_plan(found, plan).where("display_label = 'Best'").count() == 1
    for bad in ([(1, "CL-001", "A", 1), (1, "CL-001", "B", 2)], [(1, "CL-999", "A", 1)], [(1, "CL-001", "Loyalists", 1)]):
        with pytest.raises(ValueError):
            registry.with_label_plan(found, spark.createDataFrame(bad, plan.schema))
    retired = registry.retired_assignments(rows, centres.where("stable_cluster_id <> 'CL-004'"))
    assert retired.agg(F.sum("current_rows") + F.sum("retired_rows")).first()[0] == rows.count()
    detailed = rows.withColumn("details", membership_details(F.col("u"), state.literal(state.IDS), state.literal(state.NAMES)))
    names = {(r.cycle_number, r.stable_cluster_id): r.segment_name for r in registry.names_by_mass(detailed).collect()}
    assert names[(1, "CL-002")] == "Loyalists"
    old = detailed.withColumn("segment_name", F.lit("Developing")).withColumn("details", F.transform("details", lambda d: d.withField("segment_name", F.lit("Developing at Risk"))))
    new = registry.relabelled(old, ["segment_name"], "details").select("segment_name", F.col("details")[0]["segment_name"]).distinct().collect()
    assert [tuple(n) for n in new] == [("Light Buyers", "Light Buyers at Risk")]


def test_queries_sweep_with_the_defaults_of_the_operators(spark, sf_dir, monkeypatch):
    from segmentflow.operators import sweep as starts
    from segmentflow.plans import queries

    class Seen(Exception):
        pass

    def sweep(points, ks, seeds=30, *rest):
        raise Seen(max(ks), seeds, points.count())

    monkeypatch.setattr(starts, "kmeans", sweep)
    for name in ("dynamic_clusters", "country_groups"):
        try:
            queries.QUERIES[name](spark, sf_dir)
            raise AssertionError(name)
        except Seen as e:
            most, seeds, n = e.args
            assert most == min(10, n - 1) and seeds == 50
