"""Steps whose memory, disk or jobs must not grow with the size of a group."""

import numpy as np
from pyspark.sql import functions as F

from segmentflow.operators import behaviour, clustering, order_stats, snapshot, sweep, validity
from segmentflow.plans import cycles, state
from segmentflow.sources import arrival


def test_silhouettes_of_repeated_points_and_partial_labels(spark):
    """Equal rows are one weighted point; strips, null labels and singletons give the sums over all pairs."""
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(0, 2, (60, 3)), 1)
    x = base[rng.integers(0, 60, 400)]
    first, second = (x[:, 0] > 0).astype(int), np.where(x[:, 1] > 0.5, (x[:, 2] > 0).astype(int), -1)
    second[7] = 5
    rows = [(i, x[i].tolist(), int(first[i]), None if second[i] < 0 else int(second[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "customer_id int, point array<double>, a int, b int").withColumn("g", F.lit("k"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def slow(label):
        out = {}
        for i in np.flatnonzero(label >= 0):
            own, others = label == label[i], sorted(set(label[label >= 0]) - {label[i]})
            inside, outside = d[i, own].sum() / max(own.sum() - 1, 1), min(d[i, label == k].mean() for k in others)
            out[int(i)] = 0.0 if own.sum() == 1 else (outside - inside) / max(inside, outside)
        return out

    labels = F.array("a", "b")
    for block in (7, 4096):
        got = validity.exact_silhouettes(df, labels, ["g"], block_rows=block).collect()
        for place, label in enumerate((first, second)):
            found, wanted = {r.customer_id: r.silhouette for r in got if r.place == place}, slow(label)
            assert found.keys() == wanted.keys() and np.allclose([found[i] for i in wanted], list(wanted.values()), atol=1e-9)
    points = validity.point_silhouettes(df, labels, ["g"])
    assert points.count() == len({(tuple(p), a, b) for p, a, b in zip(x.tolist(), first.tolist(), second.tolist())})
    means = validity.weighted_silhouettes(df, labels, ["g"]).groupBy("place").agg(validity.mean_silhouette().alias("m"), F.sum("rows").alias("n")).orderBy("place").collect()
    assert [m.n for m in means] == [400, int((second >= 0).sum())]
    assert np.allclose([m.m for m in means], [np.mean(list(slow(v).values())) for v in (first, second)])


def test_silhouettes_of_the_panel_read_counted_kinds(spark, sf_dir, monkeypatch):
    """The silhouette queries store no assigned rows, and count what they would give."""
    from segmentflow.plans import queries

    monkeypatch.setattr(state, "segments", lambda *a: (_ for _ in ()).throw(AssertionError("assigned rows are stored")))
    exact, cohorts = (queries.QUERIES[n](spark, sf_dir).collect() for n in ("exact_silhouettes", "cohort_silhouettes"))
    rows = state.assigned(state.rfm(spark, sf_dir)).cache()
    wanted = {(r.cycle_number, r.label): (r.n, r.s) for r in validity.exact_silhouettes(rows, F.array("cluster_index"), ["cycle_number"]).groupBy("cycle_number", "label").agg(F.count("*").alias("n"), F.avg("silhouette").alias("s")).collect()}
    assert {(r.cycle_number, r.cluster_index): r.customers for r in exact} == {k: n for k, (n, _) in wanted.items()}
    assert all(np.isclose(r.mean_silhouette, wanted[r.cycle_number, r.cluster_index][1], atol=1e-5) for r in exact if r.mean_silhouette is not None)
    each = {(r.cycle_number, r.cohort): r for r in validity.cohort_silhouettes(rows, ["cycle_number"]).collect()}
    assert len(cohorts) == len(each) > 20
    for r in cohorts:
        own = each[r.cycle_number, r.cohort]
        assert (r.customers, r.occupied) == (own.customers, own.occupied) and np.isclose(r.mean_membership, own.mean_membership, atol=1e-6)
        assert (r.mean_silhouette is None) == (own.mean_silhouette is None) and (own.mean_silhouette is None or np.isclose(r.mean_silhouette, own.mean_silhouette, atol=1e-5))
    rows.unpersist()


def test_iterations_run_over_distinct_points_in_one_job(spark):
    """A pass meets every distinct point once, with its rows as weight, and is one job."""
    rng = np.random.default_rng(2)
    base = rng.normal(0, 2, (50, 3))
    picked = rng.integers(0, 50, 3_000)
    out = picked % 7 == 0
    df = spark.createDataFrame([(base[p].tolist(), bool(o)) for p, o in zip(picked, out)], "point array<double>, o boolean")
    blocks = clustering.fuzzy_blocks(df, "o").persist()
    assert sum(len(r.n) // 8 for r in blocks.collect()) == len(set(picked.tolist()))
    centres = base[:4] + 0.1
    x = base[picked]
    d2 = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    u = 1 / d2 / (1 / d2).sum(axis=1, keepdims=True)
    s = clustering.packed_fuzzy_sums(blocks, [centres], 2.0)[0]
    assert s["rows"] == 3_000 and np.isclose(s["objective"], (u**2 * d2).sum())
    for own, prefix in ((~out, ""), (out, "out_")):
        assert np.allclose(s[prefix + "weight"], (u[own] ** 2).sum(axis=0)) and np.allclose(s[prefix + "moment"], (u[own] ** 2).T @ x[own])
        assert np.allclose(s[prefix + "won"], [u[own & (u.argmax(axis=1) == k)].max(axis=1).sum() for k in range(4)])
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pass", "one pass")
    clustering.packed_fuzzy_sums(blocks, [centres], 2.0)
    jobs = seen.getJobIdsForGroup("pass")
    spark.sparkContext.setJobGroup("none", "")
    assert len(jobs) == 1
    blocks.unpersist()


def test_a_fit_over_few_points_is_few_jobs_and_equals_passes(spark, monkeypatch):
    """All passes of all starts are one job while tasks may hold the distinct points; a job per pass gives the same."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(np.round(p, 1).tolist(),) for p in rng.normal(0, 2, (400, 3))], "point array<double>").cache()
    tried = [clustering.Start(f"s{i}", rng.normal(0, 2, (3, 3)), np.ones(3) if i == 1 else None) for i in range(4)]
    seen, config = spark.sparkContext.statusTracker(), clustering.FuzzyConfig(tolerance=1e-9)

    def counted(name):
        spark.sparkContext.setJobGroup(name, name)
        fits, found = clustering.fit_starts(df, tried, config), sweep.kmeans(df, [2, 4], 5)
        jobs = len(seen.getJobIdsForGroup(name))
        spark.sparkContext.setJobGroup("none", "")
        return jobs, fits, found

    few, fits, found = counted("held")
    monkeypatch.setattr(clustering, "MOST_HELD", 0)
    many, fits_again, found_again = counted("passes")
    assert max(f.iterations for f in fits) > 20 and few <= 16 < many
    for a, b in zip(fits, fits_again, strict=True):
        assert (a.source, a.iterations, a.converged) == (b.source, b.iterations, b.converged) and np.allclose(a.centres, b.centres)
    assert all(found[k].sizes == found_again[k].sizes and np.isclose(found[k].cost, found_again[k].cost) for k in (2, 4))
    df.unpersist()


def test_the_registry_reads_stored_assignments(spark, sf_dir, monkeypatch):
    """Digests of a run are made from its stored rows."""
    seen = []
    real = state.registry.digested
    monkeypatch.setattr(state.registry, "digested", lambda a, c: seen.append(len(a.inputFiles())) or real(a, c))
    monkeypatch.setattr(state, "_TABLES", {})
    monkeypatch.setattr(state, "run_cycles", lambda panel: cycles.run(panel, most_clusters=4, seeds=2))
    run = state.fitted_run(spark, sf_dir)
    assert run["registry"].count() > 0 and seen == [len(run["assignments"].inputFiles())] and seen[0] > 0
    assert set(run["assignments"].inputFiles()) and "fit_assignments" in run["assignments"].inputFiles()[0]


def test_rows_of_one_file_or_one_large_group_are_not_shuffled_by_it(spark, tmp_path, monkeypatch):
    """One file, or one large group, must not put all its rows into one task of a join."""
    spark.range(1000).selectExpr("id", "id % 2 AS g", "cast(id * 7 % 1000 AS double) AS v").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = arrival.numbered_parquet(spark, str(tmp_path / "one"))
        assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.arrival for r in numbered.collect()) == list(range(1000))
        monkeypatch.setattr(order_stats, "SMALL_RANGE", 50)
        rows = numbered.select("g", "v").unionByName(spark.createDataFrame([(2, 5.0), (2, 6.0), (None, 1.0)], "g long, v double"))
        plans, real = [], order_stats._inside
        monkeypatch.setattr(order_stats, "_inside", lambda *a: plans.append(real(*a)) or plans[-1])
        got = {r.g: r.m for r in order_stats.order_statistics(rows, ["g"], "v", {"m": 0.5}).collect()}
        evens, odds = (sorted(i * 7 % 1000 for i in range(k, 1000, 2)) for k in (0, 1))
        assert got == {0: evens[249], 1: odds[249], 2: 5.0, None: 1.0}
        texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
        assert len(texts) > 1 and all("BroadcastHashJoin" in t for t in texts) and not any("SortMergeJoin" in t for t in texts[:-1])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_panel_multiplies_no_rows_and_the_state_shuffles_panels_only(spark, sf_dir, monkeypatch):
    """Distinct counts need no copy of a row per measure or window; what a panel row gives is assigned behind the join."""
    sales, calendar = state.ledger(spark, sf_dir), state.cycles(spark)
    built = snapshot.panel(sales, calendar)
    assert "Expand" not in built._jdf.queryExecution().executedPlan().toString()
    rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])
    monkeypatch.setattr(snapshot, "MASK_CYCLES", 3)
    assert rounded(built).exceptAll(rounded(snapshot.panel(sales, calendar))).isEmpty()
    rows = state.rfm(spark, sf_dir)
    found, wanted = state.with_previous(rows), behaviour.with_previous(state.assigned(rows))
    assert found.columns == wanted.columns and found.count() == wanted.count() and found.exceptAll(wanted).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        plan = state.with_previous(rows)._jdf.queryExecution().executedPlan().toString()
        assert "top_membership" in plan.split("SortMergeJoin")[0] and "top_membership" not in plan.split("SortMergeJoin")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_the_cycle_loop_and_the_replay_read_kinds_of_customers(spark, monkeypatch):
    """Customers of equal measures are one weighted row of every pass, and the sums are those over all customers."""
    from segmentflow.operators import replay

    rng = np.random.default_rng(3)
    kinds = []
    for i in range(60):
        r, f, m = [5, 45, 150][i % 3] + int(rng.integers(0, 8)), [6, 2, 0][i % 3] + rng.random() / 3, [900, 200, 0][i % 3] + float(rng.integers(0, 40))
        lr, lf, lm = np.log1p([r, f, m])
        kinds.append((r, float(f), float(m), *map(float, (lr, lf, lm, lr * lf, lr * lm, lf * lm))))
    rows = [(c, 60 * copy + i, *kinds[(i + 3 * c) % 60]) for c in range(2) for copy in range(5) for i in range(60) if c == 0 or i % 10 or copy]
    panel = spark.createDataFrame(rows, "cycle_number int, customer_id long, recency int, frequency double, monetary double, log_r double, log_f double, log_m double, rf_score double, rm_score double, fm_score double")
    seen, real = [], clustering.packed
    counted = lambda points, *a, **k: seen.append(points.count()) or real(points, *a, **k)
    monkeypatch.setattr(clustering, "packed", counted)
    monkeypatch.setattr(replay, "packed", counted)
    run = cycles.run(panel, most_clusters=4, seeds=2)
    tables = {n: df.cache() for n, df in run.tables().items()}
    assert all(r.holds for r in replay.candidates_again(*[tables[n] for n in ("assignments", "centres", "candidates")]).collect())
    assert len(seen) >= 5 and max(seen) <= 120
    assert [q["n"] for q in run.quality] == [300, 294] and sum(run.k_table[0]["sizes"]) == 300
    found = {(r.cycle_number, r.customer_id): r for r in tables["assignments"].collect()}
    both = [(found[0, i].u, found[1, i].u) for c, i in found if c == 1]
    p, q = (np.array([pair[side] for pair in both]) for side in (0, 1))
    for o in run.overlaps:
        a, b = np.round(p[:, o["previous_index"]], 8), q[:, o["current_index"]]
        assert np.isclose(o["overlap"], np.minimum(a, b).sum() / np.maximum(a, b).sum())
    gone = [r for (c, i), r in found.items() if c == 0 and (1, i) not in found]
    masses = np.bincount([r.cluster_index for r in gone], weights=[r.top_membership for r in gone], minlength=run.quality[0]["k"])
    assert len(gone) == 6 and all(np.allclose(c["carried"], masses) for c in run.candidates if c["carried"] is not None)
    for df in tables.values():
        df.unpersist()
