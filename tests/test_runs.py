"""Runs by manifest, stored reports and the registry's digests."""

import pytest
from pyspark.sql import functions as F

from segmentflow.operators import quality, registry
from segmentflow.plans import state
from segmentflow.sources.runs import CommitConflict, Run


def test_versions_failed_commits_and_derived_runs(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    assert run.versions() == [] and run.manifest()["tables"] == {}
    first = spark.createDataFrame([(0, "a"), (1, "b")], "cycle_number int, v string")
    assert run.commit({"t": first, "kept": first}) == 1
    reader = run.read("t")  # opened before the next version, read after it
    assert run.commit({"t": run.read("t").withColumn("v", F.upper("v"))}) == 2  # reads what it replaces
    assert sorted(r.v for r in reader.collect()) == ["a", "b"] and sorted(r.v for r in run.read("t").collect()) == ["A", "B"]
    assert run.read("kept").count() == 2 and run.manifest(2)["tables"]["kept"] == run.manifest(1)["tables"]["kept"]
    assert sorted(r.v for r in run.read("t", 1).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        run.commit({"t": first.withColumn("v", F.raise_error(F.lit("no")).cast("string"))})
    assert run.versions() == [1, 2] and sorted(r.v for r in run.read("t").collect()) == ["A", "B"] and len(run.unreferenced()) == 1
    with pytest.raises(CommitConflict):  # made from version 1, which another writer has followed
        run.commit({"t": first}, base=1)
    assert sorted(r.v for r in run.read("t").collect()) == ["A", "B"]
    assert run.commit({}, dropped=("t",)) == 3
    with pytest.raises(ValueError):
        run.read("t")
    (tmp_path / "run" / "_versions" / ".draft").write_text("{half")  # a writer that died
    assert run.versions() == [1, 2, 3]
    after = run.derive(str(tmp_path / "next"), ["kept"], {"t": first})
    assert after.manifest()["tables"]["kept"] == run.manifest()["tables"]["kept"] and not (tmp_path / "next" / "kept").exists()
    assert after.read("t").count() == after.read("kept").count() == 2
    with pytest.raises(CommitConflict):
        run.derive(str(tmp_path / "next"), ["kept"], {})
    with pytest.raises(ValueError):
        run.derive(str(tmp_path / "other"), ["nothing"], {})


def test_reports_follow_a_source_that_is_written_again(spark, sf_dir, tmp_path):
    for name in state.SOURCES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = state.ledger(spark, str(tmp_path)).count()
    assert state.ledger(spark, str(tmp_path)).count() == rows and state.rfm(spark, str(tmp_path)).rdd.getNumPartitions() > 0
    half = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey % 2 = 0")
    half.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < state.ledger(spark, str(tmp_path)).count() < rows


def test_stored_tables_are_read_cycle_by_cycle(spark, sf_dir):
    plan = state.segments(spark, sf_dir).where("cycle_number = 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cycle_number" in plan
    assert state.segments(spark, sf_dir).columns[0] == "cycle_number"


def test_registry_digests_find_loss_swaps_and_repeats(spark):
    rows = [(c, i, (i + c) % 3, [1.0, 0.0, 0.0], f"CL-00{(i + c) % 3 + 1}") for c in range(2) for i in range(30)]
    schema = "cycle_number int, customer_id long, cluster_index int, u array<double>, stable_cluster_id string"
    given = spark.createDataFrame(rows, schema)
    centres = spark.createDataFrame([(c, k, f"CL-00{k + 1}", f"N{k}") for c in range(2) for k in range(3)], "cycle_number int, cluster_index int, stable_cluster_id string, segment_name string")
    links = spark.createDataFrame([(1, f"CL-00{k}", f"CL-00{k}") for k in (1, 2, 3)], "cycle_number int, previous_id string, current_id string")
    stored = registry.digested(given, centres).cache()
    assert stored.count() == 6 and stored.agg(F.sum("members")).first()[0] == 60
    audit = lambda a=given, b=links, p=given, s=stored: {r.rule: r.violations for r in registry.registry_violations(s, a, b, p).collect() if r.violations}
    assert audit() == {} and audit(given.repartition(9).orderBy(F.desc("customer_id"))) == {}
    lost = given.where("not (cycle_number = 1 and customer_id = 4)")
    assert set(audit(lost)) == {"a centre's members differ from the assignments", "a centre's members are others"}
    assert audit(p=lost) == {"population differs from the panel": 1}
    swapped = given.withColumn("customer_id", F.when((F.col("cycle_number") == 0) & F.col("customer_id").isin(0, 1), 1 - F.col("customer_id")).otherwise(F.col("customer_id")))
    assert audit(swapped) == {"a centre's members are others": 2}  # the same numbers, other customers
    repeated = given.unionByName(given.where("cycle_number = 0 and customer_id = 5"))
    assert {"a customer twice in a cycle", "a centre's members are others"} <= set(audit(repeated))
    assert audit(b=links.where("current_id <> 'CL-002'")) == {"a centre that the lineage does not reach": 1, "a centre that the lineage does not leave": 1}
    more = links.unionByName(spark.createDataFrame([(1, None, "CL-009")], links.schema))
    assert audit(b=more) == {"a lineage id without a centre": 1}


def test_repeats_change_values_and_assignments(spark):
    from segmentflow.sources.ledger import LEDGER_SCHEMA
    import datetime

    row = ("1", "a", "d", 10.0, datetime.datetime(2020, 1, 5), 30.0, 7.0, "X")
    other = ("2", "b", "d", 1.0, datetime.datetime(2020, 1, 6), 5.0, 8.0, "X")
    raw = spark.createDataFrame([row, row, row, other, ("C3", *row[1:]), ("C3", *row[1:])], LEDGER_SCHEMA)
    panel = spark.createDataFrame([(0, 7, 1.0, 1.0, 100.0), (0, 8, 1.0, 1.0, 5 / 3)], "cycle_number int, customer_id long, log_r double, log_f double, monetary double")
    cycles = spark.createDataFrame([(0, "2020-01-01", "2020-02-01")], "cycle_number int, window_start string, snapshot_date string")
    centres = F.array(*[F.array(F.lit(1.0), F.lit(1.0), F.log1p(F.lit(m))) for m in (100.0, 300.0)])
    got = {r.customer_id: r for r in quality.duplicate_assignments(raw, panel, cycles, centres, "2020-01-01", "2021-01-01").collect()}
    assert (got[7].monetary_with, got[7].cluster_without, got[7].cluster_with) == (300.0, 0, 1)
    assert got[8].monetary == got[8].monetary_with and got[8].cluster_without == got[8].cluster_with == 0


def test_reports_over_a_fitted_run_equal_sql_over_its_tables(spark, sf_dir, tmp_path):
    """The run's stored tables, read by both engines."""
    import duckdb

    from segmentflow.plans import fitted

    run = fitted.tables(spark, sf_dir)
    con = duckdb.connect()
    for name in ("assignments", "panel", "state", "centres", "candidates", "quality"):
        run[name].coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
    for name, function in fitted.REPORTS.items():
        df = function(run)
        columns = sorted(df.columns)
        got = sorted((tuple(x) for x in df.select(*columns).collect()), key=str)
        want = sorted(con.execute(f"select {', '.join(columns)} from ({fitted.RUN_SQL[name]})").fetchall(), key=str)
        assert got == want and got, name
    for name in ("fitted_separation", "country_residuals", "registry_audit", "centre_replay", "identity_replay", "fit_replay", "baseline_k_table", "country_k_table", "random_fuzzy_fits"):
        from segmentflow.plans.queries import QUERIES

        rows = QUERIES[name](spark, sf_dir).collect()
        assert rows and all(x["holds"] for x in rows if "holds" in x) and not any(x["violations"] for x in rows if "violations" in x), name


def test_csv_exports_read_back(spark, tmp_path):
    """One folder of CSV for a table, and one per profile under its slug."""
    from segmentflow.sources import sinks

    rows = [("Hibernating / Lost", 1, 2.5), ("Hibernating / Lost", 2, None), ("Champions", 3, -1.0), ("Mid-Tier, \"quoted\"", 4, 0.0)]
    df = spark.createDataFrame(rows, "profile string, customer_id int, value double")
    sinks.write_csv(df, f"{tmp_path}/all")
    back = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/all", schema=df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    sinks.write_profile_csvs(df, f"{tmp_path}/profiles", "profile")
    assert sorted(p.name for p in (tmp_path / "profiles").iterdir() if p.is_dir()) == ["slug=champions", "slug=hibernating_lost", "slug=mid_tier_quoted"]
    own = spark.read.option("header", True).csv(f"{tmp_path}/profiles/slug=hibernating_lost")
    assert sorted(r.customer_id for r in own.collect()) == ["1", "2"]
