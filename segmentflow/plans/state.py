"""The panel of the driver's tables and its segment state under stated centres."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentflow.functions.membership import centre_array, first_min, memberships, squared_distances
from segmentflow.operators import behaviour, markets, registry, reversals
from segmentflow.operators.calendar import CycleConfig, calendar, require_coverage
from segmentflow.operators.cleaning import clean, dedup_exact
from segmentflow.operators.snapshot import country_asof, panel
from segmentflow.plans.cycles import RUN_TABLES
from segmentflow.plans.cycles import run as run_cycles
from segmentflow.session import ensure_checkpoint_dir
from segmentflow.sources.ledger import order_ledger
from segmentflow.sources.runs import Run

CONFIG = CycleConfig()
#: Stated centres over (log_r, log_f, log_m); log_r moves by DRIFT a cycle, so boundaries move too.
CENTRES = ((2.5, 0.9, 10.0), (3.3, 0.5, 9.0), (4.2, 0.3, 8.0), (5.0, 0.0, 0.0))
DRIFT = 0.05
IDS = ("CL-001", "CL-002", "CL-003", "CL-004")
NAMES = ("Champions", "Loyalists", "Mid-Tier Occasionals", "Hibernating / Lost")


_TABLES: dict[tuple[str, str, str, str], tuple[str, list[str]]] = {}
#: The driver's tables that the ledger is made of.
SOURCES = ("lineitem", "orders", "part", "supplier", "nation")


def source_state(spark: SparkSession, sf_dir: str) -> str:
    """Times, sizes and numbers of files of the source tables; changes when one of them is written again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    told = []
    for name in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf)
        size = files.getContentSummary(path)
        told.append(f"{files.getFileStatus(path).getModificationTime()}/{size.getLength()}/{size.getFileCount()}")
    return " ".join(told)


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the application's run over a folder: written on first use, read by every report after it.

    Runs lie in the shared checkpoint folder, cycle by cycle where there are cycles.  A source table that is
    written again while an application runs makes another run; ``forget`` starts one at any time.
    """
    key = (spark.sparkContext.applicationId, sf_dir, source_state(spark, sf_dir), name)
    if key not in _TABLES:
        ensure_checkpoint_dir(spark)
        run = Run(spark, f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}")
        df = build()
        run.commit({name: df})
        _TABLES[key] = (run.root, df.columns)
    root, columns = _TABLES[key]
    return Run(spark, root).read(name).select(*[F.col(f"`{c}`") for c in columns])


def forget() -> None:
    """Let the next reports build their tables anew."""
    _TABLES.clear()


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_ledger(spark, sf_dir)


def arrived_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw ledger with the place of each row in its source."""
    return stored(spark, sf_dir, "arrived", lambda: order_ledger(spark, sf_dir, "arrival"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "ledger", lambda: clean(raw_ledger(spark, sf_dir), CONFIG.baseline_start, CONFIG.end))


def cycles(spark: SparkSession) -> DataFrame:
    return calendar(spark, CONFIG)


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        sales = ledger(spark, sf_dir)
        require_coverage(sales, CONFIG)
        return panel(sales, cycles(spark))

    return stored(spark, sf_dir, "panel", build)


def centres_at(cycle: Column) -> Column:
    return F.transform(
        centre_array(CENTRES), lambda c: F.array(F.get(c, F.lit(0)) + cycle * DRIFT, F.get(c, F.lit(1)), F.get(c, F.lit(2)))
    )


def literal(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def assigned(rows: DataFrame, prefix: str = "", back: int = 0) -> DataFrame:
    """Memberships, index, id and name of each panel row; the baseline cycle is crisp.

    With a prefix, of the panel columns so named, which are those of ``back`` cycles before.
    """
    n = F.col("cycle_number") - back if back else F.col("cycle_number")
    p = lambda c: f"{prefix}{c}"
    return (
        rows.withColumn(p("point"), F.array(*map(p, ("log_r", "log_f", "log_m"))))
        .withColumn(p("d2"), squared_distances(F.col(p("point")), centres_at(n)))
        .withColumn(p("cluster_index"), first_min(F.col(p("d2"))))
        .withColumn(p("fuzzy"), memberships(F.col(p("d2"))))
        .withColumn(
            p("u"),
            F.when(n == 0, F.transform(p("d2"), lambda d, i: (i == F.col(p("cluster_index"))).cast("double"))).otherwise(F.col(p("fuzzy"))),
        )
        .drop(p("fuzzy"))
        .withColumn(p("top_membership"), F.array_max(p("u")))
        .withColumn(p("stable_cluster_id"), F.get(literal(IDS), F.col(p("cluster_index"))))
        .withColumn(p("segment_name"), F.get(literal(NAMES), F.col(p("cluster_index"))))
    )


#: What the assignment and the rules read of a panel row of the cycle before.
BEFORE = ("log_r", "log_f", "log_m", "frequency", "monetary", "recency", "activity_status")


def with_previous(panel_rows: DataFrame) -> DataFrame:
    """``behaviour.with_previous`` of the assigned rows; panels meet, and both sides are assigned behind the join.

    Memberships, distances and names are functions of a panel row, so they need not be shuffled.
    """
    before = panel_rows.select((F.col("cycle_number") + 1).alias("cycle_number"), "customer_id", *[F.col(c).alias(f"prev_{c}") for c in BEFORE], F.lit(True).alias("prev_known"))
    met = panel_rows.join(before, ["cycle_number", "customer_id"], "left")
    both = assigned(assigned(met), "prev_", 1)
    own = assigned(panel_rows).columns
    carried = [F.when(F.col("prev_known"), F.col(f"prev_{c}")).alias(f"prev_{c}") for c in behaviour.CARRIED]
    return both.select(*own, *carried)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned rows with the previous cycle beside them, transition and risk."""

    def build() -> DataFrame:
        paired = with_previous(rfm(spark, sf_dir))
        return behaviour.add_risk(paired).withColumn("transition_status", behaviour.transition())

    return stored(spark, sf_dir, "state", build)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's assigned rows."""
    return stored(spark, sf_dir, "segments", lambda: assigned(rfm(spark, sf_dir)))


def kinds(spark: SparkSession, sf_dir: str, *others: str | Column) -> DataFrame:
    """The distinct measures of each cycle, and other columns, assigned, with ``n``, the customers that have them.

    Customers are only counted, so their assigned rows need not be stored first.
    """
    return assigned(rfm(spark, sf_dir).groupBy("cycle_number", "log_r", "log_f", "log_m", *others).agg(F.count("*").alias("n")))


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "country_asof", lambda: country_asof(ledger(spark, sf_dir), cycles(spark)))


def country_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commercial features of every country and cycle."""
    return stored(
        spark, sf_dir, "country_features", lambda: markets.market_features(ledger(spark, sf_dir), cycles(spark), state(spark, sf_dir), asof(spark, sf_dir))
    )


def fitted(spark: SparkSession) -> DataFrame:
    """Every centre of every cycle with its id and name."""
    ids = F.posexplode(literal(IDS)).alias("cluster_index", "stable_cluster_id")
    return cycles(spark).select("cycle_number", ids).withColumn("segment_name", F.get(literal(NAMES), F.col("cluster_index")))


def reversed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, priced rows of all years with the returned units that meet earlier purchases."""
    raw = raw_ledger(spark, sf_dir).where("customer_id is not null and unit_price > 0")
    arrival = F.struct("invoice_date", "invoice_no", "stock_code", "quantity", "description", "country")
    return reversals.match_reversals(dedup_exact(raw).withColumn("arrival", arrival), "arrival")


def fitted_run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of the cycle loop over the panel, fitted once per application."""
    found: dict[str, DataFrame] = {}

    def build(name: str) -> DataFrame:
        if not found:
            found.update(run_cycles(rfm(spark, sf_dir)).tables())
        return found[name]

    run = {n: stored(spark, sf_dir, f"fit_{n}", lambda n=n: build(n)) for n in ("assignments", *RUN_TABLES)}
    # Digests read the stored rows, whose memberships are not computed again.
    return run | {"registry": stored(spark, sf_dir, "fit_registry", lambda: registry.digested(run["assignments"], run["centres"]))}
