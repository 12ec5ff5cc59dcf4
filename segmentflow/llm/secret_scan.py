"""Secret scan with multipart credential linking, with DataFrame functions only.

Base spans stand alone: assignments with a value of 8+ characters, access identifiers, long hex runs.
Weak parts (identifiers, password-like values, 40-character keys, endpoints) are ordinary in prose, so
they are reported only where complementary parts co-occur: an interval join finds, for each weak part,
the parts at most ``reach`` code points before its start or after its end in the same scope (text
between blank lines).
A weak identifier needs a secret, a weak secret an identifier, an endpoint both.

Matches become rows (row key, kind, order, gap before, length); running sums turn gaps and lengths into
positions, and the interval join is two running frames over the parts of one scope.  Texts are never
shuffled: only the matches are, once, by row key, so a hot source or copied text does not meet in a task.

Defined results: a null or empty text has no spans; repeated rows give repeated results; texts of any
length are scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.llm.columns import column
from segmentflow.llm.graph import spread_join
from segmentflow.session import ensure_checkpoint_dir

# The base kinds (kind, pattern, group that is measured, least length).
BASE = (
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough
)
WEAK = (
    (
        "weak_id",
        r"""(?i)\b(?:user(?:name)?|login|client_id|account_id|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
        0,
        0,
    ),
    ("weak_secret", r"""(?i)\b(?:pass|pwd|key|auth|credential)["']?\x20*[:=]\x20*["']?([^\s"']{6,})""", 0, 0),
    ("weak_key", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 0),
    ("endpoint", r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", 0, 0),
)
BREAK = ("break", r"\n[\x20\t]*\n", 0, 0)
KINDS = [k[0] for k in BASE + WEAK]
IDS, SECRETS, ENDPOINTS = ["access", "weak_id"], ["assign", "hex", "weak_secret", "weak_key"], ["endpoint"]
SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def may_hold_secrets(text: Column) -> Column:
    """False only for texts without any base match or any weak part."""
    return (
        text.contains("=") | text.contains(":") | text.contains("AKIA") | text.rlike(r"[0-9a-f]{32}|[A-Za-z0-9+/]{40}")
    )


def _matches(text: Column, kind: tuple, when: Column) -> Column:
    """array<struct<kind, no, gap, length, measured>> of a pattern's matches, in order."""
    name, pattern, group, _ = kind
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(
        F.arrays_zip(found.alias("m"), measured.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g")),
        lambda x, i: F.struct(
            F.lit(name).alias("kind"),
            i.alias("no"),
            F.length(x["g"]).cast("long").alias("gap"),
            F.length(x["m"]).cast("long").alias("length"),
            F.length(x["v"]).cast("long").alias("measured"),
        ),
    )
    none = F.expr("array()").cast("array<struct<kind:string,no:int,gap:long,length:long,measured:long>>")
    return F.when(when, rows).otherwise(none)


def scan(docs: DataFrame, carry: dict[str, Column], text_col: str = "text", reach: int = 400) -> DataFrame:
    """Per input row: the carried columns and ``found``, its spans by start, then kind."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    names = list(carry)
    base = docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.struct(*[c.alias(n) for n, c in carry.items()]).alias("carried"),
        text.alias("scanned"),
    )
    t = F.col("scanned")
    assigns = t.contains("=") | t.contains(":")
    when = {
        "assign": assigns,
        "access": t.contains("AKIA"),
        "hex": t.rlike("[0-9a-f]{32}"),
        "weak_id": assigns,
        "weak_secret": assigns,
        "weak_key": t.rlike("[A-Za-z0-9+/]{40}"),
        "endpoint": t.contains("://"),
        "break": may_hold_secrets(t) & t.contains("\n"),
    }
    rows = base.select(
        "row_key",
        "carried",
        F.explode_outer(F.concat(*[_matches(t, k, when[k[0]]) for k in (*BASE, *WEAK, BREAK)])).alias("m"),
    ).select("row_key", "carried", "m.*")
    # One exchange by row serves the running sums, the interval join and the grouping below.
    rows = rows.repartition("row_key")
    placed = Window.partitionBy("row_key", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(placed)).withColumn(
        "start", F.col("end") - F.col("length")
    )
    least = reduce(
        lambda c, k: c.when(F.col("kind") == k[0], F.col("measured") >= k[3]), BASE + WEAK, F.when(F.lit(False), F.lit(True))
    ).otherwise(F.lit(True))
    # A failing match stays as a row without kind, so that its document keeps a row.
    rows = rows.withColumn("kind", F.when(least, F.col("kind")))
    by_start = Window.partitionBy("row_key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(by_start))
    scope = Window.partitionBy("row_key", "scope")
    so_far = scope.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    onward = scope.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)

    def beside(kinds: list[str]) -> Column:
        part = F.col("kind").isin(kinds)
        before = F.col("start") - F.max(F.when(part, F.col("end"))).over(so_far)
        after = F.min(F.when(part, F.col("start"))).over(onward) - F.col("end")
        return F.coalesce(before <= reach, F.lit(False)) | F.coalesce(after <= reach, F.lit(False))

    rows = rows.withColumn("has_id", beside(IDS)).withColumn("has_secret", beside(SECRETS))
    reported = (
        F.when(F.col("kind").isin([k[0] for k in BASE]), True)
        .when(F.col("kind") == "weak_id", F.col("has_secret"))
        .when(F.col("kind").isin("weak_secret", "weak_key"), F.col("has_id"))
        .when(F.col("kind") == "endpoint", F.col("has_id") & F.col("has_secret"))
        .otherwise(False)
    )
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS, F.when(F.lit(False), 0))
    span = F.when(reported, F.struct("start", rank.cast("int").alias("rank"), "kind", "end"))
    return (
        rows.groupBy("row_key", "carried")
        .agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("found"))
        .select(*[F.col("carried")[n].alias(n) for n in names], "found")
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 400) -> DataFrame:
    """One row (id, found) per document; ``found`` lists spans (start, rank, kind, end) in code points."""
    return scan(docs, {id_col: column(id_col)}, text_col, reach)


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _merged(found: Column) -> Column:
    """Spans as disjoint (start, end), by start."""
    none = F.expr("array()").cast("array<struct<start:long,end:long>>")

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
        )
        added = F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)), joined).otherwise(added)

    return F.aggregate(found, none, step)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", reach: int = 400) -> DataFrame:
    """The documents with every reported span replaced; all other texts and columns stay.

    Texts without any part skip the join.  The rest meet their spans by the text's digest, so copies of
    a text share one small row of spans; a text of very many copies is split over tasks.  Columns travel
    as one struct, so their names cannot clash with those used here.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    some = F.coalesce(may_hold_secrets(column(text_col)), F.lit(False))
    clean = docs.where(~some)
    suspects = docs.where(some).select(
        F.struct(*map(column, docs.columns)).alias("doc"), column(text_col).alias("text"), F.sha2(column(text_col), 256).alias("digest")
    )
    spans = scan(suspects, {"digest": F.col("digest")}, "text", reach).groupBy("digest").agg(F.first("found").alias("found"))
    keyed = spread_join(suspects, spans.select("digest", _merged(F.col("found")).alias("cuts")), "digest")
    text = F.col("text")

    def until(i: Column) -> Column:
        """The end of the span before the i-th."""
        return F.coalesce(F.try_element_at("cuts", F.when(i > 0, i))["end"], F.lit(0))

    pieces = F.transform(
        "cuts", lambda s, i: F.concat(F.substring(text, (until(i) + 1).cast("int"), (s["start"] - until(i)).cast("int")), F.lit(mark))
    )
    rest = F.substring(text, (F.get("cuts", F.size("cuts") - 1)["end"] + 1).cast("int"), F.length(text))
    new = F.when(F.size("cuts") == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    kept = [F.col("new").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns]
    return clean.unionByName(keyed.withColumn("new", new).select(*kept))
