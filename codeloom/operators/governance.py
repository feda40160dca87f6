"""Findings: normalising, fingerprints, duplicates, suppressions, budgets and the baseline gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import confidence_name, fingerprint, severity_name

SUPPRESSION = "idx int, fingerprint string, rule_id string, file string, owner string, reason string, expires string"
_ORDER = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def severity_order(c: Column) -> Column:
    """LOW 1 to CRITICAL 4."""
    return F.when(c == "CRITICAL", 4).when(c == "HIGH", 3).when(c == "MEDIUM", 2).otherwise(1)


def normalised(issues: DataFrame) -> DataFrame:
    """Issues with severity and confidence in their fixed vocabularies and a ``fingerprint``; other columns stay."""
    return issues.withColumns({"severity": severity_name(F.col("severity")), "confidence": confidence_name(F.col("confidence"))}).withColumn(
        "fingerprint", fingerprint(*(F.col(c) for c in ("file", "category", "detector", "line_number", "location", "description")))
    )


def deduplicated(issues: DataFrame, order: list[Column], by: tuple[str, ...] = ("fingerprint",)) -> DataFrame:
    """The first row of each key in ``order``, with ``duplicates``, the number of the others.

    A combinable aggregation (``min_by``) rather than a window: copies are folded before
    the shuffle, so a key that a third of all rows share is no skew.
    """
    keep = [c for c in issues.columns if c not in by]
    return (
        issues.groupBy(*by)
        .agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*by, "_first.*", (F.col("_n") - 1).alias("duplicates"))
        .select(*issues.columns, "duplicates")
    )


def suppression_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Suppressions in list order; missing fields are null."""
    fields = [x.split()[0] for x in SUPPRESSION.split(", ")][1:]
    return spark.createDataFrame([(i, *[r.get(f) for f in fields]) for i, r in enumerate(rows)], SUPPRESSION)


def suppression_matches(issues: DataFrame, suppressions: DataFrame, key: str = "issue_id") -> DataFrame:
    """``key, idx`` of the first suppression in list order that matches each issue.

    A match needs the same file (or none named) and the same fingerprint or a category that
    starts with the rule id and a colon; rule ids may hold colons themselves, so each prefix
    before a colon is tried. The disjunction is two equi-joins, of which the first in list
    order is kept. Suppressions are few; Spark broadcasts them if they are.
    """
    parts = F.split("category", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    i = issues.select(key, "file", "fingerprint", F.when(F.contains("category", F.lit(":")), prefixes).alias("_rules"))
    s = suppressions.select("idx", F.col("fingerprint").alias("_fp"), F.col("rule_id").alias("_sr"), F.col("file").alias("_sf"))
    file = F.col("_sf").isNull() | (F.col("_sf") == "") | (F.col("_sf") == F.col("file"))
    one = i.join(s.where("_fp IS NOT NULL AND _fp <> ''"), (F.col("fingerprint") == F.col("_fp")) & file)
    two = i.select(key, "file", F.explode("_rules").alias("_rule")).join(s.where("_sr IS NOT NULL AND _sr <> ''"), (F.col("_rule") == F.col("_sr")) & file)
    return one.select(key, "idx").unionByName(two.select(key, "idx")).groupBy(key).agg(F.min("idx").alias("idx"))


_INLINE = 200  # suppressions up to which a list is one expression


def _tagged(issues: DataFrame, suppressions: DataFrame, key: str) -> DataFrame:
    """The issues with ``idx`` of the first suppression that matches, or null.

    A list of at most 200 suppressions, as people write them, is one expression over each
    row: nothing is shuffled. A longer one is joined; both give the same.
    """
    rows = suppressions.orderBy("idx").limit(_INLINE + 1).collect()
    if len(rows) > _INLINE:
        return issues.join(suppression_matches(issues, suppressions, key), key, "left")
    hit = F.lit(None).cast("int")
    for r in reversed(rows):
        any_of = [F.col("fingerprint") == r["fingerprint"]] if r["fingerprint"] else []
        any_of += [F.startswith("category", F.lit(r["rule_id"] + ":"))] if r["rule_id"] else []
        if not any_of:
            continue
        c = any_of[0] if len(any_of) == 1 else F.coalesce(any_of[0], F.lit(False)) | F.coalesce(any_of[1], F.lit(False))
        c = c & (F.col("file") == r["file"]) if r["file"] else c
        hit = F.when(c, F.lit(r["idx"])).otherwise(hit)
    return issues.withColumn("idx", hit)


def apply_suppressions(issues: DataFrame, suppressions: DataFrame, key: str = "issue_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues that stay, skipped issues with ``idx``, suppressions that matched nothing first).

    A suppression that is expired or invalid still suppresses; one that is always shadowed
    by an earlier one counts as unused.
    """
    tagged = _tagged(issues, suppressions, key)
    skipped = tagged.where("idx IS NOT NULL")
    unused = suppressions.join(skipped.select("idx").distinct(), "idx", "left_anti")
    return tagged.where("idx IS NULL").drop("idx"), skipped, unused


def suppression_errors(suppressions: DataFrame, today: Column | None = None) -> DataFrame:
    """``idx, error`` for suppressions without owner, reason or target, or with a bad or past end date."""
    today = F.current_date() if today is None else today
    blank = lambda c: F.col(c).isNull() | (F.btrim(F.col(c)) == "")
    until = F.col("expires").try_cast("date")
    errors = F.array_compact(
        F.array(
            F.when(blank("fingerprint") & blank("rule_id"), F.lit("target")),
            F.when(blank("owner"), F.lit("owner")),
            F.when(blank("reason"), F.lit("reason")),
            F.when(blank("expires"), F.lit("expires missing")).when(until.isNull(), F.lit("expires invalid")).when(until < today, F.lit("expired")),
        )
    )
    return suppressions.select("idx", F.explode(errors).alias("error"))


def severity_summary(issues: DataFrame, failed: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One row: counts of the four severities, zero where there are none, and totals."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    row = issues.agg(*[count(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], F.count(F.lit(1)).alias("TOTAL"))
    extra = {"FAILED_FILES": failed, "SKIPPED_FILES": skipped}
    for name, df in extra.items():
        row = row.withColumn(name, F.lit(0).cast("bigint")) if df is None else row.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row by one row
    return row


# Detectors whose HIGH findings are reviewed first.
FIRST_DETECTORS = ("python_dataflow", "python_cross_file_dataflow", "unknown_call_validator")


def review_queue(severity: Column, detector: Column) -> Column:
    """T-03: P0 for CRITICAL and for HIGH of three detectors, P1 for other HIGH, P2 for the rest."""
    first = (severity == "CRITICAL") | ((severity == "HIGH") & F.coalesce(detector.isin(*FIRST_DETECTORS), F.lit(False)))
    return F.when(first, "P0").when(severity == "HIGH", "P1").otherwise("P2")


def maturity(critical: Column, high: Column, medium: Column, total: Column, failed: Column, skipped: Column) -> Column:
    """A-21: 100 - (18 C + 8 H + 3 M + 20 F + 2 S), between 0 and 100; without findings and failures only skips count."""
    penalty = 18 * critical + 8 * high + 3 * medium + 20 * failed + 2 * skipped
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.when((total == 0) & (failed == 0), 2 * skipped).otherwise(penalty)))


@dataclass(frozen=True)
class Policy:
    """Most issues of each severity, and the least severity that may not be new."""

    most: dict[str, int] = field(default_factory=dict)
    fail_on_new: str | None = None


def budget_failures(issues: DataFrame, policy: Policy) -> DataFrame:
    """``severity, n, most`` of each severity beyond its budget."""
    spark = issues.sparkSession
    limits = spark.createDataFrame(list(policy.most.items()) or [("", 0)], "severity string, most int").where("severity <> ''")
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return limits.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), "most").where("n > most")


def new_issues(issues: DataFrame, baseline: DataFrame, least: str = "LOW", keys: tuple[str, ...] = ("fingerprint",)) -> DataFrame:
    """J-02: Issues of at least a severity whose ``keys`` the baseline lacks."""
    return issues.where(severity_order(F.col("severity")) >= _ORDER[least]).join(baseline.select(*keys).distinct(), list(keys), "left_anti")


def blocking(issues: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row ``blocking``: any CRITICAL or HIGH issue, or any failed file."""
    row = issues.agg(F.coalesce(F.bool_or(F.col("severity").isin("CRITICAL", "HIGH")), F.lit(False)).alias("blocking"))
    if failed is None:
        return row
    return row.crossJoin(failed.agg((F.count(F.lit(1)) > 0).alias("_f"))).select((F.col("blocking") | F.col("_f")).alias("blocking"))


@dataclass(frozen=True)
class Result:
    issues: DataFrame
    skipped: DataFrame
    gate_failures: DataFrame


def process(issues: DataFrame, suppressions: DataFrame, policy: Policy, baseline: DataFrame | None, order: list[Column], today: Column | None = None) -> Result:
    """The whole chain: normalise, fold duplicates, check and apply suppressions, budgets and the new-issue gate.

    Errors of suppressions, unused suppressions and failed gates come out as HIGH issues.
    """
    fields = ["file", "category", "severity", "detector", "description", "line_number", "location", "confidence"]
    kept = deduplicated(normalised(issues), order).withColumn("issue_id", F.col("fingerprint"))
    stay, skipped, unused = apply_suppressions(kept, suppressions)

    def made(df: DataFrame, detector: str, category: str, text: Column) -> DataFrame:
        return df.select(F.lit("suppressions").alias("file"), F.lit(category).alias("category"), F.lit("HIGH").alias("severity"), F.lit(detector).alias("detector"), text.alias("description"), F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("string").alias("location"), F.lit("high").alias("confidence"))

    errors = made(suppression_errors(suppressions, today), "governance", "Suppression governance", F.format_string("suppression %d: %s", "idx", "error"))
    idle = made(unused, "governance", "Suppression governance", F.format_string("suppression %d matches nothing", "idx"))
    whole = stay.select(*fields, "fingerprint").unionByName(normalised(errors.unionByName(idle)).select(*fields, "fingerprint"))
    over = budget_failures(whole, policy).select(F.format_string("%s: %d issues, %d allowed", "severity", "n", "most").alias("failure"))
    if policy.fail_on_new:
        known = baseline if baseline is not None else whole.select("fingerprint").limit(0)
        count = new_issues(whole, known, policy.fail_on_new).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        over = over.unionByName(count.select(F.format_string("%d new issues", "n").alias("failure")))
    gates = made(over, "governance", "Quality gate", F.col("failure"))
    return Result(whole.unionByName(normalised(gates).select(*fields, "fingerprint")), skipped, over)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key, for keys with bounded groups."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
