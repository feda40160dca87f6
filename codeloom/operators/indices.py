"""Scores of whole files and texts, and measures of audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import explode_lines

# Phrases of stock wording, and technical words.
STOCK = (
    r"\b(интересн(?:ый|ая|о|ые)|важн(?:ый|ая|о|ые)|замечательн(?:ый|ая|о|ые)|хорош(?:ий|ая|о|ие))\b",
    r"\b(следует\s+(?:отметить|рассмотреть|обратить\s+внимание)|рекомендуется|стоит\s+подумать)\b",
    r"\b(возможно,?\s+связано|вероятно,?\s+имеет|кажется,?\s+что)\b",
    r"\b(давайте\s+посмотрим|рассмотрим\s+глубже|это\s+интересный\s+вопрос)\b",
    r"\b(ваш\s+подход|ваше\s+решение|вы\s+абсолютно\s+правы)\b",
)
TECH = ("логическая ошибка", "условие", "null", "цикл", "асинхронность", "утечка", "sql", "api", "сериализация", "безопасность", "solid", "галлюцинация", "архитектура", "валидация", "eval", "xss", "инъекция")


def stereotype(df: DataFrame, key: str, text: str) -> DataFrame:
    """DF-22, F-09: ``key, phrase_ratio, entropy_ratio, tech_ratio, score`` of each text.

    The entropy is that of the sentence lengths in words, as a share of the greatest it could
    be. The score is logistic in 10, 5 and -3 times the three, from 2 on; it is 0 for a text
    without words or without a stock phrase. All in the JVM, without a shuffle.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))
    n = words(low)
    phrases = sum((F.regexp_count(low, F.lit("(?U)" + p)) for p in STOCK), F.lit(0))
    lengths = F.transform(F.filter(F.split(low, r"[.!?]+"), lambda s: s.rlike(r"(?U)\S")), words)
    kinds = F.array_distinct(lengths)
    part = lambda k: F.size(F.filter(lengths, lambda x: x == k)) / F.size(lengths)
    entropy = F.aggregate(kinds, F.lit(0.0), lambda a, k: a - part(k) * F.log2(part(k)))
    most = F.when(F.size(kinds) > 1, F.log2(F.size(kinds).cast("double"))).otherwise(F.lit(1.0))
    tech = sum((F.contains(low, F.lit(w)).cast("int") for w in TECH), F.lit(0))
    ratio = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    out = df.select(key, ratio(phrases).alias("phrase_ratio"), F.coalesce(entropy / most, F.lit(0.0)).alias("entropy_ratio"), ratio(tech).alias("tech_ratio"))
    raw = F.greatest(F.lit(0.0), 10 * F.col("phrase_ratio") + 5 * F.col("entropy_ratio") - 3 * F.col("tech_ratio"))
    return out.withColumn("score", F.when(F.col("phrase_ratio") > 0, 1 / (1 + F.exp(2 - raw))).otherwise(0.0))


def above(scores: DataFrame, value: str, limit: float, rule_id: str, severity: str = "LOW") -> DataFrame:
    """DF-18, 20, 21, 22: finding rows of the scores beyond a threshold, with all their columns."""
    return scores.where(F.col(value) > limit).withColumns({"rule_id": F.lit(rule_id), "severity": F.lit(severity)})


def fatigue(corpus: DataFrame, facts: DataFrame) -> DataFrame:
    """DF-20: ``payload_id, index``: weighted sum of six ratios of each Python file, against the corpus' comment density."""
    rows = explode_lines(corpus.where(F.col("path").endswith(".py")).select("payload_id", "content"))
    lines = rows.groupBy("payload_id").agg(F.avg(F.col("line").rlike(r"^\s*#").cast("double")).alias("density"), (F.least(F.count_if(F.col("line").rlike(r"\b(TODO|FIXME)\b")), F.lit(10)) / 10).alias("markers"), F.avg(F.col("line").rlike(r"(?<![\w.])\d{2,}(?![\w.])").cast("double")).alias("numbers"), F.avg((F.length("line") > 120).cast("double")).alias("long"))
    names = facts.where("kind IN ('function','assign')").groupBy("payload_id").agg(F.avg((F.length("raw") <= 2).cast("double")).alias("short"))
    tries = facts.where("kind IN ('call','except')").groupBy("payload_id").agg((F.count_if(F.col("kind") == "except") / F.greatest(F.count_if(F.col("kind") == "call"), F.lit(1))).alias("tries"))
    mean = lines.agg(F.avg("density").alias("_mean"))  # one row
    j = lines.join(names, "payload_id", "left").join(tries, "payload_id", "left").crossJoin(F.broadcast(mean)).na.fill(0.0)
    gap = F.greatest(F.lit(0.0), (F.col("_mean") - F.col("density")) / F.greatest(F.col("_mean"), F.lit(1e-9)))
    index = 0.2 * gap + 0.2 * F.col("markers") + 0.2 * F.col("numbers") + 0.15 * F.col("short") + 0.15 * F.least(F.col("tries"), F.lit(1.0)) + 0.1 * F.col("long")
    return j.select("payload_id", index.alias("index"))


def confusion(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """A-24, A-25, J-20: one row ``tp, fn, fp, recall, precision``; 1.0 where there is nothing to divide by."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    o = observed.select(*keys).distinct().withColumn("_o", F.lit(True))
    j = e.join(o, keys, "full")
    tp, fn, fp = F.count_if(F.col("_e") & F.col("_o")), F.count_if(F.col("_e") & F.col("_o").isNull()), F.count_if(F.col("_o") & F.col("_e").isNull())
    return j.agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0)).alias("recall"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)).alias("precision"))


def branch_coverage(df: DataFrame) -> DataFrame:
    """A-28, T-06: ``file, missing, percent``: two digits, null without branches; most missing lines first when ordered so."""
    return df.select("file", "missing", F.bround(100 * F.try_divide("covered_branches", "branches"), 2).alias("percent"))


def mutation_score(df: DataFrame) -> DataFrame:
    """A-27: share of executed mutations that were killed, in percent; null if none was executed."""
    done = F.col("status").isin("killed", "survived")
    return df.agg((100 * F.try_divide(F.count_if(F.col("status") == "killed"), F.count_if(done))).alias("score"))


def probe_verdicts(df: DataFrame) -> DataFrame:
    """P-23: ``name, passed`` of probe results against expectations: raises, equals, contains, type, truthy, exit code."""
    c = F.col
    ok = (
        F.when(c("expect_raises").isNotNull(), F.coalesce(c("raised") == c("expect_raises"), F.lit(False)))
        .when(c("raised").isNotNull(), F.lit(False))
        .when(c("expect_exit").isNotNull(), c("exit_code").eqNullSafe(c("expect_exit")) & F.coalesce(F.contains("stdout", c("expect_contains")), c("expect_contains").isNull()))
        .when(c("expect_equals").isNotNull(), c("value").eqNullSafe(c("expect_equals")))
        .when(c("expect_contains").isNotNull(), F.coalesce(F.contains("value", c("expect_contains")), F.lit(False)))
        .when(c("expect_type").isNotNull(), c("value_type").eqNullSafe(c("expect_type")))
        .otherwise(F.coalesce(~c("value").isin("", "0", "False", "None", "null"), F.lit(False)))
    )
    return df.select("name", ok.alias("passed"))
