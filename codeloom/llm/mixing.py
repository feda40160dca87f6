"""Sources mixed to target shares of all tokens.

Sainte-Laguë apportionment: blocks of equal size go one after another to the source with
the highest quotient share / (2 * blocks so far + 1) that can still supply a block, which
gives every source an integer quota. A source's quota is apportioned to groups of its shards
and to the shards of each group by their sizes in the same way. A shard's documents, in a
seeded order, are cut into blocks of equal tokens; the shard is used as often as its quota
holds all its blocks, and its first blocks once more for what is left. A document belongs to
the block in which its middle lies, so long and short ones are drawn alike.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLAN = "mix_name string, source string, target_share double, max_repeats int, blocks bigint, block_tokens bigint, shards int"


@dataclass(frozen=True)
class Target:
    mix_name: str
    source: str
    share: float
    max_repeats: int
    tokens: int


def sainte_lague(shares: list[float], limits: list[int], blocks: int) -> list[int]:
    """Blocks of each party; party i gets at most ``limits[i]``. Ties go to the earlier party."""
    got = [0] * len(shares)
    heap = [(-s, i) for i, s in enumerate(shares) if s > 0 and limits[i] > 0]
    heapq.heapify(heap)
    for _ in range(blocks):
        if not heap:
            break
        _, i = heap[0]
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heapreplace(heap, (-shares[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(heap)
    return got


def quotas(targets: list[Target], resolution: int = 20_000) -> tuple[list[int], int]:
    """(blocks of each target of one mix, tokens of a block).

    The mix is as large as its scarcest source allows at full repeats; sources without
    documents get nothing and the others share its part in proportion.
    """
    there = [t for t in targets if t.tokens > 0 and t.share > 0 and t.max_repeats > 0]
    if not there:
        return [0] * len(targets), 1
    whole = sum(t.share for t in there)
    total = min(t.tokens * t.max_repeats * whole / t.share for t in there)
    size = max(1, int(total // resolution))
    limits = [t.tokens * t.max_repeats // size if t in there else 0 for t in targets]
    return sainte_lague([t.share if t in there else 0.0 for t in targets], limits, int(total // size)), size


def divide(sizes: np.ndarray, quota: int) -> np.ndarray:
    """Sainte-Laguë for many parties at once: ``round(size / d)`` for the divisor d at which they add up to ``quota``."""
    weights = sizes.astype(np.float64)
    if quota <= 0 or weights.sum() <= 0:
        return np.zeros(len(sizes), np.int64)
    low, high = 0.0, 2.0 * quota + len(sizes) + 1
    unit = weights / weights.sum()
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(unit * mid + 0.5).sum() <= quota:
            low = mid
        else:
            high = mid
    out = np.floor(unit * low + 0.5).astype(np.int64)
    short = quota - int(out.sum())
    if short > 0:  # ties at the divisor, in order
        quotient = unit / (2 * out + 1)
        for i in np.lexsort((np.arange(len(out)), -quotient))[:short]:
            out[i] += 1
    return out


def plan_mixes(totals: DataFrame, targets: DataFrame, shard_tokens: int = 2_000_000) -> list[tuple]:
    """Rows of ``PLAN``, on the driver: there is one for each row of ``targets``, a fixed small table."""
    rows = targets.join(totals, "source", "left").select("mix_name", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("mix_name", "source").collect()
    mixes: dict[str, list[Target]] = {}
    for r in rows:
        mixes.setdefault(r["mix_name"], []).append(Target(r["mix_name"], r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0), int(r["tokens"])))
    out = []
    for name, members in mixes.items():
        blocks, size = quotas(members)
        for t, b in zip(members, blocks, strict=True):
            out.append((name, t.source, t.share, t.max_repeats, b, size, max(1, -(-t.tokens // shard_tokens))))
    return out


def _share_out(pdf: pd.DataFrame, part: str) -> pd.DataFrame:
    """The ``blocks`` of a whole divided among its parts by their ``tokens``."""
    pdf = pdf.sort_values(part)
    tokens, size = pdf["tokens"].to_numpy(), int(pdf["block_tokens"].iloc[0])
    got = divide(tokens, int(pdf["blocks"].iloc[0]))
    # No part beyond its repeats: what it can't take goes to the parts with room, largest first.
    limit = tokens * pdf["max_repeats"].to_numpy() // size
    over = int(np.maximum(got - limit, 0).sum())
    got = np.minimum(got, limit)
    for i in np.argsort(-(limit - got), kind="stable"):
        if over <= 0:
            break
        more = min(over, int(limit[i] - got[i]))
        got[i] += more
        over -= more
    return pdf.assign(blocks=got)


def _draw(pdf: pd.DataFrame) -> pd.DataFrame:
    """Uses of each document of one shard: whole rounds, and once more those in the first blocks of the seeded order."""
    pdf = pdf.sort_values(["_order", "doc_id"], kind="stable")
    want = int(pdf["blocks"].iloc[0]) * int(pdf["block_tokens"].iloc[0])
    rounds, rest = divmod(want, int(pdf["shard_tokens"].iloc[0]))
    size = pdf["n_tokens"].to_numpy()
    middle = np.cumsum(size) - (size + 1) // 2
    times = np.minimum(rounds + (middle < rest), pdf["max_repeats"].to_numpy())
    return pd.DataFrame({"mix_name": pdf["mix_name"], "source": pdf["source"], "doc_id": pdf["doc_id"], "n_tokens": pdf["n_tokens"], "times": times.astype(np.int32)})


DRAWN = "mix_name, source, doc_id, n_tokens, times"


_DIVIDED = "mix_name string, source string, shard_group int, blocks bigint, block_tokens bigint, max_repeats int"


def drawn(sizes: DataFrame, targets: DataFrame, seed: int = 7, group: int = 4096) -> tuple[DataFrame, list[tuple]]:
    """``(DRAWN, plan)``: how often each document is used in each mix; documents that aren't used have no row.

    ``sizes``: ``doc_id, source, n_tokens`` with ``source`` trimmed and in lower case. It is
    read twice, so it should be a table. Documents with a null source or no tokens are never
    drawn. Repeated rows are drawn each for itself. No document is used more than
    ``max_repeats`` times. A shard holds about two million tokens whatever the size of the
    source, and a group ``group`` shards, so that no task divides more than the groups of a
    source or the shards of a group.
    """
    spark = sizes.sparkSession
    usable = sizes.where("n_tokens > 0 AND source IS NOT NULL")
    totals = usable.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = plan_mixes(totals, targets)
    p = spark.createDataFrame(plan, PLAN)
    docs = usable.join(p.where("blocks > 0"), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")).cast("int"))
    top = ["mix_name", "source"]
    fixed = ["blocks", "block_tokens", "max_repeats"]
    by_shard = docs.groupBy(*top, "shard", *fixed).agg(F.sum("n_tokens").alias("tokens")).withColumn("shard_group", F.floor(F.col("shard") / group).cast("int"))
    by_group = by_shard.groupBy(*top, "shard_group", *fixed).agg(F.sum("tokens").alias("tokens"))
    groups = by_group.groupBy(*top).applyInPandas(lambda pdf: _share_out(pdf, "shard_group")[[x.split()[0] for x in _DIVIDED.split(", ")]], _DIVIDED)
    columns = [*top, "shard", "tokens", "blocks", "block_tokens"]
    each = by_shard.drop(*fixed).join(groups, [*top, "shard_group"])
    shares = each.groupBy(*top, "shard_group").applyInPandas(lambda pdf: _share_out(pdf, "shard")[columns], "mix_name string, source string, shard int, tokens bigint, blocks bigint, block_tokens bigint").withColumnRenamed("tokens", "shard_tokens")
    used = (
        docs.select(*top, "shard", "doc_id", "n_tokens", "max_repeats", F.xxhash64("doc_id", F.lit(seed + 1), F.col("mix_name")).alias("_order"))
        .join(shares, [*top, "shard"])
        .groupBy(*top, "shard")
        .applyInPandas(_draw, "mix_name string, source string, doc_id bigint, n_tokens bigint, times int")
    )
    return used.where("times > 0").select(*DRAWN.split(", ")), plan


def share_report(used: DataFrame, plan: list[tuple]) -> DataFrame:
    """For every source of every mix: target and reached share, tokens, documents, and the most often a document is used."""
    p = used.sparkSession.createDataFrame(plan, PLAN).select("mix_name", "source", "target_share", "max_repeats")
    got = used.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("times").alias("most"))
    whole = Window.partitionBy("mix_name")
    return (
        p.join(got, ["mix_name", "source"], "left")
        .select("mix_name", "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most", F.lit(0)).alias("most_used"), "max_repeats")
        .withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(whole))
    )
