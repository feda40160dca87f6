"""What changed between consecutive full snapshots of a table.

A row is reduced to a 128-bit key hash, a 64-bit hash of the compared values and its
version (about 60 bytes). These compact rows are spread over hash buckets whose number
follows from the number of rows. A group lies in one bucket, so the bucket's rows say which
snapshots the group has; a group of more rows than a bucket should hold is split by key,
and only its parts are told the group's snapshots. Each bucket is sorted in numpy and
consecutive snapshots are compared by ``searchsorted``; only differing keys leave it. Full
values are retrieved for those: a bitmap of the differing keys, of bounded size, lets only
their rows (and a few more) be shuffled, and an exact join follows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import null_safe_hash
from codeloom.session import kept, shuffle_partitions

_OLDEST = -(2**63)
_KINDS = np.array(["added", "removed", "changed"], dtype=object)
_SCHEMA = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("_snap", pa.int64()), ("_first", pa.int64()), ("change_kind", pa.string())])


def _diff_bucket(t: pa.Table) -> pa.Table:
    """All compact rows and presence marks (rows without a key) of one bucket -> its differing keys."""
    marked = np.stack([t.column(n).to_numpy() for n in ("_g", "_snap")], axis=1)
    marks = np.unique(marked, axis=0)  # which snapshots each group has
    t = t.filter(t.column("_k1").is_valid())
    if not t.num_rows:
        return _SCHEMA.empty_table()
    g, k1, k2, snap, h, v1, v2 = (t.column(n).to_numpy() for n in ("_g", "_k1", "_k2", "_snap", "_h", "_v1", "_v2"))

    order = np.lexsort((v2, v1, snap, k2, k1))
    g, k1, k2, snap, h = (a[order] for a in (g, k1, k2, snap, h))
    new_key = np.ones(len(k1), dtype=bool)
    new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    last = np.ones(len(k1), dtype=bool)  # the greatest version of a key in a snapshot
    last[:-1] = new_key[1:] | (snap[1:] != snap[:-1])
    key_no = np.cumsum(new_key) - 1
    g, k1, k2, snap, h, key_no = (a[last] for a in (g, k1, k2, snap, h, key_no))

    # Ordinal of a snapshot among those of its group, by binary search in the marks.
    groups, first = np.unique(marks[:, 0], return_index=True)
    size = np.diff(np.append(first, len(marks)))
    ordinal_of_mark = np.arange(len(marks)) - np.repeat(first, size)
    gi = np.searchsorted(groups, g)
    snaps = np.unique(marks[:, 1])
    width = len(snaps)
    mark_code = np.searchsorted(groups, marks[:, 0]) * width + np.searchsorted(snaps, marks[:, 1])
    at = np.searchsorted(mark_code, gi * width + np.searchsorted(snaps, snap))
    ordinal, count = ordinal_of_mark[at], size[gi]

    # (key, ordinal) codes ascend, so the neighbour snapshot of a key is one search away.
    code = key_no * np.int64(width + 1) + ordinal
    nxt = np.minimum(np.searchsorted(code, code + 1), len(code) - 1)
    has_next = code[nxt] == code + 1
    prv = np.minimum(np.searchsorted(code, code - 1), len(code) - 1)
    has_prev = (code[prv] == code - 1) & (ordinal > 0)

    added = np.flatnonzero(~has_prev & (ordinal > 0))
    changed = np.flatnonzero(has_prev & (h != h[prv]))
    removed = np.flatnonzero(~has_next & (ordinal < count - 1))
    pick = np.concatenate([added, removed, changed])
    kind = np.repeat([0, 1, 2], [len(added), len(removed), len(changed)])
    out_snap = snap[pick].copy()
    gone = kind == 1
    out_snap[gone] = marks[at[pick[gone]] + 1, 1]  # the snapshot that lacks the key
    first_snap = snap[np.searchsorted(key_no, key_no[pick])]  # a row of the key to take its values from
    return pa.table([k1[pick], k2[pick], out_snap, first_snap, pa.array(_KINDS[kind], pa.string())], schema=_SCHEMA)


def _bit(k: Column, words: int) -> tuple[Column, Column]:
    """(word, place in the word) of a key's bit in a bitmap of ``words`` 64-bit words, a power of two."""
    at = k.bitwiseAND(F.lit(64 * words - 1))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def snapshot_changes(
    df: DataFrame,
    group: dict[str, Column],
    snapshot: str,
    key: dict[str, Column],
    compare: Sequence[Column],
    version: tuple[Column, Column],
    bucket_rows: int = 1_000_000,
    most_words: int = 1 << 20,
) -> DataFrame:
    """Rows ``(*group, snapshot, *key, change_kind)`` for every key that differs between a
    snapshot and the one before it among the snapshots present for its group.

    ``group``, ``key``: output name -> normalised value; nulls are ordinary values there.
    ``compare``: values whose difference makes a key ``changed``; null equals only null.
    ``version``: two integer columns; of several rows of a key in one snapshot the greatest
    pair counts, null being the least; rows equal in both are told apart by their values' hash.
    ``bucket_rows``: rows a bucket should hold at most, about 60 bytes each. ``most_words``:
    the bitmap that is broadcast has at most so many words (16 bytes a word); with more
    differing keys than bits it lets more rows through, and the result stays the same.

    Rows whose snapshot number is null belong to no snapshot. A group with one snapshot and
    an empty table give no rows. Other columns of ``df`` are never read.
    """
    spark = df.sparkSession
    gcols, kcols = list(group.values()), list(key.values())
    snap_type = df.schema[snapshot].dataType
    base = df.where(F.col(snapshot).isNotNull())
    long = lambda c: F.coalesce(c.cast("bigint"), F.lit(_OLDEST))

    total = base.count()
    n = max(4 * shuffle_partitions(spark), -(-total // bucket_rows))
    share = max(1, -(-total // n))
    sizes = base.groupBy(null_safe_hash(0, gcols).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    # Groups beyond a bucket's share: less than n of them, whatever the data are.
    hot = F.broadcast(sizes.where(F.col("_n") > share).select("_g", F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    bucket = lambda part: F.pmod(F.xxhash64("_g", part), F.lit(n)).cast("int").alias("_b")

    one = F.coalesce("_parts", F.lit(1))
    rows = (
        base.select(
            null_safe_hash(0, gcols).alias("_g"),
            null_safe_hash(1, gcols + kcols).alias("_k1"),
            null_safe_hash(2, gcols + kcols).alias("_k2"),
            F.col(snapshot).cast("bigint").alias("_snap"),
            null_safe_hash(3, list(compare)).alias("_h"),
            long(version[0]).alias("_v1"),
            long(version[1]).alias("_v2"),
        )
        .join(hot, "_g", "left")
        .select(bucket(F.pmod("_k1", one).cast("int")), "_g", "_k1", "_k2", "_snap", "_h", "_v1", "_v2")
    )
    none = F.lit(None).cast("bigint")
    marks = (
        base.select(null_safe_hash(0, gcols).alias("_g"), F.col(snapshot).cast("bigint").alias("_snap"))
        .join(hot, "_g")
        .distinct()
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select(bucket(F.col("_part")), "_g", none.alias("_k1"), none.alias("_k2"), "_snap", none.alias("_h"), none.alias("_v1"), none.alias("_v2"))
    )
    tasks = max(shuffle_partitions(spark), -(-total // bucket_rows))
    diff = kept(rows.unionByName(marks).repartition(tasks, "_b").groupBy("_b").applyInArrow(_diff_bucket, "_k1 bigint, _k2 bigint, _snap bigint, _first bigint, change_kind string"))

    # Full values of the differing keys, from the rows of one snapshot each. All rows of a key have the same group and key values.
    found = diff.count()
    words = min(most_words, 1 << max(0, (found // 8).bit_length()))  # 8 to 16 bits a key
    word, place = _bit(F.xxhash64("_k1", "_first"), words)
    bitmap = F.broadcast(diff.groupBy(word.alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("_bits")))
    named = {**group, **key}
    wanted = base.select(null_safe_hash(1, gcols + kcols).alias("_k1"), null_safe_hash(2, gcols + kcols).alias("_k2"), F.col(snapshot).cast("bigint").alias("_first"), *[c.alias(a) for a, c in named.items()])
    wanted = wanted.withColumn("_w", word).join(bitmap, "_w").where(F.call_function("shiftright", F.col("_bits"), place).bitwiseAND(F.lit(1)) == 1)
    values = wanted.groupBy("_k1", "_k2").agg(*[F.any_value(F.col(a)).alias(a) for a in named])
    return diff.join(values, ["_k1", "_k2"]).select(*group, F.col("_snap").cast(snap_type).alias(snapshot), *key, "change_kind")
