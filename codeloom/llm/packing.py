"""Documents into containers of fixed capacity.

Harmonic packing: with capacity C, a piece of size s in (C/(k+1), C/k] is of class k, and a
container of class k takes exactly k pieces of it, whatever they are. Documents are spread
over buckets by hash and every bucket is packed on its own. The pure scheme leaves up to
half of a container of class 1 empty, so with ``top_up`` the gap above the fixed count takes
the largest pieces of later classes that fit; only what is over after that opens a
container of its own class. ``fill_report`` over both shows what that gains. A document is split only if it exceeds the capacity, into full
containers and one rest.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bin_name string, bin_id string, capacity_tokens int, doc_id bigint, piece int, n_tokens bigint"


def pack(sizes: np.ndarray, capacity: int, top_up: bool = True) -> np.ndarray:
    """Container number of each piece; sizes are between 1 and ``capacity``."""
    if not top_up:  # k pieces of class k to a container, classes one after another
        kind = capacity // sizes
        order = np.argsort(kind, kind="stable")
        first = np.searchsorted(kind[order], kind[order])
        place = (np.arange(len(sizes)) - first) // kind[order]
        new = np.ones(len(sizes), bool)
        new[1:] = (kind[order][1:] != kind[order][:-1]) | (place[1:] != place[:-1])
        out = np.empty(len(sizes), np.int64)
        out[order] = np.cumsum(new) - 1
        return out
    order = np.argsort(-sizes, kind="stable")
    waiting: dict[int, list[int]] = {}
    mask = 0
    for i in order[::-1].tolist():
        waiting.setdefault(int(sizes[i]), []).append(i)
    for s in waiting:
        mask |= 1 << s
    out = np.full(len(sizes), -1, np.int64)
    number = 0
    while mask:
        largest = mask.bit_length() - 1
        k = capacity // largest  # the class of the largest piece left
        room = capacity
        taken = 0
        while taken < k and mask:  # the fixed count of its class
            s = mask.bit_length() - 1
            if capacity // s != k:
                break
            out[waiting[s].pop()] = number
            room -= s
            taken += 1
            if not waiting[s]:
                mask ^= 1 << s
        while room and (fit := mask & ((1 << (room + 1)) - 1)):  # top up
            s = fit.bit_length() - 1
            out[waiting[s].pop()] = number
            room -= s
            if not waiting[s]:
                mask ^= 1 << s
        number += 1
    return out


def _pack_group(key: tuple, t: pa.Table, top_up: bool = True) -> pa.Table:
    bin_name, bucket, capacity = (k.as_py() for k in key)
    order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
    ids, sizes = t.column("doc_id").to_numpy()[order], t.column("n_tokens").to_numpy()[order]
    full = (sizes - 1) // capacity  # full containers of a document that exceeds one
    rest = sizes - full * capacity
    bins = pack(rest, capacity, top_up)
    n = int(bins.max()) + 1 if len(bins) else 0
    piece = np.concatenate([full, np.concatenate([np.arange(f) for f in full[full > 0]]) if full.any() else np.zeros(0, np.int64)]).astype(np.int32)
    doc = np.concatenate([ids, np.repeat(ids, full)])
    tokens = np.concatenate([rest, np.full(int(full.sum()), capacity, np.int64)])
    where = np.concatenate([bins, n + np.arange(int(full.sum()))])
    m = len(doc)
    return pa.table(
        [pa.array([bin_name] * m, pa.string()), pa.array([f"{bucket}-{w}" for w in where.tolist()], pa.string()), pa.array(np.full(m, capacity, np.int32)), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(tokens, pa.int64())],
        names=["bin_name", "bin_id", "capacity_tokens", "doc_id", "piece", "n_tokens"],
    )


def packed(sizes: DataFrame, bins: DataFrame, bucket_docs: int = 25_000, top_up: bool = True) -> DataFrame:
    """``PACKED``: every piece of every document in a container, for each capacity in ``bins``.

    ``sizes`` has ``doc_id`` and ``n_tokens``; documents without tokens (null, empty texts)
    need no room and give no row. ``bins`` has ``bin_name`` and ``capacity_tokens``; rows
    whose capacity is null or below 1 are left out. Repeated document rows are packed each
    for itself. Pieces count from 0, the rest being the last. A bucket holds about
    ``bucket_docs`` documents, so no task grows with the corpus. Without ``top_up`` every
    container of a class but the last of its bucket holds the class's fixed count.
    """
    n = max(1, -(-sizes.count() // bucket_docs))
    # The capacities are crossed in by an array in each row, not by a join.
    wanted = [(r["bin_name"], r["capacity_tokens"]) for r in bins.where("capacity_tokens >= 1").select("bin_name", "capacity_tokens").distinct().orderBy("bin_name", "capacity_tokens").collect()]
    if not wanted:
        return sizes.sparkSession.createDataFrame([], PACKED)
    each = F.array(*[F.struct(F.lit(name).alias("bin_name"), F.lit(c).cast("int").alias("capacity_tokens")) for name, c in wanted])
    rows = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(n)).cast("int").alias("bucket"), F.explode(each).alias("_b")).select("doc_id", "n_tokens", "bucket", "_b.*")
    return rows.groupBy("bin_name", "bucket", "capacity_tokens").applyInArrow(lambda key, t: _pack_group(key, t, top_up), PACKED)


def fill_report(pieces: DataFrame) -> DataFrame:
    """Containers, pieces, split documents and the share of the room that is used, for each kind of container."""
    by_bin = pieces.groupBy("bin_name", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return by_bin.groupBy("bin_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("fill")
    )
