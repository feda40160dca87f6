import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.mixing import Target, divide, drawn, quotas, sainte_lague, share_report
from codeloom.llm.packing import fill_report, pack, packed
from codeloom.llm.tokens import count_tokens, encoder, sized
from tests.conftest import rows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_pack(sizes):
    s = np.array(sizes, np.int64)
    b = pack(s, 64)
    assert (b >= 0).all()
    used = np.bincount(b, weights=s) if len(s) else np.zeros(0)
    assert (used <= 64).all() and (used > 0).all()
    if len(s):
        assert len(used) <= 1.3 * s.sum() / 64 + 3 + (s > 32).sum()


def test_packed(spark):
    r = random.Random(3)
    docs = [(i, r.choice([r.randint(1, 900), 5000])) for i in range(2000)] + [(5000, 0), (5001, None), (7, 300)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint")
    bins = spark.createDataFrame([("s", 512), ("l", 2048), ("bad", None), ("zero", 0)], "bin_name string, capacity_tokens int")
    p = packed(sizes, bins, bucket_docs=300).cache()
    for name, cap in (("s", 512), ("l", 2048)):
        x = p.where(f"bin_name = '{name}'").toPandas()
        assert x.n_tokens.sum() == sum(n or 0 for _, n in docs)
        assert x.groupby("bin_id").n_tokens.sum().max() <= cap
        n_pieces = x.groupby("doc_id").size()
        for d, n in docs[:2000]:
            if d != 7:
                assert n_pieces[d] == -(-n // cap)
    fill = {f.bin_name: f.fill for f in fill_report(p).collect()}
    assert min(fill.values()) > 0.97
    assert packed(sizes.limit(0), bins).count() == 0 and packed(sizes, bins.limit(0)).count() == 0


def test_tokens(spark):
    enc = encoder()
    text = "Hello, naïve wörld!\n" * 30_000
    assert count_tokens(text, enc) == len(enc.encode_ordinary(text))
    df = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, n_tokens int")
    assert rows(sized(df, ["doc_id"])) == [(1, 2), (2, 0), (3, 0)]


def test_sainte_lague():
    assert sainte_lague([0.5, 0.3, 0.2], [99, 99, 99], 10) == [5, 3, 2]
    assert sainte_lague([0.9, 0.1], [2, 99], 10) == [2, 8]
    assert sainte_lague([], [], 5) == []
    for seed in range(20):
        r = np.random.default_rng(seed)
        w, q = r.integers(0, 50, 7), int(r.integers(0, 200))
        if w.sum():
            assert divide(w, q).tolist() == sainte_lague((w / w.sum()).tolist(), [10**9] * 7, q)


def test_quotas_and_missing_sources():
    t = [Target("m", "a", 0.5, 2, 1000), Target("m", "b", 0.4, 1, 10_000), Target("m", "none", 0.1, 3, 0)]
    blocks, size = quotas(t)
    assert blocks[2] == 0 and blocks[0] * size <= 2000 and abs(blocks[0] / blocks[1] - 5 / 4) < 0.01
    assert quotas([]) == ([], 1)


def test_drawn(spark):
    r = random.Random(5)
    docs = [(i, "a" if i % 10 else "b", r.randint(20, 900)) for i in range(3000)] + [(9001, None, 5), (9002, "a", 0)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.6, 1), ("m", "b", 0.3, 4), ("m", "c", 0.1, 2), ("n", "a", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    used, plan = drawn(sizes, targets)
    x = used.toPandas()
    assert set(x.doc_id) <= {d for d, s, n in docs if s and n}
    assert x[x.source == "b"].times.max() <= 4 and x[(x.mix_name == "m") & (x.source == "a")].times.max() <= 1
    share = {(r.mix_name, r.source): r.reached_share for r in share_report(used, plan).collect()}
    assert abs(share["m", "a"] - 2 / 3) < 0.01 and abs(share["m", "b"] - 1 / 3) < 0.01 and share["m", "c"] == 0 and share["n", "a"] == 1
    assert rows(drawn(sizes, targets)[0]) == rows(used)
    assert drawn(sizes.limit(0), targets)[0].count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_fixed_counts(sizes):
    s = np.array(sizes, np.int64)
    b = pack(s, 64, top_up=False)
    counts, kinds = np.bincount(b), {}
    for size, at in zip(sizes, b.tolist(), strict=True):
        kinds.setdefault(at, set()).add(64 // size)
    assert all(len(k) == 1 for k in kinds.values()) and (np.bincount(b, weights=s) <= 64).all()
    short = [k for at, k in kinds.items() if counts[at] != min(k)]
    assert len(short) == len({min(k) for k in short})  # at most the last container of each class


def test_shards_in_groups_and_documents_of_any_length(spark):
    from codeloom.llm import mixing as M

    r = random.Random(6)
    docs = [(i, "a" if i % 4 else "b", r.choice([10, 2000])) for i in range(4000)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "b", 0.7, 1)], "mix_name string, source string, target_share double, max_repeats int")
    plan_of = M.plan_mixes
    M.plan_mixes = lambda a, b: plan_of(a, b, shard_tokens=100_000)
    try:
        used, plan = drawn(sizes, targets, group=4)
        share = {x.source: x.reached_share for x in share_report(used, plan).collect()}
        a = used.where("source = 'a'").toPandas()
    finally:
        M.plan_mixes = plan_of
    assert plan[0][6] > 20 and abs(share["a"] - 0.3) < 0.01 and a.times.max() == 1
    assert 0.4 < (a.n_tokens == 2000).mean() < 0.6  # half of the documents are long


def test_whole_texts_are_counted():
    enc = encoder()
    text = "line\n\n" * 60_000
    assert count_tokens(text, enc) == len(enc.encode_ordinary(text))
