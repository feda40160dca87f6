import random
from datetime import datetime

from codeloom.plans.snapshots import issue_changes
from tests.conftest import rows

SCHEMA = "row_id bigint, project_root string, snapshot_no int, ingested_at timestamp, file string, category string, line_number int, severity string, confidence string, description string, _k1 string, change_kind string"


def _brute(data):
    def norm(r):
        file = r[4].replace("\\", "/") if r[4] is not None else None
        while file and file.startswith("./"):
            file = file[2:]
        sev = r[7] if r[7] in ("CRITICAL", "HIGH", "MEDIUM", "LOW") else "MEDIUM"
        con = (r[8] or "").lower()
        return (file, r[5].strip() if r[5] is not None else None, r[6] or 0), (sev, con if con in ("low", "medium", "high") else "medium", r[9])

    best, snaps = {}, {}
    for r in data:
        if r[2] is None:
            continue
        k, v = norm(r)
        snaps.setdefault(r[1], set()).add(r[2])
        version = (r[3] or datetime.min, -(2**63) if r[0] is None else r[0])
        at = (r[1], r[2], k)
        if at not in best or version > best[at][0]:
            best[at] = (version, v)
    out = set()
    for p, ns in snaps.items():
        ns = sorted(ns)
        for a, b in zip(ns, ns[1:], strict=False):
            old = {k: v for (q, n, k), (_, v) in best.items() if q == p and n == a}
            new = {k: v for (q, n, k), (_, v) in best.items() if q == p and n == b}
            for k in old.keys() | new.keys():
                kind = "added" if k not in old else "removed" if k not in new else "changed" if old[k] != new[k] else None
                if kind:
                    out.add((p, b, *k, kind))
    return out


def _data(n, seed):
    r = random.Random(seed)
    files = ["a.py", "./a.py", "b\\c.py", "b/c.py", None, ""]
    return [
        (i, r.choice(["p", "p", "p", "q", None]), r.choice([1, 2, 4, 7, None]), datetime(2024, 1, r.randint(1, 5)) if r.random() > 0.1 else None, r.choice(files), r.choice(["X", " X ", "Y", None]), r.choice([None, 0, 1, 2]), r.choice(["HIGH", "LOW", "BLOCKER", None]), r.choice(["high", "HIGH", "certain", None]), r.choice(["d", "e", None]), "clash", "clash")
        for i in range(n)
    ]


def test_against_brute_force(spark):
    for seed in range(3):
        data = _data(400, seed)
        got = issue_changes(spark.createDataFrame(data, SCHEMA))
        assert got.columns == ["project_root", "snapshot_no", "file", "category", "line_number", "change_kind"]
        assert {tuple(r) for r in got.collect()} == _brute(data)
        assert got.count() == len(_brute(data))


def test_empty_and_single_snapshot(spark):
    assert issue_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [r[:2] + (3,) + r[3:] for r in _data(30, 9)]
    assert issue_changes(spark.createDataFrame(one, SCHEMA)).count() == 0


def test_ties_and_repeated_rows(spark):
    base = (1, "p", 1, datetime(2024, 1, 1), "f", "C", 1, "HIGH", "high", "d", "", "")
    data = [base, base, (2, "p", 1, datetime(2024, 1, 1), "f", "C", 1, "LOW", "high", "d", "", ""), (3, "p", 2, datetime(2023, 1, 1), "f", "C", 1, "LOW", "high", "d", "", "")]
    assert rows(issue_changes(spark.createDataFrame(data, SCHEMA))) == []


def test_split_groups_and_a_full_bitmap(spark):
    from pyspark.sql import functions as F

    from codeloom.operators.snapshot_diff import snapshot_changes

    data = _data(600, 5)
    df = spark.createDataFrame(data, SCHEMA).select("row_id", "project_root", "snapshot_no", "ingested_at", F.col("file").alias("f"), "severity")
    args = dict(group={"project_root": F.col("project_root")}, snapshot="snapshot_no", key={"file": F.col("f")}, compare=[F.col("severity")], version=(F.unix_micros("ingested_at"), F.col("row_id")))
    whole = rows(snapshot_changes(df, **args))
    assert whole and rows(snapshot_changes(df, **args, bucket_rows=7, most_words=1)) == whole
