"""Changes between runs, orphan references, snapshot changes: nulls, ties, repeats, late rows, empty tables, clashing names."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomseek.operators.changes import MerkleStore, changed_between_runs
from loomseek.operators.lineage import nearest_ancestor
from loomseek.operators.orphans import RANGE, dictionary, orphan_references, orphan_report, pack, unpack
from loomseek.operators.snapshots import snapshot_changes

T0 = datetime(2025, 1, 1)
REPORTS = "repo string, version_id string, parent_version string, manifest_path string, read_until timestamp, state string"
FEED = "change_id bigint, repo string, family_id string, content_hash string, op string, changed_at timestamp, arrived_at timestamp, epoch int, leaf string"


def day(n):
    return T0 + timedelta(days=n)


def test_ancestors(spark):
    r = spark.createDataFrame(
        [("a", "1", None, "m"), ("a", "2", "1", None), ("a", "3", "2", None), ("a", "4", "3", "m"), ("a", "5", "gone", "m"), ("a", "x", "y", None), ("a", "y", "x", None), ("b", "4", "1", "m"), ("a", "4", "3", "m"), ("a", None, "1", "m")],
        "repo string, version_id string, parent_version string, manifest_path string",
    )
    got = rows(nearest_ancestor(r, F.col("manifest_path").isNotNull()), "repo", "version_id", "ancestor", "hops")
    assert ("a", "4", "1", 3) in got and ("a", "3", "1", 2) in got and ("b", "4", None, None) in got
    assert ("a", "5", None, None) in got and ("a", "x", None, None) in got and len(got) == 8


def _brute_changes(reports, feed):
    runs = {}
    for repo, v, p, m, until, _ in reports:
        runs[(repo, v)] = (p, m, until)
    out = set()
    for (repo, v), (p, m, until) in runs.items():
        if m is None or until is None:
            continue
        seen, anc = set(), p
        while anc is not None and (repo, anc) in runs and (runs[(repo, anc)][1] is None or runs[(repo, anc)][2] is None) and anc not in seen:
            seen.add(anc)
            anc = runs[(repo, anc)][0]
        ok = (repo, anc) in runs and runs[(repo, anc)][1] is not None and runs[(repo, anc)][2] is not None

        def state(t):
            best = {}
            for cid, rp, fam, h, op, ch, ar, _, _ in feed:
                if rp == repo and fam is not None and ar is not None and ar <= t:
                    k = (ch, cid)
                    if fam not in best or k > best[fam][0]:
                        best[fam] = (k, None if op == "delete" else h)
            return {f: s for f, (_, s) in best.items() if s is not None}

        now, then = state(until), state(runs[(repo, anc)][2]) if ok else {}
        out |= {(v, f) for f in set(now) | set(then) if now.get(f) != then.get(f)}
    return sorted(out)


def test_changes_match_brute_force(spark):
    rnd = random.Random(3)
    reports, feed = [], []
    for repo in ("r1", "r2"):
        versions = [f"{repo}v{i}" for i in range(12)]
        for i, v in enumerate(versions):
            parent = rnd.choice(versions[:i]) if i and rnd.random() < 0.9 else None
            reports.append((repo, v, parent, None if rnd.random() < 0.3 else "m", day(3 * i) if rnd.random() < 0.95 else None, "clash"))
        # one family holds a third of all rows
        for n in range(300):
            fam = "hot" if rnd.random() < 0.33 else f"f{rnd.randrange(20)}"
            op = "delete" if rnd.random() < 0.2 else "upsert"
            ch = day(rnd.randrange(36))
            feed.append((n, repo, fam, None if op == "delete" else f"h{rnd.randrange(3)}", op, ch, ch + timedelta(hours=rnd.randrange(200)), 1, "clash"))
    feed += [(*f[:6], f[6] + timedelta(days=2), *f[7:]) for f in feed[::7]] + feed[::11]
    feed += [(9999, "r1", None, "h", "upsert", day(1), day(1), 1, ""), (9998, "r1", "late", "h", "upsert", day(1), None, 1, ""), (9997, "nowhere", "f", "h", "upsert", day(1), day(1), 1, "")]
    got = changed_between_runs(spark.createDataFrame(feed, FEED), spark.createDataFrame(reports + reports[::3], REPORTS))
    assert rows(got, "version_id", "family_id") == _brute_changes(reports, feed)
    assert got.filter(F.col("before").eqNullSafe(F.col("after"))).count() == 0


def test_changes_of_nothing(spark):
    f, r = spark.createDataFrame([], FEED), spark.createDataFrame([], REPORTS)
    assert changed_between_runs(f, r).count() == 0
    assert changed_between_runs(f, spark.createDataFrame([("a", "1", None, "m", day(1), "")], REPORTS)).count() == 0


def test_merkle_store_survives_failures(spark, tmp_path):
    store = MerkleStore(spark, str(tmp_path / "s"), leaf_bits=8)
    a = spark.createDataFrame([(i, f"x{i}") for i in range(200)] + [(None, "n")], "k bigint, v string")
    store.run(a, "k", ["v"])
    assert store.output().count() == 200 and store.output().filter("change <> 'added'").count() == 0
    b = spark.createDataFrame([(i, f"x{i}" if i % 50 else f"y{i}") for i in range(1, 201)], "k bigint, v string")
    before = store.generation()

    def broken(_):
        raise RuntimeError("lost")

    try:
        store.run(b, "k", ["v"], broken)
    except RuntimeError:
        pass
    assert store.generation() == before  # nothing was published, nothing is skipped
    store.run(b, "k", ["v"])
    assert rows(store.output(), "key", "change") == sorted([("0", "removed"), ("50", "changed"), ("100", "changed"), ("150", "changed"), ("200", "added")], key=lambda t: (False, t[0], False, t[1]))
    store.run(b, "k", ["v"])
    assert store.output().count() == 0  # nothing is repeated
    assert not [p for p in (tmp_path / "s").glob("g-*") if p.name not in store.commits()]


def test_store_reads_and_deaths(spark, tmp_path, monkeypatch):
    """Rows that arrive between the readings of a run, and a death at each of its steps: nothing is lost, nothing repeated."""
    src, seen = tmp_path / "src", {}
    src.mkdir()

    def put(n, rows_):
        import pandas as pd

        pd.DataFrame(rows_, columns=["k", "v"]).to_parquet(src / f"{n:03d}.parquet")

    def source():
        # lists its files anew with every reading, as a live table does
        return spark.read.schema("k bigint, v string").parquet(str(src))

    class Live(MerkleStore):
        arrivals = 0

        def _changes(self, keyed, leaves, saved):
            Live.arrivals += 1
            put(100 + Live.arrivals, [(1000 + Live.arrivals, "late"), (1000 + Live.arrivals, "late")])
            return super()._changes(self._keyed(source(), "k", ["v"]), leaves, saved)

    store = Live(spark, str(tmp_path / "s"))
    put(0, [(i, f"a{i}") for i in range(60)] + [(7, "z"), (7, "b")])
    published = []

    def attempt(fail=None):
        if fail:
            with monkeypatch.context() as m:
                m.setattr(MerkleStore, fail, lambda *a, **k: (_ for _ in ()).throw(RuntimeError(fail)))
                with pytest.raises(RuntimeError):
                    store.run(source(), "k", ["v"])
            return
        store.run(source(), "k", ["v"])
        for r in store.output().collect():
            published.append((r["key"], r["change"]))
            seen[r["key"]] = None if r["change"] == "removed" else r["v"]

    attempt()
    for n, step in enumerate(["_save_tree", "publish", "_levels"]):
        put(n + 1, [(200 + n, "new")])
        attempt(step)
        attempt()
    monkeypatch.setattr(Live, "_changes", MerkleStore._changes)
    attempt()
    attempt()
    rows_of = {}
    for r in source().collect():
        rows_of.setdefault(str(r["k"]), set()).add(r["v"])
    assert set(seen) == set(rows_of) and all(seen[k] in v for k, v in rows_of.items())
    assert len(published) == len(set(published)) == len(rows_of)  # each key was added once
    tree = {r["key"]: r["digest"] for r in store.tree().collect()}
    import hashlib
    import json

    assert tree == {k: hashlib.sha256(json.dumps({"v": v}, separators=(",", ":")).encode()).hexdigest() for k, v in seen.items()}


def test_store_reads_only_open_ranges(spark, tmp_path, monkeypatch):
    store = MerkleStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(i, "x") for i in range(2000)], "k bigint, v string")
    store.run(df, "k", ["v"])
    asked = []
    real = MerkleStore._read_leaves
    monkeypatch.setattr(MerkleStore, "_read_leaves", lambda self, leaves, saved: (asked.append(len(leaves)), real(self, leaves, saved))[1])
    store.run(df.withColumn("v", F.when(F.col("k") == 5, "y").otherwise(F.col("v"))), "k", ["v"])
    assert set(asked) == {1} and rows(store.output(), "key", "change", "v") == [("5", "changed", "y")]
    store.run(df.filter("k < 0"), "k", ["v"])
    assert store.output().filter("change = 'removed'").count() == 2000 and store.tree().count() == 0


CALLS = "call_id bigint, callee_id bigint, repo string, loaded_at timestamp, code bigint"
IMPORTS = "import_id bigint, repo string, resolved_path string, loaded_at timestamp, path string"
EXPORTS = "export_id bigint, repo string, symbol_id bigint, loaded_at timestamp, period int"
SYMBOLS = "symbol_id bigint, loaded_at timestamp, deleted_at timestamp, space string"
FILES = "repo string, file_path string, loaded_at timestamp, deleted_at timestamp"


def test_orphans(spark):
    symbols = spark.createDataFrame([(1, day(0), None, "c"), (2, day(0), day(10), "c"), (2, day(20), None, "c"), (3, day(40), None, "c"), (1, day(0), None, "c"), (4, None, None, "c"), (-5, day(0), None, "c")], SYMBOLS)
    calls = spark.createDataFrame(
        [(1, 1, "r", day(5), 0), (2, 2, "r", day(9), 0), (3, 2, "r", day(10), 0), (4, 2, "r", day(20), 0), (5, 3, "r", day(39), 0), (6, 3, "r", day(40), 0), (7, 99, "r", day(1), 0), (8, None, "r", day(1), 0), (9, 1, "r", None, 0), (7, 99, "r", day(1), 0), (10, 4, "r", day(5), 0), (11, -5, "r", day(1), 0)], CALLS
    )
    files = spark.createDataFrame([("r", "src/a.js", day(0), None), ("r", "src/b.js", day(0), day(3)), ("q", "src/c.js", day(0), None), (None, "src/a.js", day(0), None), ("r", None, day(0), None)], FILES)
    imports = spark.createDataFrame(
        [(1, "r", "./src/x/../a.js", day(1), ""), (2, "r", "src\\a.js", day(1), ""), (3, "r", "src/b.js", day(3), ""), (4, "r", "src/c.js", day(1), ""), (5, "r", None, day(1), ""), (6, None, "src/a.js", day(1), ""), (7, "r", "../src/a.js", day(1), "")], IMPORTS
    )
    exports = spark.createDataFrame([(1, "r", 1, day(1), 0), (2, "r", 77, day(1), 0), (3, "r", None, day(1), 0)], EXPORTS)
    got = rows(orphan_references(calls, imports, exports, symbols, files), "ref_table", "ref_id")
    assert got == [("calls", 10), ("calls", 3), ("calls", 5), ("calls", 7), ("calls", 9), ("exports", 2), ("imports", 3), ("imports", 4), ("imports", 6), ("imports", 7)]
    report = orphan_report(calls, imports, exports, symbols, files)
    assert report.agg(F.sum("orphans")).first()[0] == 10 and report.agg(F.sum("refs")).first()[0] == 18
    empty = [spark.createDataFrame([], s) for s in (CALLS, IMPORTS, EXPORTS, SYMBOLS, FILES)]
    assert orphan_references(*empty).count() == 0
    assert orphan_references(calls, imports, exports, empty[3], empty[4]).count() == 10 + 6 + 2


def test_dictionary_is_dense_and_unique(spark):
    keys = spark.range(40000).select(F.lit("s").alias("space"), ((F.col("id") % 20000) * 987654321987).cast("string").alias("key"))
    d = dictionary(keys, 20000)
    places = d.select("range", "sub", "bit").distinct()
    assert d.count() == 40000 and places.count() == 20000 and d.select("key", "range", "sub", "bit").distinct().count() == 20000
    assert places.select("range", "sub").distinct().count() <= 3  # sparse ids share bitmaps


def test_packed_bitmaps():
    rnd = random.Random(2)
    for at in ([], [0], [RANGE - 1], range(RANGE), range(5, 9000), rnd.sample(range(RANGE), 500), rnd.sample(range(RANGE), 9000), [0, 1, 2, 9, 10, 11, 40]):
        bits = np.zeros(RANGE, np.uint8)
        bits[list(at)] = 1
        packed = pack(np.packbits(bits, bitorder="little"))
        assert (np.unpackbits(unpack(packed), bitorder="little") == bits).all() and len(packed) <= 1 + RANGE // 8
    assert len(packed) < 20


SNAPS = "repo string, version_id string, file_path string, file_hash string, chain string, at int"
VERSIONS = "repo string, version_id string, parent_version string"


def test_snapshots(spark):
    v = spark.createDataFrame([("r", "1", None), ("r", "2", "1"), ("r", "3", "2"), ("r", "4", "3"), ("r", "5", "1"), ("r", "2", "1")], VERSIONS)
    files = {
        "1": {"a": "A", "b": "B", "c": "C", "n": None},
        # version 2 has no snapshot
        "3": {"a": "a", "b": "B2", "d": "C", "n": None},
        "4": {"b": "B2", "d": "C", "e": "X", "f": "X", "n": "N"},
        "5": {"a": "A", "z": "B"},
    }
    snaps = [("r", k, p, h, "x", 1) for k, t in files.items() for p, h in t.items()]
    df = spark.createDataFrame(snaps + snaps[:4] + [("r", None, "q", "h", "", 0), ("r", "3", None, "h", "", 0)], SNAPS)
    got = rows(snapshot_changes(df, v), "version_id", "status", "file_path", "old_path")
    want = [
        ("3", "modified", "b", ""), ("3", "renamed", "d", "c"), ("4", "added", "e", ""), ("4", "added", "f", ""), ("4", "deleted", "a", ""), ("4", "modified", "n", ""),
        ("5", "deleted", "c", ""), ("5", "deleted", "n", ""), ("5", "renamed", "z", "b"),
    ]
    assert got == sorted(want)
    assert snapshot_changes(spark.createDataFrame([], SNAPS), v).count() == 0
    assert snapshot_changes(df, spark.createDataFrame([], VERSIONS)).count() == 0


def test_many_equal_files_pair_in_order(spark):
    v = spark.createDataFrame([("r", "1", None), ("r", "2", "1")], VERSIONS)
    snaps = [("r", "1", f"old{i:02}", "e", "", 0) for i in range(20)] + [("r", "2", f"new{i:02}", "E", "", 0) for i in range(17)]
    got = rows(snapshot_changes(spark.createDataFrame(snaps, SNAPS), v), "status", "file_path", "old_path")
    assert [g for g in got if g[0] == "renamed"] == [("renamed", f"new{i:02}", f"old{i:02}") for i in range(17)]
    assert [g[1] for g in got if g[0] == "deleted"] == ["old17", "old18", "old19"]


def test_spread_rank_and_median(spark):
    from loomseek.operators.spread import spread_median, spread_rank

    rnd = random.Random(8)
    data = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(9)}", float(rnd.randrange(20)), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, v double, i int").repartition(5)
    want = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))):
            want[d[2]] = n + 1
    got = spread_rank(df, ["g"], [F.desc("v"), F.col("i")]).collect()
    assert {r["i"]: r["rank"] for r in got} == want and all(r["rank_of"] == sum(d[0] == r["g"] for d in data) for r in got[:20])
    import statistics

    med = {r["g"]: r["median"] for r in spread_median(df, ["g"], "v", "i").collect()}
    assert med == {g: statistics.median(d[1] for d in data if d[0] == g) for g in med}
    assert spread_rank(df.limit(0), ["g"], [F.col("i")]).count() == 0
