"""Tables that change together, the SQLite source, and costs of comparisons."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import costs
from palimpsest.sources import sinks, sqlite, versions
from palimpsest.streaming import ingest


def rows(spark, owners, n):
    return {
        "files": spark.createDataFrame([(p, n) for p in owners], "path string, n int"),
        "kinds": spark.createDataFrame([(p, f"k{i}", n) for p in owners for i in range(n)], "path string, kind string, n int"),
    }


def held(t):
    return tuple(sorted(tuple(r) for r in t.read(x).collect()) for x in ("files", "kinds"))


def want(state):
    return sorted((p, n) for p, n in state.items()), sorted((p, f"k{i}", n) for p, n in state.items() for i in range(n))


def test_batches_switch_all_tables(spark, tmp_path):
    t = versions.Tables(spark, str(tmp_path / "t"), ["files", "kinds"], "path")
    assert t.read("files") is None and t.size() == 0
    assert t.commit("s", 0, rows(spark, "ab", 3)) and held(t) == want({"a": 3, "b": 3})
    assert t.commit("s", 1, rows(spark, "bc", 1)) and held(t) == want({"a": 3, "b": 1, "c": 1})  # b loses two kinds
    assert not t.commit("s", 1, rows(spark, "abc", 2)) and not t.commit("s", 0, rows(spark, "z", 2))  # played again
    assert held(t) == want({"a": 3, "b": 1, "c": 1})
    assert t.commit("other", 0, rows(spark, "d", 2)) and t.size() > 0
    before = t.read("kinds", t.manifest()["version"] - 1)
    t.merge()
    assert held(t) == want({"a": 3, "b": 1, "c": 1, "d": 2}) and [len(p) for p in t.manifest()["tables"].values()] == [1, 1]
    assert before.count() == 5  # what was begun with the version before the last can be read on
    assert not t.commit("s", 1, rows(spark, "x", 1))  # merging remembers what came


@pytest.mark.parametrize("broken", ["files", "kinds", "manifest"])
def test_a_break_between_the_tables_changes_nothing(spark, tmp_path, monkeypatch, broken):
    t = versions.Tables(spark, str(tmp_path / "t"), ["files", "kinds"], "path")
    t.commit("s", 0, rows(spark, "ab", 2))
    write, publish = versions.Tables._write, versions.Tables._publish

    def breaking_write(self, name, *rest):
        done = write(self, name, *rest)
        if name == broken:
            raise RuntimeError("killed")
        return done

    def breaking_publish(self, manifest):
        raise RuntimeError("killed")

    monkeypatch.setattr(versions.Tables, "_write", breaking_write)
    if broken == "manifest":
        monkeypatch.setattr(versions.Tables, "_publish", breaking_publish)
    with pytest.raises(RuntimeError, match="killed"):
        t.commit("s", 1, rows(spark, "bc", 1))
    monkeypatch.setattr(versions.Tables, "_write", write)
    monkeypatch.setattr(versions.Tables, "_publish", publish)
    assert held(t) == want({"a": 2, "b": 2})
    assert t.commit("s", 1, rows(spark, "bc", 1)) and not t.commit("s", 1, rows(spark, "bc", 1))
    assert held(t) == want({"a": 2, "b": 1, "c": 1})
    t.vacuum()
    named = {p["part"] for v in t._versions() for parts in t._manifest(v)["tables"].values() for p in parts}
    assert {f"{n}/{p.name}" for n in ("files", "kinds") for p in (tmp_path / "t" / n).iterdir() if not p.name.startswith(".")} == named


def test_many_batches_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MERGED", 2)
    t = versions.Tables(spark, str(tmp_path / "t"), ["files", "kinds"], "path")
    state = {}
    for k in range(4):
        t.commit("s", k, rows(spark, "ab"[k % 2], k + 1))
        state["ab"[k % 2]] = k + 1
    assert held(t) == want(state) and max(map(len, t.manifest()["tables"].values())) <= 3 and len(t._versions()) <= 4


def test_streamed_tables(spark, tmp_path, monkeypatch):
    src, target, checkpoint = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.py").write_text("x = 1\ndef g():\n    pass\n")
    (src / "b.py").write_text("y = 2\n")
    go = lambda **more: ingest.ended(ingest.ingest_tables(spark, str(src), target, checkpoint, files_per_batch=1, **more))
    assert not go(most_bytes=0)  # full before anything is in: nothing is marked as read
    assert ingest.tables(spark, target).read("files") is None
    commit, calls = versions.Tables.commit, []

    def dies_after(self, *args):
        done = commit(self, *args)
        calls.append(args[1])
        if len(calls) == 1:
            raise RuntimeError("killed after the manifest, before the stream's own mark")
        return done

    monkeypatch.setattr(versions.Tables, "commit", dies_after)
    with pytest.raises(Exception, match="killed"):
        go()
    assert go()  # the same batch comes again and is left out
    assert calls[:2] == [0, 0] and len(calls) == 3
    monkeypatch.setattr(versions.Tables, "commit", commit)
    t = ingest.tables(spark, target)
    files = {r.path.rpartition("/")[2]: r for r in t.read("files").collect()}
    assert set(files) == {"a.py", "b.py"} and t.read("files").count() == 2
    kinds = t.read("node_kind_counts")
    assert kinds.where("kind = 'FunctionDef'").count() == 1
    assert kinds.agg(F.sum("n")).first()[0] == sum(f.ast_nodes for f in files.values()) == t.read("node_kind_subtree_size_histogram").agg(F.sum("n")).first()[0]
    (src / "c.py").write_text("z = 3\n")
    assert not go(most_bytes=1) and t.read("files").count() == 2  # full: the new file waits
    assert go(most_bytes=10**9) and t.read("files").count() == 3


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "files.db")
    db = sqlite3.connect(path)
    db.execute('create table files (id INTEGER PRIMARY KEY, path TEXT, bytes INTEGER, share REAL, raw BLOB, "odd name" TEXT)')
    db.executemany("insert into files values (?, ?, ?, ?, ?, ?)", [(i * 3, f"p{i}" if i % 7 else None, i * i, i / 3, bytes([i % 256]), "x") for i in range(500)])
    db.execute("create table none (a INTEGER)")
    db.commit()
    yield path, db
    db.close()


def test_sqlite_tables_are_read_in_ranges_with_filters(spark, database):
    path, db = database
    df = sqlite.read(spark, path, "files", partitions=5)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "bigint", "double", "binary", "string"]
    assert sorted(tuple(r) for r in df.collect()) == sorted((a, b, c, d, bytearray(e), f) for a, b, c, d, e, f in db.execute("select * from files"))
    assert df.rdd.getNumPartitions() == 5
    some = sqlite.read(spark, path, "files", ["id", "path", "bytes"], 5).where("bytes >= 100 and bytes < 40000 and path is not null and id in (33, 36, 42, 600) and path like 'p1%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in some.collect()) == db.execute("select id, path, bytes from files where bytes >= 100 and bytes < 40000 and id in (33, 36, 42, 600) and path like 'p1%' order by 1").fetchall()
    assert "share" not in plan and "Filter (" not in plan.replace("PushedFilters", ""), plan  # nothing is left for Spark to filter
    kept = sqlite.read(spark, path, "files", ["id", "share"]).where("share > 100")
    assert kept.count() == db.execute("select count(*) from files where share > 100").fetchone()[0]
    assert sqlite.read(spark, path, "none").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.read(spark, path, "absent")


def test_pushed_filters_reach_the_database(database):
    path, _ = database
    from pyspark.sql.datasource import EqualTo, IsNull, LessThan, Not

    reader = sqlite.SqliteReader(sqlite.columns(path, "files"), path, "files", 4)
    left = list(reader.pushFilters([EqualTo(("path",), "p5"), LessThan(("share",), 3.0), Not(IsNull(("path",)))]))
    assert reader.where == ['"path" = ?'] and len(left) == 2
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [15]


def test_sqlite_rows_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "out.db")
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "commit_id long, file string, x double")
    assert sqlite.written(df, path, "commits", ["commit_id"]) == 2
    sqlite.written(spark.createDataFrame([(2, "new", 1.0), (3, "c", 0.0)], df.schema), path, "commits", ["commit_id"])
    assert sorted(tuple(r) for r in sqlite.read(spark, path, "commits").collect()) == [(1, "a", 2.5), (2, "new", 1.0), (3, "c", 0.0)]


def test_costs_of_pairs(spark):
    pairs = [(i, f"a b c\nd {i}\n\nx", f"a b\nd {i + 1}", "Text") for i in range(6)] + [(10, "x", "y", "Nothing"), (11, None, "", "Text")]
    df = spark.createDataFrame(pairs, "pair_id long, before string, after string, language string")
    got = costs.costs(df, repeats=2).collect()
    assert len(got) == 3 * len(pairs)
    for r in got:
        assert r.status == ("no_tree" if r.pair_id == 10 and r.tool != "lines" else "ok")
        assert (r.ms is None) == (r.status != "ok") and (r.ms is None or len(r.ms) == 2 and min(r.ms) >= 0 and r.peak_bytes > 0)
    s = {r.tool: r for r in costs.summary(costs.costs(df, repeats=2)).collect()}
    assert (s["trees"].pairs, s["trees"].ok, s["trees"].timings) == (8, 7, 14) and s["trees"].median_ms >= s["parse"].median_ms and s["lines"].ok == 8
    big = spark.createDataFrame([(1, "a b c\n" * 3000, "a b\n" * 3000, "Text")], df.schema)
    small, large = (costs.costs(x, 1, ["parse"]).agg(F.max("peak_bytes")).first()[0] for x in (df, big))
    assert large > 20 * small


def test_costs_beside_mismatches(spark):
    measured = spark.createDataFrame([(1, "trees", "ok", [3.0, 1.0, 2.0]), (1, "lines", "ok", [1.0]), (2, "trees", "no_tree", None)], "pair_id long, tool string, status string, ms array<double>")
    wrong = spark.createDataFrame([(1, "trees", 8, 2), (2, "trees", 0, 0)], "pair_id long, tool string, entries long, mismatches long")
    got = {(r.pair_id, r.tool): (r.mismatches, r.agreement, r.median_ms) for r in costs.evaluated(measured, wrong).collect()}
    assert got == {(1, "trees"): (2, 75.0, 2.0), (1, "lines"): (None, None, 1.0), (2, "trees"): (0, 0.0, None)}


def test_pairs_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("n", "py", "x = 1\n", "x = 2\n", ("r", "c1")), ("n-2", "rs", None, "é\n", ("r", "c2"))], "target string, extension string, before string, after string, origin struct<repository:string,commit:string>").repartition(2)
    out = str(tmp_path / "pairs")
    assert sorted(tuple(r) for r in sinks.write_pairs(df, out).collect()) == [("n", "written"), ("n-2", "written")]
    assert (tmp_path / "pairs/n/before.py.test").read_text() == "x = 1\n" and (tmp_path / "pairs/n-2/after.rs.test").read_text() == "é\n" and (tmp_path / "pairs/n-2/before.rs.test").read_text() == ""
    assert (tmp_path / "pairs/n/source.json").read_text() == '{"repository":"r","commit":"c1"}'
    assert {r.status for r in sinks.write_pairs(df, f"file://{out}").collect()} == {"kept"}
    (tmp_path / "pairs/n/after.py.test").write_text("broken")
    assert sorted(tuple(r) for r in sinks.write_pairs(df, out).collect()) == [("n", "written"), ("n-2", "kept")]
    assert sorted(p.name for p in (tmp_path / "pairs/n").iterdir()) == ["after.py.test", "before.py.test", "source.json"]
