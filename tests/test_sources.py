import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import files, git, sinks
from palimpsest.streaming import ingest


def test_scan(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "third_party").mkdir()
    (tmp_path / "src" / "main.rs").write_text("fn main() {}\n")
    (tmp_path / "src" / "deep" / "x.py").write_text("a = 1\n")
    (tmp_path / "third_party" / "v.rs").write_text("//")
    (tmp_path / "src" / "bad.c").write_bytes(b"\xff\xfe")
    got = {r.path.rpartition("/")[2]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"main.rs", "x.py", "bad.c"}
    assert got["main.rs"].language == "Rust" and got["x.py"].contents == "a = 1\n" and not got["bad.c"].valid and got["bad.c"].contents is None
    assert files.scan(spark, str(tmp_path), "*.py").count() == 1


def test_directory_pairs(spark, tmp_path):
    for name, sides in (("one", ("before.py.test", "after.py.test")), ("two", ("before.go",))):
        (tmp_path / name).mkdir()
        for s in sides:
            (tmp_path / name / s).write_text(s)
    rows = files.directory_pairs(spark, str(tmp_path)).collect()
    assert [(r.name, r.language, r.before) for r in rows] == [("one", "Python", "before.py.test")]


def test_tables_of_runs(spark, tmp_path):
    (tmp_path / "benchmark_go.csv").write_text("language,size_bucket,repository,commit,path,bytes_before,bytes_after,ast_nodes_before,ast_nodes_after,status,elapsed_ms,peak_memory_bytes,total_allocated_bytes,mapping_operations\nGo,small,r,c,p,1,2,3,4,ok,1.5,,,7\n")
    r = files.benchmark_runs(spark, str(tmp_path)).first()
    assert (r.file_language, r.elapsed_ms, r.peak_memory_bytes, r.mapping_operations) == ("go", 1.5, None, 7)
    scored = files.scored_tools(spark.createDataFrame([("a", 10, 1, None), ("b", 5, 0, 2)], "solution string, total_lines int, x_mismatches int, y_mismatches int"))
    assert sorted(tuple(r) for r in scored.collect()) == [("a", 10, "x", 1), ("b", 5, "x", 0), ("b", 5, "y", 2)]
    (tmp_path / "f1").mkdir()
    (tmp_path / "f1" / "human_mapping.json").write_text('{"entries": [{"operation": "insert", "before_path": null, "after_path": ["a", "b[1]"]}]}')
    h = files.human_mappings(spark, str(tmp_path / "f1")).first()
    assert (h.name, h.operation, h.before_path, h.after_path) == ("f1", "insert", None, "a/b[1]")


def test_other_tools(spark):
    row = [(1, '{"chunks": [[{"lhs": {"line_number": 2}}, {"rhs": {"line_number": 3}, "lhs": {"line_number": 4}}]]}', '{"hunks": [{"Old": [{"line_index": 1}]}, {"New": [{"line_index": 5}, {"line_index": 5}]}]}', '{"actions": [{"action": "insert-node", "tree": "x: y [2,5]"}, {"action": "delete-node", "tree": "x [0,1]"}]}', "a\nb\nc", "a\nb\nc")]
    df = spark.createDataFrame(row, "k int, chunks string, hunks string, actions string, b string, a string")
    sides = lambda d: sorted((r.side, r.row) for r in d.collect())
    assert sides(files.hunks_touched(df, "k", "chunks")) == [("after", 3), ("before", 2), ("before", 4)]
    assert sides(files.edits_touched(df, "k", "hunks")) == [("after", 5), ("before", 1)]
    assert sides(files.actions_touched(df, "k", "actions", "b", "a")) == [("after", 1), ("after", 2), ("before", 0)]


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "repos" / "alpha"
    root.mkdir(parents=True)
    (tmp_path / "repos" / "not_one").mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    for k, edit in enumerate((lambda: (root / "main.rs").write_text("fn a() {}\n"), lambda: (root / "main.rs").write_text("fn a() {}\nfn b() {}\n"), lambda: (root / "bin.c").write_bytes(b"\xff"), lambda: os.rename(root / "main.rs", root / "moved.rs"), lambda: os.remove(root / "moved.rs"))):
        edit()
        run("add", "-A")
        run("commit", "-qm", f"c{k}")
    return tmp_path / "repos"


def test_git(spark, repository):
    assert [p.rpartition("/")[2] for p in git.repositories(str(repository))] == ["alpha"] and git.find_repository(["/nowhere", str(repository)], "alpha")
    rows = git.deltas(spark, str(repository)).collect()
    assert sorted(r.status for r in rows) == ["Added", "Added", "Deleted", "Deleted", "Modified"]
    changed = next(r for r in rows if r.status == "Modified")
    assert changed.before == "fn a() {}\n" and changed.after.endswith("fn b() {}\n") and changed.bytes_after == 20
    assert next(r for r in rows if r.path == "bin.c").error == "not UTF-8"
    renamed = git.deltas(spark, str(repository), detectRenames="true").where("status = 'Renamed'").first()
    assert (renamed.old_path, renamed.path) == ("main.rs", "moved.rs")
    assert git.deltas(spark, str(repository), everyCommit="true").count() == 6 and git.deltas(spark, str(repository), maxCommits="1").count() == 1
    stats = {r.relative_file_path: r for r in git.commit_statistics(git.deltas(spark, str(repository))).where("git_reported_status = 'Modified'").collect()}
    assert (stats["main.rs"].lines_before, stats["main.rs"].lines_after, stats["main.rs"].language) == (1, 2, "Rust")
    assert [(r.path, r.size_bucket) for r in git.candidates(git.deltas(spark, str(repository))).collect()] == [("main.rs", "small")]
    assert git.deltas(spark, str(repository / "not_one")).count() == 0


def test_merge_and_csv(spark, tmp_path):
    path = str(tmp_path / "table")
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 2)], "k int, v string, t int")
    sinks.merge(one, path, ["k"], ["t"])
    sinks.merge(spark.createDataFrame([(1, "z", 5), (3, "y", 5)], one.schema), path, ["k"], ["t"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "z", 5), (2, "c", 2), (3, "y", 5)]
    assert sinks.size(spark, path) > 0 and sinks.size(spark, path + "none") == 0
    sinks.sorted_csv(spark.createDataFrame([(2, None), (1, "x")], "k int, v string"), str(tmp_path / "csv"), ["k"])
    assert spark.read.text(str(tmp_path / "csv")).count() >= 3
    wide = {r.k: r for r in sinks.wide_reasons(spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "k int, r string"), "k", "r", ["A", "C"]).collect()}
    assert (wide["TOTAL"].A, wide["TOTAL"].B, wide["TOTAL"].C, wide["1"].total) == (2, 1, 0, 2)
    named = sinks.distinct_names(spark.createDataFrame([("n", "a", "b"), ("n", "a", "b"), ("n", "a", "c")], "n string, b string, a string"), "n", "b", "a")
    assert sorted(r.target for r in named.collect()) in (["n", "n", "n-2"], ["n", "n-2", "n-2"])


def test_statistics_tables(spark, tmp_path):
    (tmp_path / "s").mkdir()
    f = tmp_path / "s" / "a.py"
    f.write_text("x = 1\ndef g():\n    pass\n")
    (tmp_path / "s" / "gen.py").write_text("# do not edit\nx = 1\n")
    target = str(tmp_path / "out")
    kinds = lambda: {r.kind: r.n for r in spark.read.parquet(f"{target}/node_kind_counts").collect()}
    sinks.write_statistics(files.scan(spark, str(tmp_path / "s")), target)
    assert kinds()["FunctionDef"] == 1 and kinds()["Module"] == 1
    rows = {r.path.rpartition("/")[2]: r for r in spark.read.parquet(f"{target}/files").collect()}
    assert rows["a.py"].ast_nodes == sum(kinds().values()) and rows["gen.py"].ast_nodes == 0 and rows["gen.py"].automatically_generated
    f.write_text("x = 1\n")
    sinks.write_statistics(files.scan(spark, str(tmp_path / "s")), target)
    assert "FunctionDef" not in kinds() and spark.read.parquet(f"{target}/node_kind_subtree_size_histogram").agg(F.sum("n")).first()[0] == sum(kinds().values())


def test_streamed_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\ny = 2\n")
    (src / "g.py").write_text("# automatically generated\nx = 1\n")
    (src / "doc.txt").write_text("text")
    seen = ingest.Throughput()
    spark.streams.addListener(seen)
    go = lambda: ingest.ingest(spark, str(src), str(tmp_path / "t"), str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    go()
    table = lambda: {r.path.rpartition("/")[2]: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert set(table()) == {"a.py", "g.py"} and table()["a.py"].lines_of_code == 2 and table()["g.py"].automatically_generated and table()["g.py"].lines_of_code == 0
    (src / "b.rs").write_text("fn b() {}\n")
    go()
    assert set(table()) == {"a.py", "g.py", "b.rs"}
    for _ in range(50):
        if seen.rows >= 4:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.rows >= 4 and seen.batches >= 2


def test_running_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:00:00', 'b'")
    assert sorted((r.k, r.n) for r in ingest.running_counts(df, "ts", "k").collect()) == [("a", 2), ("b", 1)]


def test_a_broken_replacement_loses_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1)], "k int, v string, t int")
    sinks.merge(one, path, ["k"], ["t"])
    (tmp_path / "t").rename(tmp_path / "t.old")  # broken off between the two renames
    sinks.merge(spark.createDataFrame([(2, "b", 1)], one.schema), path, ["k"], ["t"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a", 1), (2, "b", 1)] and not (tmp_path / "t.old").exists()
