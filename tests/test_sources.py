"""Readers of logs, snapshots, catalogs and SQLite tables, and streaming forms, on written files."""

import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.runtime import shared_dir, stored
from tessera.sources import cases, catalog, logs, snapshot
from tessera.sources.sqlite import SqliteSource, first_with_rows
from tessera.streaming import events as E


def test_logs_in_several_encodings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "crash-20240102030405.log").write_bytes("﻿HEAD ok\nline".encode())
    (tmp_path / "sub" / "crash-1704164645000.log").write_bytes("HEAD 内存泄漏".encode("gb18030"))
    (tmp_path / "other.txt").write_bytes(b"HEAD")
    (tmp_path / "crash-x.log").write_bytes(b"no mark")
    (tmp_path / "packed.gz").write_bytes(gzip.compress("packed 文".encode()))
    assert [r["text"] for r in logs.read_logs(spark, str(tmp_path), r"\.gz$").collect()] == ["packed 文"]
    got = {r["name"]: r for r in logs.read_logs(spark, str(tmp_path), r"^crash-.*\.log$", "HEAD").collect()}
    assert set(got) == {"crash-20240102030405.log", "crash-1704164645000.log"}
    assert got["crash-20240102030405.log"]["text"] == "HEAD ok\nline"
    assert got["crash-1704164645000.log"]["text"] == "HEAD 内存泄漏"
    assert {str(r["time"]) for r in got.values()} == {"2024-01-02 03:04:05"}


def test_sections_blocks_and_records(spark):
    text = "noise\nFault thread info:\nTid:1, Name:main\n#00 pc 0000000a /lib/a.so(run+12)\n#01 pc 0000000b /bin/b\nTid:2, Name:io\n#00 pc 0c /lib/c.so\nMaps:\n1000-2000 r-xp 0 0 0 /lib/a.so\n10:11 to 20:0 code 3 wait:1.5 s"
    rows = logs.lines(spark.createDataFrame([("p", text)], "path string, text string"))
    named = logs.sections(rows, ["path"], {"fault": "^Fault thread", "maps": "^Maps:"})
    assert [r["section"] for r in named.orderBy("line_no").collect()] == [None, *["fault"] * 6, *["maps"] * 3]
    found = logs.blocks(rows, ["path"], r"^Tid:\d+").orderBy("block").collect()
    assert [r["header"] for r in found] == ["Tid:1, Name:main", "Tid:2, Name:io"] and len(found[0]["body"]) == 2
    frames = logs.stack_frames(rows).orderBy("line_no").collect()
    assert [(r["depth"], r["file"], r["function"], r["offset"]) for r in frames] == [(0, "/lib/a.so", "run", 12), (1, "/bin/b", "", None), (0, "/lib/c.so", "", None)]
    maps = logs.memory_maps(rows).collect()
    assert [(int(r["low"]), int(r["high"]), r["file"]) for r in maps] == [(4096, 8192, "/lib/a.so")]
    edge = logs.wait_edges(rows).collect()
    assert [(r["src_pid"], r["dst_tid"], r["wait_s"]) for r in edge] == [("10", "0", 1.5)]


def test_snapshot_arrays_and_repair(spark, tmp_path):
    made = {
        "snapshot": {"meta": {"node_fields": ["type", "name", "id", "self_size", "edge_count"], "node_types": ["object", "string"],
                              "edge_fields": ["type", "name_or_index", "to_node"], "edge_types": ["property", "element", "weak"]}},
        "nodes": [0, 0, 1, 10, 2, 0, 1, 3, 20, 1, 1, 2, 5, 30, 0],
        "edges": [0, 3, 5, 1, 7, 10, 2, 4, 999],
        "strings": ["root", "A", "B", "child", "ref"],
    }
    (tmp_path / "a.heapsnapshot").write_text(json.dumps(made))
    snaps = snapshot.read_snapshots(spark, str(tmp_path / "a.heapsnapshot"))
    nodes = snapshot.nodes(snaps).orderBy("node").collect()
    assert [(r["node_id"], r["name"], r["size"], r["type"]) for r in nodes] == [(1, "root", 10, "object"), (3, "A", 20, "object"), (5, "B", 30, "string")]
    edges = snapshot.edges(snaps)
    assert sorted((r["src"], r["dst"], r["name"], r["repaired"]) for r in edges.collect()) == [(0, 1, "child", False), (0, 2, "7", False), (1, 0, "ref", True)]
    assert snapshot.strong(edges).count() == 2


def test_catalog(spark, tmp_path):
    for name, text in {"one": "---\nname: first\ndescription: 'Says  hello'\n---\n# T\nbody", "two": "# Title\n\nplain words here\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    got = sorted((r["name"], r["description"]) for r in catalog.read_catalog(spark, str(tmp_path), "SKILL.md").collect())
    assert got == [("first", "Says hello"), ("two", "plain words here")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE t (id INTEGER, name TEXT, v REAL, "odd ""name" BLOB)')
    con.execute("CREATE TABLE none (id INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k, f"n{k}", k / 2, None) for k in range(100)])
    con.commit()
    con.close()
    spark.dataSource.register(SqliteSource)

    def read(name):
        return spark.read.format("sqlite").option("path", path).option("table", name).load()

    assert read("t").agg(F.count("*"), F.sum("v")).first() == (100, 2475.0)
    assert first_with_rows([lambda: read("none"), lambda: read("t")]).count() == 100
    assert first_with_rows([lambda: read("none")]).count() == 0
    with pytest.raises(ValueError):
        first_with_rows([])


def test_sqlite_views_keys_and_filters(spark, tmp_path):
    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER, v REAL)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(k, k / 2) for k in range(100)] + [(None, None)])
    con.execute("CREATE VIEW half AS SELECT * FROM t WHERE id < 50")
    con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    con.executemany("INSERT INTO keyed VALUES (?, ?)", [("a", 1), ("b", 2)])
    con.execute("CREATE VIEW vacant AS SELECT * FROM t WHERE id < 0")
    con.commit()
    con.close()
    spark.dataSource.register(SqliteSource)
    counts = {"t": 101, "half": 50, "keyed": 2, "vacant": 0}
    for pushed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        try:
            read = {n: spark.read.format("sqlite").option("path", path).option("table", n).option("pushdown", pushed).load() for n in counts}
            assert {n: r.count() for n, r in read.items()} == counts
            assert read["t"].where("id >= 90 AND v < 48").count() == 6
            assert [r["k"] for r in read["keyed"].where("n = 2").collect()] == ["b"]
            assert read["t"].where("id IS NULL").count() == 1
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:01:10")], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = E.unseen(stream, "t", ["k"], "1 hour").writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("first_seen").count() == E.unseen(rows, "t", ["k"], "1 hour").count() == 2
    counts = E.windowed_counts(rows, "t", ["k"], "1 minute", "1 hour")
    assert sorted((r["k"], r["n"]) for r in counts.collect()) == [(1, 2), (2, 1)]


def test_stored_tables_are_in_the_shared_folder(spark):
    kept = stored(spark.range(3).toDF("x"), "three")
    assert kept.count() == 3 and all(shared_dir(spark).removeprefix("file://") in f for f in kept.inputFiles())


def test_address_map(spark, tmp_path):
    (tmp_path / "map.txt").write_text("# note\n0x10 5 rest\n10 5\nFF 6\n\nnot an address\n0xffffffffffffffff 7\n")
    good, bad = cases.read_address_map(spark, str(tmp_path / "map.txt"))
    assert sorted(tuple(r) for r in good.collect()) == [("16", 5, 2), ("18446744073709551615", 7, 1), ("255", 6, 1)]
    assert [r["line"] for r in bad.collect()] == ["not an address"]


def test_clusters_and_seeds(spark, tmp_path):
    entry = {"node_id": "12", "name": "A", "retained_size": 5, "distance": 0}
    made = {"candidates": [{"rank": 1, "key": "k1", "path_entries": [entry, entry | {"node_id": "3", "distance": 1}]}, {"rank": 2, "key": "k2", "path_entries": [entry]}]}
    (tmp_path / "c.json").write_text(json.dumps(made))
    clusters = cases.read_clusters(spark, str(tmp_path / "c.json"))
    assert clusters.count() == 2 and [tuple(r) for r in cases.seeds(clusters).collect()] == [(12, ["k1", "k2"])]


def test_roles_and_reports(spark, tmp_path):
    (tmp_path / "case").mkdir()
    for name in ("a.db", "b.heapsnapshot"):
        (tmp_path / "case" / name).write_text("x")
    found = cases.files_by_role(spark, str(tmp_path / "case"), {"trace": r"\.db$", "heap": r"\.heapsnapshot$"})
    assert found["trace"].endswith("a.db") and found["heap"].endswith("b.heapsnapshot")
    with pytest.raises(ValueError):
        cases.files_by_role(spark, str(tmp_path / "case"), {"map": r"\.map$"})
    rows = spark.sql("SELECT CAST(18446744073709551615 AS decimal(20,0)) AS nodeAddress, 1 AS n")
    cases.write_report(rows, str(tmp_path / "out"), least=1)
    text = next(p for p in (tmp_path / "out").glob("*.json")).read_text()
    assert json.loads(text) == {"node_address": "18446744073709551615", "n": 1}
    with pytest.raises(ValueError):
        cases.write_report(rows.limit(0), str(tmp_path / "none"), least=1)


def test_blocks_of_whole_texts_are_those_of_their_lines(spark):
    texts = ["x\nHead:1\na\nb\r\nHead:2\nHead:3\n", "", None, "none", "Head:9", "Head:1 x\nHead:1\r\n\r\n" + "line\n" * 3000 + "Head:2"]
    frame = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    expected = logs.blocks(logs.lines(frame), ["path"], r"^Head:\d+$").collect()
    found = logs.text_blocks(frame, r"^Head:\d+$")
    assert found.columns == ["path", "block", "header", "body"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == sorted(map(tuple, expected), key=lambda r: r[:2]) and len(expected) == 6
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_crash_logs_grow_in_number(spark, monkeypatch):
    """A log, which is read as one text, grew with the orders, and its lines were sorted and numbered in one task."""
    from tessera import queries

    monkeypatch.setattr(queries, "_LOG_RECORDS", 50)
    made = queries.QUERIES["crash_records"](spark, "/root/testdata/sf0.001")
    sizes = [len(r["text"].split("Order:")) - 1 for r in logs.read_logs(spark, made.inputFiles()[0].rsplit("/", 1)[0], r"\.gz$").collect()]
    assert max(sizes) <= 50 and sum(sizes) == made.count() > 500
    assert not {"Window", "Exchange"} & set(made._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())


def test_orders_of_crash_logs_are_not_broadcast(spark):
    """Nine million orders in a file of 12 MB were, and took 1,547 MB of every task."""
    from tessera import queries

    assert "Broadcast" not in queries._crash_logs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
