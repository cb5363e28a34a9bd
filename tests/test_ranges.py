"""Large JSON files cut anywhere give what the whole file gives."""

import json
import random

import pytest

from tessera.sources import ranges, snapshot

STRINGS = ["", "plain", 'a, "quoted", one', "back\\slash\\", "[1,2]", "{", "}]", "line\nbreak, tab\t", "日本, 語", ",", '",', "\\\\\",\\"]


def made(n):
    pick = random.Random(n)
    nodes = [x for k in range(n) for x in (pick.randrange(2), pick.randrange(len(STRINGS)), 2 * k + 1, pick.randrange(1000), 0)]
    meta = {"node_fields": ["type", "name", "id", "self_size", "edge_count"], "node_types": ["object", "string"], "edge_fields": ["type", "name_or_index", "to_node"], "edge_types": ["context"]}
    return {"snapshot": {"meta": meta, "node_count": n}, "nodes": nodes, "edges": [], "deep": [[1, [2, 3]], {"a": [4, {"b": "],"}]}, "x"], "strings": STRINGS, "objectIdMap": {"1": 5, "a,b": 6}}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ranges")
    for n, indent in ((5, None), (2, 1)):
        (folder / f"{n}.heapsnapshot").write_text(json.dumps(made(n), indent=indent, ensure_ascii=indent is None))
    return folder


@pytest.fixture(params=["128m", "61b"])
def cut(request, spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_elements_of_ranges_are_those_of_the_file(spark, files, cut):
    found = {}
    for r in ranges.json_elements(spark, str(files)).collect():
        key = (r["file"].rsplit("/", 1)[-1].split(".")[0], r["array"], r["number"])
        assert key not in found
        found[key] = r["text"]
    expected = {}
    for n in (5, 2):
        for array, inner in made(n).items():
            entries = [{k: v} for k, v in inner.items()] if isinstance(inner, dict) else inner
            expected |= {(str(n), array, k): x for k, x in enumerate(entries)}
    parsed = {k: json.loads(f"{{{t}}}" if k[1] in ("snapshot", "objectIdMap") else t) for k, t in found.items()}
    assert parsed == expected


def test_nodes_are_those_of_the_whole_snapshot(spark, files, cut):
    columns = ["node", "node_id", "size", "edge_count", "type", "name"]
    read = lambda f: sorted((r["graph"].rsplit("/", 1)[-1], *[r[c] for c in columns]) for r in f.collect())
    whole = read(snapshot.nodes(snapshot.read_snapshots(spark, str(files))))
    assert read(ranges.snapshot_nodes(ranges.json_elements(spark, str(files)))) == whole and len(whole) == 7


def test_elements_of_nodes_meet_after_they_are_dealt(spark, files, monkeypatch):
    """In as many tasks as asked for, hashed there and not sorted, and not held where they are read."""
    monkeypatch.setattr(ranges, "width", lambda df: 9)
    found = ranges.snapshot_nodes(ranges.json_elements(spark, str(files)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan.split("REPARTITION_BY_NUM")[-1]
    assert found.count() == 7


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_any_ranges_of_records_compose(width):
    """The same two scans and folds without files: ranges of a few records each."""
    records = json.dumps(made(4), ensure_ascii=False).split(",")
    inside, depth, array, number, found = False, 0, None, 0, {}
    for at in range(0, len(records), width):
        mine = records[at : at + width]
        *elements, (opened, last, count) = ranges.elements_of(mine, inside, depth)
        for name, k, text, _, _ in elements:
            found.setdefault((name or array, k + (0 if name else number)), []).append(text)
        inside, more = ranges.ending(mine, inside)
        depth += more
        array, number = (last, count) if opened else (array, number + count)
    whole = {(a, k): x for a, v in made(4).items() for k, x in enumerate([{x: y} for x, y in v.items()] if isinstance(v, dict) else v)}
    assert {k: json.loads(f"{{{t}}}" if k[0] in ("snapshot", "objectIdMap") else t) for k, v in found.items() for t in [",".join(v)]} == whole


def test_states_compose():
    text = json.dumps(made(3)).split(",")
    for at in range(len(text)):
        first, second = ranges.ending(text[:at], False), ranges.ending(text[at:], ranges.ending(text[:at], False)[0])
        assert (second[0], first[1] + second[1]) == ranges.ending(text, False) == (False, 0)


def test_files_without_arrays_and_without_anything(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "t": "x, y"}')
    (tmp_path / "b.json").write_text('{"none": [], "empty": {}, "blank": [ ]}')
    (tmp_path / "c.json").write_text("")
    assert ranges.json_elements(spark, str(tmp_path)).count() == 0
