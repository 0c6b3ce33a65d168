"""Archives, folders and documents as sources and sinks."""

import hashlib
import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import reports
from gneiss.sources import archives

COLUMNS = ["No", "hour", "PM", "station"]


def station_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in members.items():
            z.writestr(name, "\r\n".join([",".join(COLUMNS), *(",".join(r) for r in rows)]) + "\r\n")
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_station_archive(spark, tmp_path):
    path = f"{tmp_path}/a.zip"
    hours = [f"2020-01-01 0{k}:00:00" for k in range(4)]
    digest = station_zip(path, {
        "x/Data_Oak_1.csv": [(str(k), h, v, "Oak") for k, (h, v) in enumerate(zip(hours, ["1.5", "NA", "-3", "x"]))],
        "x/Data_Elm_1.csv": [("0", hours[0], "2", "Elm"), ("1", hours[0], "2", "Oak"), ("2", hours[2], "", "Elm")], "readme.txt": [("a", "b", "c", "d")]})
    rows = archives.read_station_archive(spark, f"file://{path}", ["Oak", "Elm", "Fir"], COLUMNS, sha256=digest)
    report = archives.station_report(rows, hour=F.to_timestamp("hour"), label="station", value="PM").collect()
    assert [(r.station, r.rows, r.repeated, r.hourly, r.mislabelled, r.invalid) for r in report] == [("Elm", 3, 1, False, 1, 0), ("Oak", 4, 0, True, 0, 2)]
    with pytest.raises(Exception, match="not the archive"):
        archives.read_station_archive(spark, f"file://{path}", ["Oak", "Elm"], COLUMNS, sha256="0").collect()
    with pytest.raises(Exception, match="no single registered station"):
        archives.read_station_archive(spark, f"file://{path}", ["Oak", "Fir"], COLUMNS).select("station_from_name").collect()
    with pytest.raises(Exception, match="unexpected header"):
        archives.read_station_archive(spark, f"file://{path}", ["Oak", "Elm"], COLUMNS[:3]).collect()


def test_members_are_read_only_after_the_preflight(spark, tmp_path):
    for name, members in (("good", {"a.txt": b"1", "b/c.txt": b"22"}), ("bad", {"../up.txt": b"1", "z.txt": b"0" * 100_000})):
        with zipfile.ZipFile(f"{tmp_path}/{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in members.items():
                z.writestr(k, v)
    rows = archives.read_members(spark, f"file://{tmp_path}").collect()
    assert sorted((os.path.basename(r.archive), r.path, bytes(r.content)) for r in rows) == [("good.zip", "a.txt", b"1"), ("good.zip", "b/c.txt", b"22")]
    found = archives.archive_findings(archives.list_members(spark, f"file://{tmp_path}")).collect()
    assert {(os.path.basename(r.archive), r.code, r.detail) for r in found} == {("bad.zip", "PATH_UNSAFE", "../up.txt"), ("bad.zip", "RATIO_TOO_HIGH", "z.txt")}
    small = archives.archive_findings(archives.list_members(spark, f"file://{tmp_path}/good.zip"), {"files": 1, "member": 1, "total": 2, "ratio": 200}).collect()
    assert sorted((r.code, r.detail) for r in small) == [("MEMBER_TOO_LARGE", "b/c.txt"), ("TOO_MANY_FILES", ""), ("TOTAL_TOO_LARGE", "")]


def test_directories_without_links(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_bytes(b"one")
    (tmp_path / "d" / "sub" / "b.txt").write_bytes(b"two")
    rows = archives.read_directory(spark, f"file://{tmp_path}/d").collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == [("a.txt", b"one"), ("sub/b.txt", b"two")]
    with pytest.raises(ValueError, match="larger"):
        archives.read_directory(spark, f"file://{tmp_path}/d", {"files": 1, "member": 10, "total": 10})
    os.symlink(tmp_path / "d" / "a.txt", tmp_path / "d" / "l.txt")
    with pytest.raises(ValueError, match="link"):
        archives.read_directory(spark, f"file://{tmp_path}/d")


def test_line_ends_and_scans(spark):
    files = spark.createDataFrame([("a", bytearray(b"x\r\ny\rz\n")), ("b", bytearray(b"key: secret\nfine\n")), ("c", bytearray(b""))], "path string, content binary")
    clean = archives.normalized_lines(files)
    got = {r.path: (bytes(r.content), r.changed) for r in clean.collect()}
    assert got == {"a": (b"x\ny\nz\n", True), "b": (b"key: secret\nfine\n", False), "c": (b"", False)}
    old = [(p, hashlib.sha256(c).hexdigest()) for p, c in (("a", b"x\r\ny\rz\n"), ("b", b"wrong"))]
    new = {r.path: r.sha256 for r in archives.rehashed(spark.createDataFrame(old, "path string, sha256 string"), clean).collect()}
    assert new == {"a": hashlib.sha256(b"x\ny\nz\n").hexdigest(), "b": old[1][1]}
    assert [(r.path, r.line, r.code) for r in archives.content_scan(files, {"SECRET": "secret", "LETTER": "^z$"}).orderBy("path").collect()] == [("b", 1, "SECRET")]


def test_npz_and_study_bundles_depend_on_their_content(spark):
    arrays = {"b": np.arange(6).reshape(2, 3), "a": np.array([1.5, -2])}
    data = archives.npz_bytes(arrays)
    assert data == archives.npz_bytes(dict(reversed(arrays.items())))
    back = np.load(io.BytesIO(data))
    assert sorted(back.files) == ["a", "b"] and (back["b"] == arrays["b"]).all()
    table = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    one = archives.study_bundle({"t": table}, profile="p", required=["tables/t.jsonl", "notes.json"], documents={"notes.json": {"b": 1, "a": 2}})
    assert one == archives.study_bundle({"t": table.orderBy("k")}, profile="p", required=["notes.json", "tables/t.jsonl"], documents={"notes.json": {"a": 2, "b": 1}})
    with zipfile.ZipFile(io.BytesIO(one)) as z:
        assert z.read("tables/t.jsonl") == b'{"k":1,"v":"x"}\n{"k":2,"v":null}\n' and json.loads(z.read("profile.json"))["profile"] == "p"
    with pytest.raises(ValueError, match="missing"):
        archives.study_bundle({"t": table}, profile="p", required=["other"])
    with pytest.raises(ValueError, match="over 1"):
        archives.study_bundle({"t": table}, profile="p", required=[], most_rows=1)


def walk(value, path="$", depth=0):
    yield path, depth, value
    items = [(f"{path}.{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{k}]", v) for k, v in enumerate(value)] if isinstance(value, list) else []
    for p, v in items:
        yield from walk(v, p, depth + 1)


def test_json_nodes_depth_and_difference(spark):
    documents = {1: {"a": [1, {"b": None}], "c": "x"}, 2: [], 3: 5, 4: {"n": 1.0, "m": [True]}}
    other = {1: {"a": [1, {"b": 0}], "d": "x"}, 2: [], 3: 5, 4: {"n": 1.0 + 1e-14, "m": [True]}}
    frame = lambda docs: spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [(9, "{not json")], "key long, document string")
    nodes = {(r.key, r.path, r.depth) for r in reports.json_nodes(frame(documents), ["key"], "document").collect()}
    assert nodes == {(k, p, d) for k, v in documents.items() for p, d, _ in walk(v)} | {(9, None, 0)}
    assert {r.key: r.depth for r in reports.json_depth(frame(documents), ["key"], "document").collect()} == {1: 3, 2: 0, 3: 0, 4: 2, 9: None}
    got = {(r.key, r.path, r.left, r.right) for r in reports.json_difference(frame(documents), frame(other), ["key"], "document").collect()}
    assert got == {(1, "$.a[1].b", "null", "0"), (1, "$.c", '"x"', None), (1, "$.d", None, '"x"')}
    with pytest.raises(ValueError, match="deeper"):
        reports.json_nodes(spark.createDataFrame([(1, "[" * 9 + "]" * 9)], "key long, document string"), ["key"], "document", deepest=4)


def test_documents_as_sources_and_sinks(spark, tmp_path):
    from gneiss.sources import documents

    frame = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.5, None), (3, float("inf"), "")], "k int, x double, s string")
    documents.write_csv(frame.coalesce(1), f"file://{tmp_path}/csv")
    (name,) = [n for n in os.listdir(tmp_path / "csv") if n.endswith(".csv")]
    assert sorted((tmp_path / "csv" / name).read_text().splitlines()) == ["1,,a", "2,1.5,", "3,,", "k,x,s"]
    assert documents.canonical_json({"b": [1, 2.5], "a": "é"}) == '{"a":"é","b":[1,2.5]}\n'
    with pytest.raises(ValueError):
        documents.canonical_json({"x": float("nan")})
    packs = [{"domain_id": "one", "title": "t", "claim_authority": "COMPUTED", "ladder": [1, 2, 3, 4.5], "source": {"doi": "x"}}, {"domain_id": "short", "ladder": [1, 2]}]
    (tmp_path / "packs").mkdir()
    for k, p in enumerate(packs):
        (tmp_path / "packs" / f"{k}.json").write_text(json.dumps(p, indent=1))
    rows = documents.ladders_of(documents.read_json(spark, f"file://{tmp_path}/packs", documents.LADDER_PACK)).orderBy("pos").collect()
    assert [(r.ladder, r.pos, r.value) for r in rows] == [("one", 1, 1.0), ("one", 2, 2.0), ("one", 3, 3.0), ("one", 4, 4.5)]
    (tmp_path / "packs" / "9.json").write_text("{broken")
    with pytest.raises(Exception):
        documents.read_json(spark, f"file://{tmp_path}/packs", documents.LADDER_PACK).collect()
    (tmp_path / "s.csv").write_text("a,b\n1,x\n")
    assert documents.read_station_csv(spark, f"file://{tmp_path}/s.csv", ["a", "b"]).first().b == "x"
    with pytest.raises(Exception):
        documents.read_station_csv(spark, f"file://{tmp_path}/s.csv", ["a", "c"]).collect()
