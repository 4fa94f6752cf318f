import json

import pytest
from pyspark.sql import functions as F

from tritsift.operators import vectors as V
from tritsift.sources import code, records, wire
from tritsift.sources.segments import Segments
from tritsift.streaming import ingest


def write(path, text):
    path.write_text(text)
    return str(path)


def test_json_forms(spark, tmp_path):
    rows = [{"subject": "lake_orrin", "relation": "located_in", "object": "vale"}, {"subject": "b", "relation": "r", "object": None}]
    lines = write(tmp_path / "a.jsonl", "\n" + "\n".join(map(json.dumps, rows)) + "\n{broken\n\n")
    array = write(tmp_path / "b.json", json.dumps(rows, indent=1))
    schema = "subject string, relation string, object string"
    for path, form in ((lines, "lines"), (array, "array")):
        assert records.detect_format(spark, path) == form
        assert sorted(r.subject for r in records.read_json(spark, path, schema).collect()) == ["b", "lake_orrin"]
    assert records.corrupt_lines(spark, lines, schema) == 1
    with pytest.raises(ValueError):
        records.detect_format(spark, write(tmp_path / "c.txt", "plain"))


def test_messages(spark):
    schema = "author string, site string, tags array<string>, message_text string, message_text_translated string, chat string"
    rows = [("ann", "s", ["a"] * 8, "a long enough text", None, None), ('{"username": " ", "name": "Bo"}', "s", None, "short", "a translated text", '{"title": "room"}'), (None, "s", [], "another long text", "", "{}"), ("x", "s", [], "tiny", None, None)]
    got = [tuple(r) for r in records.message_triples(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("ann", "s a a a a a a", "a long enough text", "s"), ("Bo", "s ", "a translated text", "room"), ("unknown", "s ", "another long text", "s")]


def test_combine_and_queries(spark):
    a = spark.createDataFrame([("1", None, "first"), (None, "n1", "x"), (None, None, "lost")], "id string, native_id string, v string")
    b = spark.createDataFrame([("1", None, "second"), ("2", None, "new"), (None, "n1", "y"), (None, None, "lost2")], "id string, native_id string, v string")
    assert sorted(r.v for r in records.combine([a, b]).collect()) == ["first", "lost", "new", "x"]
    q = spark.createDataFrame([("a", [1, 2], None), ("b", None, 3), ("c", None, None), ("", [1], None)], "query_text string, gold_ids array<bigint>, gold_id bigint")
    assert {r.query_text: r.gold_ids for r in records.operator_queries(q).collect()} == {"a": [1, 2], "b": [3]}


def test_code_facts(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "m.py").write_text('import os\nfrom a.b import c\nclass K(Base):\n    """Doc line.\n    more"""\n    @deco\n    def f(self, x): pass\n')
    (tmp_path / "pkg" / "n.cpp").write_text("#include <vector>\nnamespace q {\nclass Z {\n};\nint run(int a) {\n  if (a) { return 1; }\n}\n}\n")
    (tmp_path / "pkg" / "r.md").write_text("# Top\n\n## Part ##\n")
    (tmp_path / "pkg" / "s.sh").write_text("go() {\n  :\n}\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    got = {(r.subject, r.relation, r.object) for r in code.code_triples(spark, str(tmp_path)).collect()}
    for fact in (("m", "imports", "os"), ("m", "imports_from", "a.b"), ("m", "defines_class", "K"), ("K", "extends", "Base"), ("K", "described_as", "Doc line."), ("f", "decorated_by", "deco"), ("f", "has_parameter", "x"), ("n", "includes", "vector"), ("n", "in_namespace", "q"), ("n", "defines_class", "Z"), ("n", "defines_function", "run"), ("r", "has_title", "Top"), ("r", "has_section", "Part"), ("s", "defines_function", "go"), ("m", "part_of", "pkg"), ("bad", "file_type", "py")):
        assert fact in got, fact
    assert ("n", "defines_function", "if") not in got


def test_wire(spark):
    assert wire.decode_vector(wire.encode_vector(64, [(3, 1), (60, -1)])) == (64, [(3, 1), (60, -1)])
    for bad in ([(64, 1)], [(1, 2)], [(1, 1), (1, -1)]):
        with pytest.raises(ValueError):
            wire.encode_vector(64, bad)
    with pytest.raises(ValueError):
        wire.decode_vector(wire.encode_vector(64, [(3, 1)])[:-1])
    v = spark.createDataFrame([(1, 3, 1), (1, 9, -1), (2, 0, 1)], "vec_id bigint, idx int, sgn int")
    back = wire.unpack_vectors(wire.pack_vectors(V.pack(v, "vec_id"), "vec_id", 16), "vec_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))


def test_escapes(spark):
    assert wire.unescape("caf%C3%A9 &amp; bar\\n") == "café & bar\n" and wire.unescape("a+b\\\\n") == "a+b\\n"
    df = spark.createDataFrame([("a%20b",), (None,)], "x string").select(wire.unescaped(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ["a b", None]


def test_bundles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    m = wire.bundle_manifest(spark, str(tmp_path)).collect()
    made = spark.createDataFrame(m)
    sig = wire.sign_manifest([tuple(r) for r in m], b"k")
    assert sig == wire.sign_manifest([tuple(r) for r in reversed(m)], b"k") != wire.sign_manifest([tuple(r) for r in m], b"l")
    assert wire.verify_bundle(spark, str(tmp_path), made).count() == 0
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    assert {(r.path.rsplit("/")[-1], r.problem) for r in wire.verify_bundle(spark, str(tmp_path), made).collect()} == {("a.txt", "changed"), ("b.txt", "missing"), ("c.txt", "unknown")}


def test_segments(spark, tmp_path):
    s = Segments(spark, str(tmp_path / "seg"))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.append(spark.range(10_000))
    assert not s.should_compact()
    s.append(spark.range(10_000, 16_000))
    assert s.should_compact() and s.counts().count() == 2
    s.compact()
    assert s.read().count() == 16_000 and s.counts().count() == 1 and s.manifest()["version"] == 3
    s.append(spark.range(3))
    assert s.read().distinct().count() == 16_000


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i, f"s{i}", "r") for i in range(30)]
    for n in range(3):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "vec_id bigint, subject string, relation string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id bigint, subject string, relation string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest_vectors(stream, str(tmp_path / "out"), 256, 16, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("vec_id", "idx", "sgn")
    tokens = spark.createDataFrame([(i, t) for i, s, r in rows for t in (s, r)], "vec_id bigint, token string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.encode_bag(tokens, "vec_id", "token", 256, 16).collect()))


def test_windows_and_associations(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:10:00", 1.0), (1, "a", "2024-01-01 00:20:00", 2.0), (2, "a", "2024-01-01 01:20:00", 3.0)]
    df = spark.createDataFrame(rows, "user_id bigint, event_type string, t string, value double").select("user_id", "event_type", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    for frame, want in ((ingest.hourly(stream), 2), (ingest.sessions(stream), 2)):
        q = frame.writeStream.outputMode("complete" if want and frame is not None and "window" in frame.columns else "append").format("memory").queryName(f"q{abs(hash(frame)) % 10**6}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.lastProgress is not None
    held = {}
    ingest.reinforce(held, "x", 0.0)
    ingest.reinforce(held, "x", 1.0)
    assert held["x"] == (2.0, 1.0) and abs(ingest.retention(2.0, 1.0, 3.0) - 2.718281828459045**-1) < 1e-12
    terms = df.select(F.lit("root").alias("root"), F.col("event_type").alias("term"), "ts")
    terms.write.parquet(str(tmp_path / "t"))
    q = ingest.associations(spark.readStream.schema(terms.schema).parquet(str(tmp_path / "t"))).writeStream.outputMode("update").format("memory").queryName("assoc").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("select root, term, retention, count from assoc").collect()]
    assert got == [("root", "a", 1.0, 3)]
