"""Graph files, replies and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import extract as E
from loomgraph.sources import graph_json as J
from loomgraph.streaming import turns as S


def test_graph_round_trip(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"id": "a", "label": "A"}, {"id": "b", "label": "B", "kind": "file", "stale": True, "facts": [{"fact": "x"}]}]))
    (tmp_path / "e.json").write_text(json.dumps([{"source": "a", "target": "b", "relation": "uses", "weight": 1.0}]))
    n, e = J.load(spark, str(tmp_path / "n.json"), str(tmp_path / "e.json"))
    assert {r["id"]: (r["kind"], r["stale"], r["files"]) for r in n.collect()} == {"a": ("entity", False, []), "b": ("file", True, [])}
    at = J.save(n, e, str(tmp_path), 1)
    assert spark.read.parquet(f"{at}/nodes").count() == 2 and spark.read.parquet(f"{at}/edges").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"x\r\ny\n")
    (tmp_path / "src/b.PY").write_bytes(b"x")
    (tmp_path / "skip/c.py").write_bytes(b"x")
    got = J.texts(J.files(spark, str(tmp_path), [".py"], ["skip"])).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["text"], r["total_lines"]) for r in got] == [("a.py", "x\ny\n", 3)]


@pytest.mark.parametrize("text,want", [('so {"a": 1} and {"b": 2}', '{"a": 1}'), ("{bad} {\"a\": {\"b\": 2}}", None), ('{"a": [1]\n "b": {}\n"c": 2}', '{"a": [1], "b": {}, "c": 2}'), ("none", None), (None, None), ("{", None)])
def test_first_json(text, want):
    assert E.first_json(text) == want


def test_json_object_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, 'x {"a": 1}'), (2, None)], "i int, reply string")
    assert [tuple(r) for r in E.json_object(df, "reply").orderBy("i").collect()] == [(1, 'x {"a": 1}', '{"a": 1}'), (2, None, None)]


def test_relations_and_facts(spark):
    df = spark.createDataFrame([(["a"], [("a", "b", "r"), ("c", "d", "r"), ("b", "a", "r"), ("a", "z", "r")], [("a", "short"), ("a", "long enough"), ("q", "long enough")])], "e array<string>, r array<struct<source:string,target:string,relation:string>>, f array<struct<entity:string,fact:string>>")
    r = df.select(E.valid_relations(F.col("r"), F.col("e")).alias("r"), E.valid_facts(F.col("f"), F.col("e")).alias("f")).first()
    assert [(x["source"], x["target"]) for x in r["r"]] == [("a", "b"), ("b", "a")] and [x["fact"] for x in r["f"]] == ["long enough"]


def test_replies_accumulate(spark, tmp_path):
    rows = [(1, 0, "he", False), (2, 0, "x", False), (1, 2, "o", True), (1, 1, "ll", False)]
    spark.createDataFrame(rows, "response_id long, seq int, piece string, done boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("response_id long, seq int, piece string, done boolean").parquet(str(tmp_path / "in"))
    q = S.accumulate_replies(stream).writeStream.format("memory").queryName("replies").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from replies").collect()] == [(1, "hello")]
