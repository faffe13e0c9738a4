"""Folds over facts, entity upsert, prose clusters, Python units."""

from loomgraph.operators import facts as O


def test_distinct_facts(spark):
    rows = [(1, "The dog barks loudly at night", 1), (1, "dog barks loudly", 2), (1, "Dog barks loudly at night!", 3), (1, "The cat sleeps", 4), (2, "The cat sleeps", 1)]
    df = spark.createDataFrame(rows, "node_id long, fact string, seq long")
    assert sorted((r["node_id"], r["seq"]) for r in O.distinct_facts(df).collect()) == [(1, 1), (1, 4), (2, 1)]


def test_upsert(spark):
    none = []
    n = spark.createDataFrame([("a", "A", "Person", "complete", "t0", "t0", 1, none), ("b", "B", "Place", "complete", "t0", "t0", 2, none), ("e", "E", "Place", "complete", "t0", "t0", 2, none)], "id string, label string, type string, status string, created_at string, last_active string, session_count int, pending array<string>")
    d = spark.createDataFrame([("a", "other", "Place", 1), ("c", "Zed", "Odd", 2), ("c", "Abe", "Person", 3), ("d", "Zed", "Person", 4), ("d", "Abe", "Place", 5), ("e", "E", "Place", 6)], "id string, label string, type string, seq long")
    got = {r["id"]: tuple(r)[1:-1] for r in O.upsert_entities(n, d, "t1", ["Person", "Place"], spark.createDataFrame([("e",)], "id string")).collect()}
    assert got == {"a": ("A", "Person", "complete", "t0", "t1", 2), "b": ("B", "Place", "complete", "t0", "t0", 2), "c": ("Zed", "Unknown", "incomplete", "t1", "t1", 2), "d": ("Zed", "Person", "complete", "t1", "t1", 2), "e": ("E", "Place", "complete", "t0", "t1", 2)}


def test_prose(spark):
    text = "a" * 900 + "\n\n" + "b" * 900 + "\n \n" + "c" * 900 + "\n\n\n" + "d" * 2500
    got = [len(r["content"]) for r in O.prose_clusters(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("chunk_index").collect()]
    assert got == [1802, 900, 2500]


def test_python_units(spark):
    code = "import os\n\n@deco\ndef f():\n    def inner(): pass\n\nclass Dog:\n    def bark(self):\n        pass\n    async def run(self): pass\n"
    got = [tuple(r)[1:5] for r in O.python_units(spark.createDataFrame([("x.py", code), ("y.py", "def (")], "path string, text string")).collect()]
    assert got == [("function", "f", None, 3), ("class", "Dog", None, 7), ("method", "bark", "Dog", 8), ("method", "run", "Dog", 10)]
