"""Golden cases of single operators."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import chunks as C
from loomgraph.operators import graph as G
from loomgraph.operators import rank as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,want", [("Straße", "strae"), ("Café del Mar", "cafe_del_mar"), ("__a--b__", "a_b"), ("", ""), ("Žižek", "zizek"), ("Łódź ﬁ", "odz_fi"), ("Kőrösi", "korosi"), ("𝐀½ x℃", "12_x")])
def test_make_id(spark, text, want):
    assert one(spark, text, X.make_id) == want


@pytest.mark.parametrize("text,want", [("", 1), ("one", 1), ("one two three four", 5)])
def test_count_tokens(spark, text, want):
    assert one(spark, text, X.count_tokens) == want


def test_markdown(spark):
    md = "# Overview\n\nx\n\n## Installation\n\na\n\n### Prerequisites\n\nb\n\n## Usage\nc"
    blank = C.markdown_sections(spark.createDataFrame([("f", "# A\ntext\n\n\n# B\nx\n\n")], "path string, text string")).collect()
    assert {r["name"]: r["end_line"] for r in blank} == {"A": 2, "B": 6}
    got = {r["name"]: (r["start_line"], r["parent"]) for r in C.markdown_sections(spark.createDataFrame([("f", md)], "path string, text string")).collect()}
    assert got == {"Overview": (1, None), "Installation": (5, "Overview"), "Prerequisites": (9, "Installation"), "Usage": (13, "Overview")}


def test_one_edge_per_pair(spark):
    e = spark.createDataFrame([("a", "b", "uses", 1.0, 1), ("b", "a", "maintains", 1.0, 2), ("a", "a", "is", 1.0, 3)], "source string, target string, relation string, weight double, seq long")
    assert [tuple(r)[:3] for r in G.one_per_pair(e).collect()] == [("b", "a", "maintains")]


def test_budget_skips_what_overflows(spark):
    items = spark.createDataFrame([(1, 10, 3.0, 90, 1), (1, 11, 2.0, 50, 2), (1, 12, 1.0, 10, 3)], "group_id long, item_id long, score double, tokens long, seq long")
    r = R.select_in_budget(items, 100).first()
    assert (r["used"], r["item_ids"]) == (100, [10, 12])
