"""Structure, activation, curation, books, settings and streams against small fixtures and brute force."""

import io
import zipfile

from loomgraph.operators import activation as A
from loomgraph.operators import curation as U
from loomgraph.operators import structure as ST
from loomgraph.sources import books as B
from loomgraph.sources import settings as SE
from loomgraph.streaming import turns as S


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(texts)], "path string, text string")


def test_html(spark):
    got = sorted(tuple(r)[1:] for r in ST.html_elements(files(spark, "<app-a></app-a>\n<app-a/> <Card >\n<p id='x'><b id=\"x\">", None)).collect())
    assert got == [("component_ref", "Card", 2), ("component_ref", "app-a", 1), ("html_id", "x", 3), ("html_id", "x", 3)]


def test_text_sections(spark):
    text = "Title\na\n\n\nb\n" + "\n".join(["x"] * 50)
    got = [tuple(r)[2:] for r in ST.text_sections(files(spark, text, "", None, "\n\n\n")).collect()]
    assert got == [("Title", None, 1, 4), ("b", None, 5, 54), ("x", None, 55, 55), ("Section 1", None, 1, 3)]


def test_js(spark):
    code = "/* class No {\n*/\nexport default class A extends B {\n  static async go(x: number): void {\n  }\n}\ninterface I {\n}\nasync function h() { return 1; }\nfunction open() {\n"
    got = [tuple(r)[1:] for r in ST.js_units(files(spark, code)).collect()]
    assert got == [("method", "go", "A", 4, 5), ("class", "A", None, 3, 6), ("interface", "I", None, 7, 8), ("function", "h", None, 9, 9), ("function", "open", None, 10, 11)]


def test_containing_is_brute_force(spark):
    texts = ["the customer#000001 called", "abc", "", None, "Big BLUE widget and blue", "xyzabc"]
    labels = ["Customer#000001", "blue", "ab", "abc", "widget", "zabc", "Big Blue Widget"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    n = spark.createDataFrame(list(enumerate(labels)), "id int, label string")
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(labels) if x and len(y) >= 3 and y.lower() in x.lower())
    assert sorted(map(tuple, A.containing(t, n).collect())) == want


def test_batches(spark):
    paths = [f"a/{i}" for i in range(4)] + [f"b/{i}" for i in range(7)] + ["c/0", "d", "e/0"]
    got = {r["path"]: r["batch"] for r in U.batches(spark.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "path string, seq long")).collect()}
    assert [got[p] for p in paths] == [0] * 4 + [1] * 7 + [1, 1, 1]


def test_merges_in_order(spark):
    n = spark.createDataFrame([(x, x, "T", {"k": x}) for x in "abcd"], "id string, label string, type string, attributes map<string,string>")
    m = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("d", "q", 4), ("d", "d", 5)], "from_id string, into_id string, seq long")
    assert sorted(map(tuple, U.valid_merges(m, n).collect())) == [("a", "c"), ("b", "c")]


def test_long_chain_of_merges(spark):
    n = spark.createDataFrame([(i, str(i), "T", {f"k{i}": "v"}) for i in range(101)], "id long, label string, type string, attributes map<string,string>")
    e = spark.createDataFrame([(0, 50, "r", 1.0, 0)], "source long, target long, relation string, weight double, seq long")
    f = spark.createDataFrame([(0, "f", "user", 0)], "node_id long, fact string, source string, seq long")
    m = spark.createDataFrame([(i, i + 1, i) for i in range(100)], "from_id long, into_id long, seq long")
    nodes, edges, facts = U.apply_merges(n, e, f, m)
    assert [(r["id"], len(r["attributes"])) for r in nodes.collect()] == [(100, 101)]
    assert [r[:2] for r in edges.collect()] == [(100, 100)] and [r["node_id"] for r in facts.collect()] == [100]


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>')
        z.writestr("o/b.opf", '<package xmlns="p"><manifest><item id="1" href="x.html"/><item id="2" href="y.html"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></package>')
        z.writestr("o/x.html", "<html><title>t</title><body><p>short</p></body></html>")
        z.writestr("o/y.html", "<html><body><h1>One</h1><p>" + "word " * 20 + "</p><h2>Sub</h2><p>more</p></body></html>")
    return out.getvalue()


def test_epub(spark):
    df = spark.createDataFrame([("b.epub", epub()), ("bad.epub", b"x")], "path string, content binary")
    got = [(r["path"], r["name"], r["parent"], r["start_line"]) for r in B.epub_sections(df).collect()]
    assert got == [("b.epub", "One", None, 1), ("b.epub", "Sub", "One", 4), ("bad.epub", None, None, None)]


def test_pages(spark):
    df = spark.createDataFrame([("a", 1, "\nTop\nx"), ("a", 2, " "), ("a", 3, "y")], "path string, page int, text string")
    assert sorted(tuple(r)[1:] for r in B.page_sections(df).collect()) == [("Top", 1, 3), ("y", 4, 4)]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[a]\nn = 3\n")
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions":{"baseUrl":".","paths":{"@/*":["src/*"]}}}')
    sub = tmp_path / "x"
    sub.mkdir()
    got = SE.load(SE.find(str(sub), "c.toml"), {"a": {"n": 1, "on": False, "s": "q"}}, "LG", {"LG_A_ON": "true", "LG_A_S": "z"})
    assert got == {"a": {"n": 3, "on": True, "s": "z"}}
    assert SE.path_aliases(str(tmp_path)) == {"@/": "src/"}


def test_traces(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"session":"s","turn":1,"elapsed_ms":2.0,"tokens":5}\n{"session":"s","turn":2,"elapsed_ms":4.0,"tokens":6}\n')
    assert [tuple(r) for r in SE.trace_summary(SE.traces(spark, str(tmp_path))).collect()] == [("s", 2, 3.0, 11)]


def test_topic_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b"), (2, 0, None)], "conv_id long, turn long, topic string").coalesce(1).write.parquet(src)
    q = S.topic_state(spark.readStream.schema("conv_id long, turn long, topic string").parquet(src)).writeStream.format("memory").queryName("topics").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("topics").collect()), key=str) == [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, None)]
