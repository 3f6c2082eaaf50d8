import json

from pyspark.sql import functions as F

from fathomline.operators import structured as S


def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")


def json_lines(spark, texts, **more):
    out = {}
    for r in S.json_lines(docs(spark, texts), **more).orderBy("doc_id", "line_no").collect():
        out.setdefault(r.doc_id, []).append((r.section, r.line))
    return out


def test_json_roots_and_nesting(spark):
    nested = {"b": 1, "a": {"z": "x\n  y", "k": {"q": None, "t": True}}, "tags": ["u", "v", 3.5], "mix": [1, {"a": 2}, [], [7, 8]], "s": '{"not": [1]}', "e": {}, "n": []}
    got = json_lines(spark, [json.dumps(nested), '[1, "two", {"x": [1, 2]}, [3]]', '"plain [1]"', "42", "null", "{bad", "", None, "[]", '{"a": 1, "a": 2}', json.dumps({"é › k": {"日": "😀"}})])
    assert [line for _, line in got[0]] == ["b: 1", "a › z: x y", "a › k › q: null", "a › k › t: true", "tags: u, v, 3.5", "mix [1]: 1", "mix [2] › a: 2", "mix [4]: 7, 8", 's: {"not": [1]}']
    assert [s for s, _ in got[0]][:4] == ["b", "a", "a", "a"]
    assert got[1] == [("Item 1", "Item 1: 1"), ("Item 2", "Item 2: two"), ("Item 3", "Item 3 › x: 1, 2"), ("Item 4", "Item 4: 3")]
    assert got[2] == [("Value", "Value: plain [1]")] and got[3] == [("Value", "Value: 42")] and got[4] == [("Value", "Value: null")] and got[10] == [("é › k", "é › k › 日: 😀")]
    assert not {5, 6, 7, 8, 9} & set(got)


def test_json_long_lists_and_depth(spark):
    got = json_lines(spark, [json.dumps({"l": list(range(51)), "m": list(range(50))}), "[" * 12 + "1" + "]" * 12], depth=4)
    assert len(got[0]) == 52 and got[0][50][1] == "l [51]: 50" and got[0][51][1].startswith("m: 0, 1, 2")
    assert got[1] == [("Item 1", "Item 1 [1] [1] [1] [1]: " + "[" * 7 + "1" + "]" * 7)]
    assert json_lines(spark, ["x"]) == {}


def test_json_problem_and_nesting(spark):
    rows = docs(spark, ['{"a": "[["}', "[[{}]]", "{", None]).select(S.problem(F.col("text"), "json").alias("p"), S.nesting(F.coalesce("text", F.lit(""))).alias("n")).collect()
    assert [(r.p is None, r.n) for r in rows] == [(True, 1), (True, 3), (False, 1), (False, 0)]


def test_xml(spark):
    texts = [
        '<?xml version="1.0"?><a t="1>2"><b>Hi &amp;  &#x65E5;&#128512; &lt;b&gt;</b><!-- no <c> --><![CDATA[x < y &amp; <z>\nline2]]>tail<d/></a>',
        "<!DOCTYPE a><a>x</a>", "<a><!ENTITY x 'y'>x</a>", "&amp;lt; &#0; &#xFFFFFF; &#38;amp; &unknown;", None, "<a></a>", "<a>" + "<b>t</b>" * 20_000 + "</a>",
    ]
    got = {}
    for r in S.xml_lines(docs(spark, texts)).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got.pop(6) == ["t"] * 20_000
    assert got == {0: ["Hi & 日😀 <b>", "x < y &amp; <z>", "line2", "tail"], 3: ["&lt; &#0; &#xFFFFFF; &amp; &unknown;"]}
    assert [r[0] for r in docs(spark, texts[:2] + ["plain"]).select(S.problem(F.col("text"), "xml")).collect()] == [None, "declares a document type or entities", "no element"]


def test_notebooks(spark):
    book = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "text \n"]}, {"cell_type": "code", "source": "a = 1\n```\n", "outputs": [1]}, {"cell_type": "raw", "source": "r"}, {"cell_type": "code", "source": []}, None, {"cell_type": "code", "source": 7}, {"cell_type": "code"}]}
    texts = [json.dumps(book | {"metadata": {"kernelspec": {"language": "not one", "name": "x"}, "language_info": {"name": "R"}}}), json.dumps(book), '{"x": 1}', "bad", None, '{"cells": []}', json.dumps({"cells": [{"cell_type": "markdown", "source": "y" * 100_001}]})]
    got = {r.doc_id: r.text for r in S.notebook_markdown(docs(spark, texts)).collect()}
    assert got[0] == "# T\ntext\n\n````R\na = 1\n```\n````" and got[1] == got[0].replace("R", "") and len(got[6]) == 100_000 and set(got) == {0, 1, 6}
    assert [r[0] for r in docs(spark, texts).select(S.problem(F.col("text"), "ipynb")).collect()] == [None, None, "no cells", "no cells", "no cells", None, None]


def test_underlined_headings(spark):
    from fathomline.sources import files

    text = "intro\nTitle\n=====\nbody\n```\nno\n===\n```\nRule\n---\n\n===\nLast\n=\n# ATX #\nend"
    got = [(r.section, r.text.split("\n")[0]) for r in files.markdown(spark.createDataFrame([("f", text)], "name string, text string")).orderBy("ordinal").collect()]
    assert got == [("", "intro"), ("Title", "Title"), ("Last", "Last"), ("ATX", "# ATX #")]
