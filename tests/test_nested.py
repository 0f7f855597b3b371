import json

from pyspark.sql import functions as F

from rillstone.operators import nested

DOC = [{"uuid": "u1", "text": {"value": "v"}, "content": [{"type": "text", "text": "a"}, "bare", {"type": "box", "content": [{"type": "text", "text": " "}, {"type": "text", "text": "b", "content": []}]}, {"type": "text", "text": 5}]}, {"uuid": None, "content": None}, 3]


def test_paths_and_tables(spark):
    df = spark.createDataFrame([("d1", json.dumps(DOC)), ("d1", json.dumps(DOC)), ("d2", "{bad"), ("d3", None), (None, "[]")], "doc string, j string")
    long = nested.shred(df, "doc", "j", "msg", "uuid")
    got = {(r["parent_key"], r["anchored_path"]) for r in long.filter((F.col("element") == "content") & nested.non_blank_string(F.element_at("cells", "text"))).collect()}
    assert got == {("u1", "0"), ("u1", "2.1")}
    tables = nested.flat_tables(df, "doc", "j", "msg", "uuid")
    assert set(tables) == {"msg", "content"}
    assert tables["msg"].count() == 4 and "text_value" in tables["msg"].columns
    parents = tables["msg"].select("doc_key", F.col("path").alias("parent_path"))
    top = tables["content"].filter("parent_element = 'msg'")
    assert top.join(parents, ["doc_key", "parent_path"], "left_anti").count() == 0


def test_shared_and_recursive():
    g = nested.SchemaGraph("r", {("r", "a", "object"), ("r", "b", "object"), ("a", "x", "object"), ("b", "x", "object"), ("x", "v", "scalar"), ("b", "n", "object"), ("n", "n", "object"), ("r", "l", "objects")})
    assert g.tables() == {"r", "x", "n", "l"}


def test_object_in_place_of_array_has_no_position(spark):
    df = spark.createDataFrame([("d", json.dumps([{"uuid": "u", "content": {"type": "text", "text": "a"}}, {"uuid": "w", "content": [{"type": "text", "text": "a"}]}]))], "doc string, j string")
    got = {r["anchored_path"] for r in nested.shred(df, "doc", "j", "msg", "uuid").filter("element = 'content'").collect()}
    assert got == {"content", "0"}


def test_empty_and_long(spark):
    assert nested.shred(spark.createDataFrame([], "doc string, j string"), "doc", "j", "m").count() == 0
    big = json.dumps([{"uuid": "u", "content": [{"type": "text", "text": "x" * 1_000_000}] * 3}])
    assert nested.shred(spark.createDataFrame([("d", big)], "doc string, j string"), "doc", "j", "m", "uuid").count() == 4


def test_blank_strings(spark):
    cells = ['"a"', '" "', '""', "5", "null", '"\\u00a0\\n"', '"\\"x"', None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(nested.non_blank_string(F.col("c"))).collect()] == [True, False, False, False, False, False, True, False]
