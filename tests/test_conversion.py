import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import model, models, trees
from pagemill.plans.conversion import FAMILIES, Conversion, Endpoint, convert, described, family_endpoint


def Layout():
    # made here, so that it goes to the workers by value
    class Answers:
        def predict(self, pages, mode):
            if mode == "image_description":
                return [f"about {p['category']}" for p in pages]
            if any(p["page_id"] == 2 for p in pages):
                raise TimeoutError("late")
            if mode == "ocr":
                return ["```html<h1>T</h1><p>x</p>```"] * len(pages)
            return [json.dumps([{"box": [500, 0, 600, 100], "text": "low"}, {"box": [0, 0, 100, 100], "text": "high", "category": "title"}])] * len(pages)

    return Answers()


def pages(spark):
    return spark.createDataFrame([(1, 200, 100), (2, 10, 10), (3, 100, 100)], "page_id long, width int, height int")


def test_layout_run(spark):
    got = {r.page_id: r for r in convert(pages(spark), Layout(), Conversion("ocr_layout")).collect()}
    assert [(i.text, i.l, i.t, i.r, i.b) for i in got[1]["items"]] == [("low", 0.0, 50.0, 20.0, 60.0), ("high", 0.0, 0.0, 20.0, 10.0)]
    assert got[1].text == "high\n\nlow" and got[1].error is None
    assert got[2].text is None and got[2].error == "TimeoutError: late" and got[3].text == "high\n\nlow"


def test_text_run_with_stages(spark):
    run = Conversion(before=(lambda df: df.where("page_id <> 2"),), after=(lambda df: df.withColumn("text", F.upper("text")),))
    assert {r.page_id: r.text for r in convert(pages(spark), Layout(), run).collect()} == {1: "# T\n\nX", 3: "# T\n\nX"}


def test_descriptions(spark):
    items = spark.createDataFrame([(1, 1, "chart", "old"), (1, 2, "text", "stays"), (2, 1, "Chart", "stays")], "page_id long, item_pos int, category string, text string")
    assert {(r.page_id, r.item_pos): r.text for r in described(items, Layout()).collect()} == {(1, 1): "about chart", (1, 2): "stays", (2, 1): "stays"}


def test_settings():
    for bad in ({"mode": "x"}, {"dpi": 10}, {"max_image_size": 5}):
        with pytest.raises(ValueError):
            Conversion(**bad)
    whole = Endpoint(model_name="m").over(Endpoint("http://x", "n", api_key="k"))
    assert (whole.base_url, whole.model_name) == ("http://x", "m") and "k" not in repr(whole).replace("max", "")


def test_providers_of_any_model():
    keys = {"OPENAI_API_KEY": "k", "AZURE_OPENAI_ENDPOINT": "https://own"}
    assert family_endpoint("openai", "m", environment=keys).api_key == "k" and family_endpoint("openai", "m", api_key="", environment=keys).api_key == ""
    assert family_endpoint("azure", "m", environment=keys).base_url == "https://own" and family_endpoint("azure", "m", "https://x", environment=keys).base_url == "https://x"
    assert family_endpoint("hf", "m", environment={}) == Endpoint(None, "m") and family_endpoint("google", "m", environment={}).base_url == FAMILIES["google"].base_url
    with pytest.raises(ValueError):
        family_endpoint("none", "m")


def test_registrations(spark):
    calls = spark.createDataFrame([("a", "x", "one", 1), ("a", None, "two", 2), ("a", "x", "three", 3)], "name string, provider string, model_name string, position long")
    assert {tuple(r) for r in models.registered(calls).collect()} == {("a", "x", "three", 1), ("a", "registry", "two", 2)}


def test_tree_has_no_row_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    nodes = spark.range(40).selectExpr("concat('n', id) AS node_id", "CASE WHEN id < 4 THEN 'top' ELSE concat('n', id % 4) END AS parent_id", "CAST(id AS INT) AS child_pos")
    got = [r.node_id for r in trees.ordered(nodes, "top").orderBy("path").collect()]
    assert len(got) == 40 and got[:3] == ["n0", "n4", "n8"] and got[-1] == "n39"


def test_nested_and_relational_forms(spark):
    box = {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0}
    page = {"text": None, "page_number": 4, "items": [{"category": "text", "box": box, "text": "a"}, {"category": "table", "box": box, "text": "b"}]}
    docs = spark.createDataFrame([{"file_path": "f", "pages": [page, {"text": "t", "error": {"module_class": "X", "traceback": "y"}}]}], model.DOCUMENT)
    flat = model.pages_of(docs)
    items = model.items_of(flat)
    assert [(r.page_pos, r.item_pos, r.text, r.b) for r in items.orderBy("item_pos").collect()] == [(0, 0, "a", 4.0), (0, 1, "b", 4.0)]
    back = model.documents_of(model.with_items(flat, items)).first()
    assert back.is_error and [[i.text for i in p["items"]] for p in back.pages] == [["a", "b"], []] and back.pages[0].page_number == 4
