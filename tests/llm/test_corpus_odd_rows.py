"""Every query on NULLs, blanks, one very long text and repeated rows; further columns, also those named like the operators' own, change nothing."""

import pytest
from conftest import LONG
from pyspark.sql import functions as F

from millwatch.llm.queries import QUERIES

CLASHES = (
    "id", "n", "key", "size", "shard", "slot", "score", "rank", "position", "line", "word", "words", "class", "component", "component_id", "kept", "grade", "severity",
    "n_words", "n_shingles", "n_links", "taken", "target", "key_", "match", "file", "offset", "length", "payload_digest", "refers_to", "url_key", "lang_pred", "held_out",
    "terms", "counts", "kind", "sketch", "lead", "column", "path", "form", "root", "_row", "_id", "_block", "_spot", "print")


@pytest.fixture(scope="module")
def tables(spark, docs, folder, corpus):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3]) for i, t in corpus if i % 4 == 0 or i in (70, 71, 73, 74, 75, 81)]
    rows += [(None, "no id at all", None, None), (None, None, None, None), rows[0], rows[0], (500, LONG + "Toxicword", "en", "a"), (501, "Toxicword " * 30, "fr", "b")]
    pages = [(1, "http://a.example/", LONG), (2, "http://b.example/", LONG), (3, None, None), (None, None, ""), (4, "", "x"), (1, "http://a.example/", LONG)]
    labels = [(i, 1, int((i or 0) % 8 == 0)) for i, *_ in rows] + [(None, None, None), (0, 1, 1), (0, 1, 1)]
    items = [(1, rows[0][1]), (1, rows[0][1]), (2, None), (3, ""), (None, "w1 w2"), (4, LONG)]
    narrow = {"documents": docs(rows), "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
              "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    wide = {}
    for name, df in narrow.items():
        own = {c.lower() for c in df.columns}
        wide[name] = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in own])
    return folder(**narrow), folder(**wide), len(rows), len(pages)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_and_further_columns(spark, tables, name):
    narrow, wide, documents, pages = tables
    one, two = QUERIES[name](spark, narrow), QUERIES[name](spark, wide)
    assert one.columns == two.columns and [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, two.collect()))
    if "doc_id" in one.columns and not name.startswith("op11"):
        assert len(rows) == documents
    elif "page_id" in one.columns:
        assert len(rows) == pages
    else:
        assert rows
