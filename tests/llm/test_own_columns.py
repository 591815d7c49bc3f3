"""Stages that return documents keep columns named like the operators' own."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pytest.importorskip("tidemark.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm.common import n_words  # noqa: E402
from tidemark.llm.decontaminate import decontaminated  # noqa: E402
from tidemark.llm.mixing import mix_sources, mixed_documents  # noqa: E402

COLS = "doc_id long, text string, lang string, source string, n_words long, n_hit string, _h int, size int, Taken string, _rank double, occ int"


def test_clashing_columns(spark):
    passage = " ".join(f"b{i}" for i in range(20))
    rows = [(i, text, "en", source, 77 + i, "x", i, -i, "t", 0.5, None) for i, (text, source) in enumerate(
        [("one two three", "a"), (passage, "a"), (None, None), ("", "b"), ("four five six seven", "b"), ("four five six seven", "b")])]
    docs = spark.createDataFrame(rows, COLS)
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    got = decontaminated(docs, bench)
    assert got.schema.names == docs.schema.names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if r[1] != passage)
    size = n_words(F.col("text"))
    copies = {r.doc_id: r.copies for r in mix_sources(docs.select("doc_id", "text", "lang", "source"), size).collect()}
    out = mixed_documents(docs, size)
    assert out.schema.names == docs.schema.names
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for r in rows for _ in range(copies[r[0]]))
    none = docs.limit(0)
    assert decontaminated(none, bench).count() == 0 and mixed_documents(none, size).count() == 0
