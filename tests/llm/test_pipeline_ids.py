"""The pipeline's stages where ids are null or repeat."""

from __future__ import annotations

import pytest

pytest.importorskip("ledgerlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerlake.llm.common import materialise

from .test_operators import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return materialise(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3), "test_ids")[0]


def test_near_copies_tell_rows_of_one_id_apart(spark):
    a, b, c, d = (prose(k, 200) for k in (11, 12, 13, 14))
    rows = [(None, a), (None, a + " end"), (None, b), (None, c), (7, c + " end"), (8, d), (8, a.upper()), (8, b[:300]), (8, b[:300])]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()), key=str)
    assert got == sorted([(8, a.upper()), (None, b), (7, c + " end"), (8, d), (8, b[:300])], key=str)


def test_a_contaminated_row_takes_no_other_of_its_id(spark, sf):
    item = max((r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    rows = [(None, prose(21, 50) + " " + item), (None, prose(22, 50)), (None, prose(23, 50)), (5, item), (5, prose(24, 50)), (6, prose(25, 50))]
    got = sorted(r["text"] for r in corpus_pipeline.benchmark_passages(spark, table(spark, rows), sf).collect())
    assert got == sorted(t for _, t in rows if item not in t)
