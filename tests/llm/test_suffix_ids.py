"""op3 where one id has many texts."""

from __future__ import annotations

import pytest

pytest.importorskip("ledgerlake.llm")

from pyspark.sql import functions as F

from ledgerlake.llm import suffix_dedup


def test_texts_of_one_id_with_equal_32_bit_hashes_stay_apart(spark):
    text = F.expr("concat_ws('', transform(sequence(1, 4 + id % 3), x -> md5(concat(id, '-', x))))")
    many = spark.range(300_000).select(text.alias("text"), F.length(text).alias("n"))
    pair = many.groupBy(F.hash("text")).agg(F.min(F.struct("n", "text")).alias("a"), F.max(F.struct("n", "text")).alias("b")).where("a.n < b.n").first()
    a, b = pair["a"]["text"], pair["b"]["text"]
    for i in (1, None):
        first = -5 if i else None  # a null id is earlier than all others: there the copy comes later
        rows = [(first, b, "first"), (i, a, "a"), (i, b, "b")] if i else [(i, a, "a"), (i, b, "b"), (3, b, "late")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
        got = {r["source"]: (r["n_bytes"], r["n_removed"], r["kept"]) for r in suffix_dedup.dedup(df, keep_text=True, carry=("source",)).collect()}
        gone, kept = (len(b), len(b), ""), (len(b), 0, b)
        want = {"a": (len(a), 0, a)} | ({"first": kept, "b": gone} if i else {"b": kept, "late": gone})
        assert got == want
