"""op7's store after vacuum: what is folded stays known, and nothing lists single batches."""

from __future__ import annotations

import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import token_rollup
from ledgerlake.llm.common import _fs, exists, new_path


def test_vacuum_folds_commits_and_keeps_their_ids(spark):
    store = new_path(spark, "rollup_store")
    batch = lambda n: spark.createDataFrame([("s", "en", "v", n, 1)], "source string, lang string, version string, n_tokens long, sign int")
    now = lambda: [(r["docs"], r["tokens"]) for r in token_rollup.totals(spark, store).collect()]
    token_rollup.vacuum(spark, store)  # of an empty store
    assert now() == []
    for n in (1, 2, 3):
        assert token_rollup.commit(spark, store, f"b{n}", batch(n))
    fs, p = _fs(spark, f"{store}/commits/b2")
    stream = fs.open(p)
    folder = bytes(stream.readAllBytes()).decode()
    stream.close()
    token_rollup.vacuum(spark, store)
    assert now() == [(3, 6)] and not exists(spark, f"{store}/data") and not exists(spark, f"{store}/commits")
    assert len(token_rollup._snapshots(spark, store)) == len(token_rollup._children(spark, f"{store}/folded")) == 1
    assert not token_rollup.commit(spark, store, "b2", batch(2)) and now() == [(3, 6)]  # a replay of a folded batch
    # an interrupted vacuum: a folded batch's commit and data are still there
    token_rollup.deltas(batch(2)).write.parquet(f"{store}/data/{folder}")
    assert token_rollup._create(spark, f"{store}/commits/b2", folder) and now() == [(3, 6)]
    assert token_rollup.commit(spark, store, "b4", batch(4)) and now() == [(4, 10)]
    assert token_rollup.compact(spark, store) and now() == [(4, 10)]
    token_rollup.vacuum(spark, store)
    assert now() == [(4, 10)] and not any(token_rollup.commit(spark, store, f"b{n}", batch(n)) for n in (1, 2, 3, 4)) and now() == [(4, 10)]
