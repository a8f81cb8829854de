"""Winnowing: what is selected, and that every shared span is found by it alone."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import decontaminate
from ledgerlake.llm.common import chunks

from . import brute


def hashed(texts):
    (_, _, bounds, data), = chunks(pa.array(texts))
    return decontaminate.words(bounds, data)


@pytest.mark.parametrize("length", [1, 2, 4, 5, 6, 9, 10])
def test_every_window_has_a_selected_place(length):
    r = random.Random(length)
    texts = [" ".join(r.choice("abcde") for _ in range(r.choice([0, 1, length - 1, length, 60]))) for _ in range(40)]
    h, first = hashed(texts)
    place, text, low = decontaminate.selected(h, first, length)
    k = min(decontaminate.GRAM, length)
    for t in range(len(texts)):
        mine = place[text == t]
        assert ((mine >= first[t]) & (mine + k <= first[t + 1])).all()
        for a in range(first[t], first[t + 1] - length + 1):
            assert ((mine >= a) & (mine <= a + length - k)).any()
    assert len(set(place.tolist())) == len(place) and len(low) == len(place)


def test_about_two_of_seven_places_are_selected():
    h, first = np.random.default_rng(1).integers(1, 2**63, 20_000).astype(np.uint64), np.array([0, 20_000])
    place, _, _ = decontaminate.selected(h, first, 10)
    assert 0.27 < len(place) / len(h) < 0.30


def test_shared_spans_of_any_place_and_length(spark):
    """Few different words, so that fingerprints meet in many wrong surroundings and spans overlap, repeat and touch the ends."""
    r = random.Random(11)
    text = lambda n, letters: " ".join(r.choice(letters) for _ in range(n))
    items = [(i % 9 if i % 5 else None, text(r.choice([1, 3, 4, 5, 8, 9, 10, 11, 14, 25]), "ab" if i % 2 else "abcdef")) for i in range(40)]
    docs = [(i, text(r.choice([0, 1, 9, 10, 40]), "abcdefgh" if i % 3 else "ab") + " " + r.choice(items)[1] + " " + text(r.choice([0, 3, 30]), "xyz")) for i in range(60)]
    want = brute.decontaminate(docs, items)
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    found = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in got.collect()}
    assert found == {d: want[n] for n, (d, _) in enumerate(docs)}


def test_nothing_is_found_without_its_fingerprint(spark):
    """The join has no other key: with the fingerprints of the items changed, no hit is left."""
    docs = spark.createDataFrame([(1, " ".join("abcdefghijklmn"))], "doc_id long, text string").selectExpr("1L row", "doc_id", "text")
    items = decontaminate.item_places(spark.createDataFrame([(1, " ".join("bcdefghijklm"))], "item_id long, text string"))
    windows, _ = decontaminate.item_sets(items)
    found = decontaminate.candidates(docs, items).where("start is not null").select("row", "start", *decontaminate.KEY)
    assert decontaminate.extended(found, items, windows).count() == 3
    assert decontaminate.extended(found, items.selectExpr("size", "fingerprint + 1 as fingerprint"), windows).count() == 0
