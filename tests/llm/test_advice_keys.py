"""Copies of a text, and texts without words or id, go to different keys."""

import pyarrow as pa

from strata.llm import jaccard_join, substring_dedup

TEXTS = ["one two three four five six seven"] * 20 + [None] * 10 + [""] * 10
IDS = [*range(15), *[None] * 5, *range(100, 115), *[None] * 5]


def batches():
    yield from pa.table({"id": pa.array(IDS, pa.int64()), "text": pa.array(TEXTS, pa.string()), "text_hash": pa.array([7] * len(IDS), pa.int64())}).to_batches(max_chunksize=9)


def keys(run, size):
    return [r["key"] for b in run(batches()) for r in b.to_pylist() if r["aux"] is not None and len(r["aux"]) == size]


def test_text_rows_are_dealt_apart():
    for found in (keys(jaccard_join._sketch(5, jaccard_join.Rule(80, 100)), 24), keys(substring_dedup._anchors(20), 48)):
        assert len(found) == len(set(found)) == len(TEXTS)
