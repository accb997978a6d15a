"""Exact deduplication decides row by row, not id by id."""

from collections import Counter

from quillgrid.llm import exact


def test_null_and_repeated_ids_keep_their_unique_texts(spark):
    rows = [(None, "one"), (None, "two"), (None, "TWO"), (None, "three"), (9, "Three"), (None, None), (5, "four"), (5, "five"), (8, "Four"), (6, "six"), (6, "SIX"), (6, "seven"), (None, "eight"), (7, "")]
    got = exact.exact_dedup(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")).collect()
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in got) == Counter([(None, "one"), (None, "two"), (9, "three"), (5, "five"), (8, "four"), (6, "six"), (6, "seven"), (None, "eight"), (7, "")])
