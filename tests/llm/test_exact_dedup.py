import hashlib
import re

import pytest

from strataspark.llm import exact_dedup as X

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("bits", [None, 1 << 15])
def test_query_against_brute_force(spark, sf, monkeypatch, bits):
    if bits:  # a filter that lets many rows through
        monkeypatch.setattr(X, "FILTER_MAX_BITS", bits)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.op3_exact_dedup(spark, sf).collect()}
    assert got == plain(texts)


def test_odd_rows(spark, odd, none):
    rows = X.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == by[2].keep_id == by[None].keep_id == 1 and by[1].group_size == 3
    assert by[3].keep_id == by[4].keep_id == 3 and by[5].group_size == 2
    kept = X.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8]
    assert X.exact_groups(none).count() == 0 and X.drop_exact_copies(none).count() == 0
