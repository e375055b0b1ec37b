import random
import re

import pytest
import xxhash

from strataspark.llm import simhash as S


def plain(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(prints):
    """{id: smallest id reachable} over links of at most 4 bits."""
    label = {i: i for i in prints}
    items = list(prints.items())
    pairs = [(a, b) for x, (a, f) in enumerate(items) for b, g in items[x + 1 :] if (f ^ g).bit_count() <= 4]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    want = brute(prints)
    got = {r.doc_id: r for r in S.op2_simhash_near_dedup(spark, sf).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("rows", [1 << 18, 60])
def test_links_of_planted_fingerprints(spark, monkeypatch, rows):
    """Also with cells that are divided."""
    monkeypatch.setattr(S, "CELL_ROWS", rows)
    monkeypatch.setattr(S, "BLOCK", 1 << 12)
    rng = random.Random(5)
    prints, at = {}, 0
    for _ in range(40):
        base = rng.getrandbits(64)
        for flips in range(7):
            prints[at] = base ^ sum(1 << b for b in rng.sample(range(64), flips))
            at += 1
    for _ in range(200):  # one dense group
        prints[at] = 0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        at += 1
    distinct = {}
    for i, f in prints.items():
        distinct.setdefault(f, i)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for f, i in distinct.items()], "id long, fp long")
    parts = S.connected_components(S.links(df, len(distinct)), len(distinct))
    got = {r.node: r.component for r in parts.collect()}
    want = brute({i: f for f, i in distinct.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_odd_rows(spark, odd, none):
    rows = S.near_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == by[None].component_id == 1
    assert by[3].fp == by[4].fp == by[5].fp == 0 and {by[k].component_id for k in (3, 4, 5)} == {3}
    kept = S.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 7, 8]
    assert S.near_components(none).count() == 0 and S.drop_near_copies(none).count() == 0
