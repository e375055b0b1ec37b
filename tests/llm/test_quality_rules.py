import math
import re
from collections import Counter

import pytest

from strataspark.llm import quality_rules as Q

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), n < 20 or 100 * len(inside) > 30 * n)


def test_counts_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op1_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS[1:]) for r in got} == {i: plain(t) for i, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("text", ["", " ", "a b " * 300, "x\ny\nx\n \n \nx", "ä b c d e f g h i ä b c d e f g h i", "a b c d e f g h " * 2, "w " * 9])
def test_counts_of_odd_texts(text):
    assert Q.counts_of(text.encode()) == plain(text)[:5]


def test_binomial_bounds():
    assert Q.binomial_tail(0, 100, 0.03) == pytest.approx(0.97**100)
    assert Q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert Q.upper_bound(5, 5, 0.05) == 1.0 and Q.binomial_tail(3, 3, 0.1) == 1.0


def test_certified_cutoffs_hold_and_reject(spark):
    good = " ".join(f"word{k}" for k in range(60))
    text = lambda i: f"{good} own{i}" + (" %% ## &&" * (i % 3 == 0 and i % 2))
    bad = " ".join(f"x{k}%$#*" for k in range(40))
    docs = [(i, text(i), "en") for i in range(3000)] + [(5000 + i, f"{bad} y{i}", "en") for i in range(300)] + [(9000 + i, f"{bad} z{i}", "xx") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)] + [(5000 + i, 0, 0) for i in range(60)] + [(9000, 1, 0)], "doc_id long, quality int, toxic int")
    rows, cutoffs = Q.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels)
    kept = {r.doc_id: r.kept for r in rows.collect()}
    found = {r.stratum: r for r in cutoffs.collect()}
    assert sum(not kept[i] for i in range(1000)) <= Q.RISK * 1000 and not any(kept[5000 + i] for i in range(300))
    assert all(kept[9000 + i] for i in range(5)), "a stratum with one label certifies nothing"
    assert set(found) == {"en"} and found["en"].bound <= Q.RISK and found["en"].good == 1000


def test_a_stratum_of_300_labels_is_certified(spark):
    """Copies of one text are one observation: 300 distinct good texts do, 300 copies of one don't."""
    words = lambda i: " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(50))
    junk = lambda i: words(i) + "".join(f" #$%&*{i + k}" for k in range(40))
    docs = [(i, words(i), "aa") for i in range(300)] + [(1000 + i, words(7), "bb") for i in range(300)]
    docs += [(2000 + i, junk(i), ("aa", "bb")[i % 2]) for i in range(200)] + [(3000 + i, words(5000 + i), ("aa", "bb")[i % 2]) for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in [*range(300), *range(1000, 1300)]] + [(2000 + i, 0) for i in range(60)], "doc_id long, quality int")
    rows, cutoffs = Q.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels)
    assert [(r.stratum, r.good, r.rejected) for r in cutoffs.collect()] == [("aa", 300, 0)]
    kept = {r.doc_id: r.kept for r in rows.collect()}
    assert not any(kept[2000 + i] for i in range(0, 200, 2)) and all(kept[2000 + i] for i in range(1, 200, 2))


def plain_verdicts(docs, labels, risk, delta):
    """{id: kept} by the definitions, one document at a time."""
    label: dict = {}
    for i, q in labels:
        label[i] = min(q, label.get(i, 1))
    rows = {}
    for i, text, lang in docs:
        n, chars, symbols, dups, repeats, failed = plain(text)
        w = max(n, 1)
        raw = (min(1, symbols / w), repeats / w, min(1, 5 * dups / w), max(0, min(1, (chars / w - 8) / 16)), min(1, 20 / w))
        rows[i] = (lang or "", text or "", failed, [math.ceil(round(x * Q.GRID, 6)) for x in raw], label.get(i))
    passed = [r for r in rows.values() if not r[2]]
    cuts = {}
    for stratum in {r[0] for r in passed if r[4] != 1}:
        rest = [r[3] for r in passed if r[0] == stratum and r[4] != 1]
        cuts[stratum] = [[next(c for c in range(1, Q.GRID + 2) if sum(x[k] >= c for x in rest) <= share * len(rest)) for share in Q.SHARES] for k in range(len(Q.RULES))]
    texts: dict = {}
    for stratum, text, _, steps, good in passed:
        if good is not None and stratum in cuts:
            old = texts.get((stratum, text), (good, steps))
            texts[stratum, text] = (min(good, old[0]), min(steps, old[1]))
    share = {k: [sum(x < c for c in row) for x, row in zip(steps, cuts[k[0]], strict=True)] for k, (_, steps) in texts.items()}
    bad = [share[k] for k, (good, _) in texts.items() if good == 0]
    ladder = []
    if len(bad) < Q.LEAST_BAD:
        ladder = [[k] * len(Q.RULES) for k in range(len(Q.SHARES))]
    else:
        for least in Q.LIFTS:
            step = []
            for r in range(len(Q.RULES)):
                fits = [k for k, s in enumerate(Q.SHARES) if max(0, (h := sum(x[r] <= k for x in bad)) - h**0.5) / len(bad) / s >= least]
                step.append(max(fits, default=-1))
            ladder.append(step)
    size = Counter(k[0] for k, (good, _) in texts.items() if good == 1)
    needed = lambda level: math.ceil(math.log(level) / math.log1p(-risk))
    possible = sum(n >= needed(delta) for n in size.values())
    tested = [s for s, n in size.items() if n >= needed(delta / max(1, possible))]
    limits = {}
    for stratum in tested:
        own = [share[k] for k, (good, _) in texts.items() if good == 1 and k[0] == stratum]
        for step in ladder:
            lost = sum(any(a >= k for a, k in zip(step, x, strict=True)) for x in own)
            if lost >= risk * len(own) or Q.binomial_tail(lost, len(own), risk) > delta / len(tested):
                break
            limits[stratum] = [row[a] if a >= 0 else Q.GRID + 1 for a, row in zip(step, cuts[stratum], strict=True)]
    return {i: not r[2] and not any(x >= c for x, c in zip(r[3], limits.get(r[0], [Q.GRID + 1] * 5), strict=True)) for i, r in rows.items()}, set(limits)


def test_verdicts_against_brute_force(spark):
    """On a risk that the small table can certify."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    want, strata = plain_verdicts([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()], 0.1, 0.2)
    rows, cutoffs = Q.verdicts(docs, labels, risk=0.1, delta=0.2)
    assert {r.doc_id: r.kept for r in rows.collect()} == want and not all(want.values())
    assert {r.stratum for r in cutoffs.collect()} == strata != set()
    kept = Q.keep_good(docs, labels, risk=0.1, delta=0.2)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, k in want.items() if k)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (7, 0, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows, _ = Q.verdicts(odd, labels)
    assert rows.count() == odd.count() and rows.columns == ["doc_id", *Q.COUNTS, "base_failed", "kept", "rules_failed"]
    assert Q.keep_good(odd, labels).columns == odd.columns
    assert Q.keep_good(none, labels).count() == 0 and Q.keep_good(odd, labels.limit(0)).count() == 0


def test_no_text_is_shuffled(spark, sf, monkeypatch, plans):
    rows, _ = Q.verdicts(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows.collect()
    assert "digest" in plans.shuffled() and not plans.texts()
