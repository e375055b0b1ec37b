import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from strataspark.llm import alignment as A
from strataspark.llm.packing import tokenizer_folder


@pytest.fixture(scope="module")
def sides():
    return A.tokenizers(tokenizer_folder())


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def brute(text, sides, plain):
    """Tokens of the whole text by the prescribed libraries, walked through byte by byte: (numbers, digest, linked pairs)."""
    a, b = sides
    if not text:
        return (0, 0, 0, 0), "", []
    whole = (" " + text).encode()
    x, y = plain.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    if a.joined(x) != whole or b.joined(y) != whole:
        return (0, 0, 0, 0), "", []
    owner = lambda ids, side: [k for k, i in enumerate(ids) for _ in range(side.lengths[i])]
    own_a, own_b = owner(x, a), owner(y, b)
    links = sorted(set(zip(own_a, own_b, strict=True)))
    groups, at = [], 0
    for k in range(1, len(whole) + 1):
        if k == len(whole) or (own_a[k] != own_a[k - 1] and own_b[k] != own_b[k - 1]):
            groups.append((x[own_a[at] : own_a[k - 1] + 1], y[own_b[at] : own_b[k - 1] + 1]))
            at = k
    said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    return (len(x), len(y), len(groups), len(links)), hashlib.sha256(said.encode()).hexdigest(), [(x[i], y[j]) for i, j in links]


def expected(texts, sides, plain):
    found = [brute(t, sides, plain) for t in texts]
    count = Counter(p for x in found for p in set(x[2]))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*x[0], x[1], sum(count[p] == most[p[0]] for p in x[2]), sum(count[p] for p in x[2])) for x in found]


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.orderBy("doc_id").collect()]


ODD = [None, "", " ", "  two  blanks ", "a\n b\n  c\t d", "<|endoftext|> <s> </s> <0x41>", "mark ▁ in it", "Größe 😀😀 über alles x", "don't we'll", "\r\n\r\n", "x" * 3000, "\x00\x1c \x1d y", " ab  cd" * 3, "same text here", "same text here"]


def test_query_against_the_libraries(spark, sf, sides, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert rows_of(A.op11_cross_tokenizer_alignment(spark, sf)) == expected([r.text for r in docs], sides, plain)


@pytest.mark.parametrize("hot", [0, 3, 1 << 20])
def test_odd_texts_and_pairs_that_are_not_broadcast(spark, sides, plain, hot):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert rows_of(A.align_tokenizers(df, hot_pairs=hot)) == expected(ODD, sides, plain)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab.,é▁'1 "), st.characters(codec="utf-8")), max_size=60))
def test_words_are_aligned_as_in_the_whole_text(sides, plain, text):
    totals, digests, pairs, links = A.Words(*sides).aligned([text])
    numbers, digest, linked = brute(text, sides, plain)
    count = Counter(i * len(sides[1].lengths) + j for i, j in linked)
    assert tuple(totals[0]) == numbers and digests[0] == digest
    assert dict(zip(pairs[0].tolist(), links[0].tolist(), strict=True)) == count


def test_words_forgotten_and_long_texts(sides, plain, monkeypatch):
    monkeypatch.setattr(A, "WORDS", 5)
    monkeypatch.setattr(A, "CHUNK", 30)
    words = A.Words(*sides)
    texts = ["one two three four five six seven eight", "one two nine ten", "ein sehr langer Text " * 5000, "a ▁ b", "a" + " " * 120_000 + "b", "x" * 100_000]
    for t in texts:
        totals, digests, _, _ = words.aligned([t])
        assert (tuple(totals[0]), digests[0]) == brute(t, sides, plain)[:2]


def test_index_with_gaps_and_overlaps():
    """Tokens that leave bytes out, and two that share bytes, against all pairs."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.sort(rng.integers(0, 40, (rng.integers(1, 9), 2)), axis=1) + [0, 1] for _ in range(2))
        a, b = (np.stack([np.sort(x[:, 0]), np.sort(x[:, 1])], axis=1) for x in (a, b))
        of_a, of_b, group_a, group_b = A.align((a[:, 0], a[:, 1]), (b[:, 0], b[:, 1]))
        links = {(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e}
        assert set(zip(of_a.tolist(), of_b.tolist(), strict=True)) == links
        assert all(group_a[i] == group_b[j] for i, j in links)


def test_rows_as_they_are(spark, odd, none):
    assert A.align_tokenizers(none).count() == 0
    got = A.align_tokenizers(odd)
    assert got.count() == odd.count() and got.where("doc_id IS NULL").count() == 1 and got.where("doc_id = 5").count() == 2
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
