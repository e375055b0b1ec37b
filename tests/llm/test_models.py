"""Toxicity, language-model scoring, co-training, SentencePiece and URL filters, on small made-up corpora."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.llm import lm_scoring as L
from strataspark.llm import quality_classifier as C
from strataspark.llm import sentencepiece as S
from strataspark.llm import toxicity as X
from strataspark.llm import url_filter as U
from strataspark.llm.words import MARKS


def corpus(n=600, seed=3):
    """(id, text, bad): bad texts hold some of four telling words."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        text, bad = rng.choices(words, k=rng.randint(20, 120)), rng.random() < 0.3
        for _ in range(4 * bad):
            text[rng.randrange(len(text))] = rng.choice(["vile", "nasty", "awful", "foul"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity_on_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert len(got) == len(rows) and 100 < len(held) < 200
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    # Labels of held-out rows are never learned from.
    wrong = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in X.toxicity(docs, wrong).collect()} == pytest.approx({i: r.score for i, r in got.items()})


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        rows = X.toxicity(odd, given).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert X.toxicity(none, labels).count() == 0


def plain_scores(spark, docs, share):
    """{id: score} of {id: (text, target)}."""
    tokens = {i: [w for x in (t or "").lower().split() if (w := x.strip(MARKS))] for i, (t, _) in docs.items()}
    counts = Counter(w for t in tokens.values() for w in t)
    vocab = {w for w, n in counts.items() if n >= 2 and n >= share * sum(counts.values())}
    rows = spark.createDataFrame([(i, [0] * len(t)) for i, t in tokens.items()], "id long, ids array<int>")
    sizes = [sum(len(tokens[i]) + 1 for i in docs if bool(docs[i][1]) == side) for side in (True, False)]
    drawn = {r.id for r in rows.where(L.matched(F.col("id"), F.col("ids"), min(1, sizes[0] / max(1, sizes[1])))).collect()}
    side = {i: "t" if y else "b" if i in drawn else "" for i, (_, y) in docs.items()}
    grams = {}
    for i, t in tokens.items():
        x = ["<s>", *[w if w in vocab else "<unk>" for w in t], "</s>"]
        grams[i] = Counter(zip(x, x[1:], strict=False))
    out, models = {}, {}
    for name in ("t", "b"):
        both = Counter()
        for i, g in grams.items():
            if side[i] == name:
                both.update(g)
        v, w = Counter(), Counter()
        for (a, b), n in both.items():
            v[a] += n
            w[b] += n
        models[name] = (both, v, w, max(1, sum(both.values())))
    for i, g in grams.items():
        loss = {}
        for name, (both, v, w, total) in models.items():
            loss[name] = 0.0
            for (a, b), n in g.items():
                own = n if side[i] == name else 0
                alone = L.UNIGRAM * w[b] / total + (1 - L.UNIGRAM) / (len(vocab) + 3)
                loss[name] -= n * math.log(L.BIGRAM * ((both[a, b] - own) / v[a] if v[a] else 0) + (1 - L.BIGRAM) * alone)
        out[i] = (loss["b"] - loss["t"]) / sum(g.values())
    return out


@pytest.mark.parametrize("hot", [0, 20, 1000])
def test_cross_entropy_difference_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    docs = {i: (t, i % 4 == 0) for i, t, _ in corpus(150)} | {900: (None, True), 901: ("", None)}
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in docs.items()], "doc_id long, text string, target boolean")
    got = {r.doc_id: r.score for r in L.cross_entropy_difference(df, vocab_share=1e-3).collect()}
    assert got == pytest.approx(plain_scores(spark, docs, 1e-3), abs=1e-5)
    named = spark.createDataFrame([(i,) for i, (_, y) in docs.items() if y] * 2 + [(None,), (12345,)], "doc_id long")
    assert {r.doc_id: r.score for r in L.cross_entropy_difference(df.drop("target"), target_col=None, vocab_share=1e-3, targets=named).collect()} == pytest.approx(got)
    assert L.cross_entropy_difference(df.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [0, 1 << 22])
def test_rare_words_are_in_the_vocabulary(spark, monkeypatch, listed):
    """Words that occur twice among 300,000 tokens, with a vocabulary that the tasks get whole and with a shuffled one."""
    monkeypatch.setattr(L, "LISTED", listed)
    monkeypatch.setattr(L, "HOT", 5)
    docs = {i: (t, bool(y)) for i, t, y in corpus(60)} | {900: (None, True), 901: ("", None)}
    docs |= {1000 + i: ("common words " * 2500 + f"rare{i // 2} alone{i} rare{i // 2}", i % 3 == 0) for i in range(60)}
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in docs.items()], "doc_id long, text string, target boolean")
    got = {r.doc_id: r.score for r in L.cross_entropy_difference(df).collect()}
    assert got == pytest.approx(plain_scores(spark, docs, 0.0), abs=1e-6)
    assert L.cross_entropy_difference(df.limit(0)).count() == 0


@pytest.mark.parametrize(("listed", "hot"), [(40, 20), (250, 5), (310, 1000)])
def test_words_that_are_not_listed_shuffle_their_own_bigrams_only(spark, monkeypatch, listed, hot):
    """A vocabulary longer than LISTED: scores are those of the whole one, whatever is listed, and few rows are stored for the others."""
    monkeypatch.setattr(L, "LISTED", listed)
    monkeypatch.setattr(L, "HOT", hot)
    docs = {i: (t, bool(y)) for i, t, y in corpus(150)} | {900: (None, True), 901: ("", None), 902: ("w0 once w0 only w0 w0", False)}
    docs |= {1000 + i: (f"w1 w2 w3 rare{i // 2} alone{i} rare{i // 2} w1 alone{i}x", i % 3 == 0) for i in range(60)}
    rows, real = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df: (found := real(df), rows.append(found.count()))[0])
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in docs.items()], "doc_id long, text string, target boolean")
    got = {r.doc_id: r.score for r in L.cross_entropy_difference(df).collect()}
    assert got == pytest.approx(plain_scores(spark, docs, 0.0), abs=1e-6)
    if listed > 40:
        assert max(rows) < sum(len((t or "").split()) for t, _ in docs.values()) / 3
    named = spark.createDataFrame([(i,) for i, (_, y) in docs.items() if y] * 2 + [(None,), (12345,)], "doc_id long")
    assert {r.doc_id: r.score for r in L.cross_entropy_difference(df.drop("target"), target_col=None, targets=named).collect()} == pytest.approx(got)


def test_language_models_of_odd_rows(spark, odd, none, plans):
    """Null and repeated ids, extra columns with clashing names, no targets or only targets; no text is shuffled."""
    targets = spark.createDataFrame([(1,), (5,), (None,)], "doc_id long")
    for given in (targets, targets.limit(0), odd.select("doc_id")):
        rows = L.cross_entropy_difference(odd, target_col=None, targets=given).collect()
        assert sorted(map(str, {r.doc_id for r in rows})) == sorted(map(str, {r.doc_id for r in odd.select("doc_id").collect()})) and len(rows) == 8
        assert all(math.isfinite(r.score) for r in rows)
    assert L.cross_entropy_difference(none, target_col=None, targets=targets).count() == 0
    assert plans.shuffled() and not plans.texts()


def test_co_training(spark, odd, none):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "spam" if y else "news") for i, t, y in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 - y, 0) for i, _, y in rows if i % 3 == 0], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.co_train(docs, labels).collect()}
    new = [(i, y) for i, _, y in rows if not got[i].labelled]
    assert len(new) == 400 and sum(got[i].predicted == 1 - y for i, y in new) / len(new) > 0.95
    assert C.co_train(odd, labels).count() == odd.count() and C.co_train(none, labels).count() == 0
    assert {r.score for r in C.co_train(docs, labels.limit(0)).collect()} == {0.5}


def unigram_model(entries):
    """A SentencePiece model file of the entries, as a unigram model with byte fallback."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, kind, x: number(k << 3 | kind) + (number(len(x)) + x if kind == 2 else x)
    kinds = {"piece": 1, "byte": 6}
    model = b""
    for i, (p, s, kind) in enumerate(entries):
        code = kinds.get(kind) or (2 if i == 0 else 3)
        model += field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, number(code)))
    trainer = field(3, 0, number(1)) + field(4, 0, number(len(entries))) + field(35, 0, number(1)) + field(40, 0, number(0)) + field(41, 0, number(1)) + field(42, 0, number(2))
    normal = field(1, 2, b"identity") + field(3, 0, number(1)) + field(4, 0, number(0)) + field(5, 0, number(1))
    return model + field(2, 2, trainer) + field(3, 2, normal)


def test_sentencepiece_against_the_library(spark, sf):
    import sentencepiece

    entries = S.vocabulary()
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(entries))
    pieces = S.Pieces(entries)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    texts += ["", " ", "  a  b ", "\n\t x", "😀 Größe über 漢字仮名", "a" * 3000, "▁ mark", "x\u0000y"]
    offsets, every, _, _ = pieces.encode(pa.array(texts))
    decoded = pieces.decode(offsets, every)
    for i, text in enumerate(texts):
        ids, want = every[offsets[i] : offsets[i + 1]], library.encode(text)
        if ids.tolist() != want:  # another segmentation is as good but for the library's rounding to 32 bits
            worth = lambda x: sum(entries[i][1] for i in x if entries[i][2] == "piece")
            fallback = lambda x: [i for i in x if entries[i][2] == "byte"]
            assert fallback(ids.tolist()) == fallback(want), text[:50]
            assert worth(ids.tolist()) == pytest.approx(worth(want), rel=1e-5), text[:50]
        if S.MARK not in text:
            assert decoded[i] == text


def test_sentencepiece_columns(spark, odd, none):
    got = S.decode(S.encode(odd)).collect()
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in odd.select("text").collect())
    assert S.encode(none).count() == 0
    again = S.decode(S.decode(S.encode(odd)))  # a column `decoded` is there already
    assert again.columns == ["doc_id", "ids", "score", "n_fallback", "decoded"]
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in got)


def test_sentencepiece_forgets_and_remembers(monkeypatch):
    monkeypatch.setattr(S, "CACHE", 40)
    entries, rng = S.vocabulary(), random.Random(5)
    kept, whole = S.Pieces(entries), S.Pieces(entries)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("rstuvw") * rng.randint(1, 4) for _ in range(12)) for _ in range(60)]
    monkeypatch.setattr(S, "CACHE", 10_000)
    want = whole.encode(pa.array(texts))
    monkeypatch.setattr(S, "CACHE", 40)
    for at in range(0, 60, 4):
        got = kept.encode(pa.array(texts[at : at + 4]))
        assert got[1].tolist() == want[1][want[0][at] : want[0][at + 4]].tolist()
        assert np.allclose(got[2], want[2][at : at + 4]) and got[3].tolist() == want[3][at : at + 4].tolist()


def plain_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in U.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_url_rules(spark, sf, none):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://notexample.com/en/", "a://b://c/d", "http://net/es/", "http://x.net/fr", "http://Ä.com/é?"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in U.judge(pages).collect():
        host, path, best = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    assert U.judge(pages.limit(0)).count() == 0
    only = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/")], "page_id long, url string")
    assert {r.verdict for r in U.judge(only).collect()} == {"allow"}


def test_url_trees_learn(spark):
    rows = [(i, f"http://s{i}.com/en/{i}") for i in range(150)] + [(1000 + i, f"http://x-{i}-casino-{i}.net/es/{i * 7919}/{i}?a={i}&b={i}&c=3") for i in range(150)]
    rows += [(2000 + i, f"http://y-{i}-casino.org/zz/{i * 104729}/{i}?a={i}&b={i}&c=3") for i in range(20)] + [(3000 + i, f"http://t{i}.org/en/{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[2000 + i] == "block" and got[3000 + i] == "allow" for i in range(20))
