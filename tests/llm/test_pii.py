import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from strataspark.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


ODD = [
    "a@b.c_d@e.f.g h@i x@y.z.", "+1 (743) 555-3824, 227.5.221.1 and 300.1.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "é😀 a.b+c@d-e.fr 😀 1.2.3.4.5.6.7.8",
    "000255.1.1.1 0256.1.1.1", "1-1 1--1 " * 20, "9" * 30000, "a" * 30000 + "@b" + ".c" * 8000, "+1" + "23" * 9000, "a@b.c" * 50, None, "",
]


def test_base_spans_of_odd_texts(spark):
    rows, _ = P.find(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    everything = P._joined(F.concat(*[F.col(f"_found.{k}") for k in P.KINDS]))
    got = {r.doc_id: r.s for r in rows.select("doc_id", everything.alias("s")).collect()}
    assert got == {i: ",".join(plain(t)) for i, t in enumerate(ODD)}


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op6_pii(spark, sf).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in P.KINDS]
        assert r.spans.startswith(",".join(want))


def planted(spark):
    """'Quetzalnym' stands only with one address, in many surroundings; 'common' stands everywhere."""
    rows = [(i, f"alpha{chr(97 + i % 26)}x delta{chr(97 + i)}x common Quetzalnym zorro@example.org common gamma{chr(97 + i % 7)}") for i in range(20)]
    rows += [(100 + i, f"common words without any of it, number {i}") for i in range(200)]
    rows += [(400 + i, "copied rareword sits beside copy@example.org always") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    rows, terms = P.find(planted(spark))
    assert [(r.term, r.entity_kind) for r in terms.collect()] == [("quetzalnym", "email")]
    extra = {r.doc_id: r.n for r in rows.select("doc_id", F.size("_found.term").alias("n")).collect()}
    assert all(extra[i] == 1 for i in range(20)) and not any(n for i, n in extra.items() if i >= 100)


def test_sanitise(spark, odd, none):
    got = {r.doc_id: r.text for r in P.sanitise(planted(spark)).collect()}
    assert got[0] == "alphaax deltaax common [TERM] [EMAIL] common gammaa"
    assert got[100] == "common words without any of it, number 0"
    texts = spark.createDataFrame([(1, "call +1 (743) 555-3824 or x@y.zz 😀 10.0.0.1!"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in P.sanitise(texts).collect()} == {1: "call [PHONE] or [EMAIL] 😀 [IP]!", 2: None}
    same = P.sanitise(odd)
    assert same.columns == odd.columns and same.dtypes == odd.dtypes
    key = lambda r: tuple(map(str, r))
    assert sorted(same.collect(), key=key) == sorted(odd.collect(), key=key)
    assert P.sanitise(none).count() == 0
    clash = texts.withColumn("_text", F.lit(7)).withColumn("_found", F.lit("x"))
    assert P.sanitise(clash).select("_text", "_found").distinct().collect() == [(7, "x")]


def test_terms_of_few_texts_anywhere_in_them(spark):
    """'Quetzalnym' is far from its address and in 2 to 4 texts; words of copies of one text show nothing."""
    filler = " ".join(["common words without any of it"] * 30)
    for texts in (2, 3, 4):
        rows = [(i, f"{'xyzw'[i] * 5} Quetzalnym {filler} zorro@example.org") for i in range(texts)]
        rows += [(100 + i, f"common words without any of it, number {i}") for i in range(400)]
        rows += [(600 + i, f"copied rareword {filler} copy@example.org") for i in range(30)]
        found, terms = P.find(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [(r.term, r.entity_kind) for r in terms.collect()] == [("quetzalnym", "email")]
        assert {r.doc_id for r in found.where(F.size("_found.term") > 0).select("doc_id").collect()} == set(range(texts))


def test_chance_is_no_less_than_the_exact_tail(spark):
    from math import comb, log

    cases = [(300, k, t, e) for t in (1, 2, 5, 40, 200) for e in (1, 2, 7, 90) for k in (1, 2, 5, 30) if k <= min(t, e)]
    df = spark.createDataFrame(cases, "total long, k long, t long, e long")
    for r in df.withColumn("p", P.chance(300.0, F.col("k"), F.col("t"), F.col("e"))).collect():
        exact = log(sum(comb(r.e, x) * comb(300 - r.e, r.t - x) for x in range(r.k, min(r.t, r.e) + 1) if r.t - x <= 300 - r.e) / comb(300, r.t))
        assert r.p >= exact - 1e-9
        if r.k == min(r.t, r.e):
            assert abs(r.p - exact) < 1e-6


def plain_terms(texts, disclosure=P.DISCLOSURE, error=P.ERROR):
    """{term: kind} by the definitions, over plain counts of distinct texts."""
    n_term, n_entity, both, total = Counter(), Counter(), Counter(), 0
    for text in {t or "" for t in texts}:
        total += 1
        entities = set()
        for s in plain(text):
            kind, a, b = s.split(":")
            value = text[int(a) : int(b)]
            value = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
            entities |= {(kind, value), (kind, None), ("any", None)}
        words = set(re.findall(r"[^\W\d_]{4,40}", re.sub(PATTERNS["email"], " ", text).lower()))
        n_term.update(words)
        n_entity.update(entities)
        both.update((w, e) for w in words for e in entities)
    tried = sum(n >= 2 for n in n_term.values())
    best: dict = {}
    for (w, e), k in both.items():
        t, n = n_term[w], n_entity[e]
        if k < 2:
            continue
        share = math.log(total * k / (t * n)) / math.log((total + 1) / n)
        subsets = sum(math.log((t - i) * (n - i) / ((total - i) * (i + 1))) for i in range(min(k, P.FACTORS)))
        q, p = k / t, n / total
        spread = -t * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 and p < 1 else 0)) if q > p else 0
        if share >= disclosure and min(subsets, spread, 0) + math.log(tried) <= math.log(error):
            best[w] = max(best.get(w, (0, "")), (share, e[0]))
    return {w: kind for w, (_, kind) in best.items()}


def test_terms_of_the_corpus_against_brute_force(spark):
    """The word before a secret tells of personal data in the larger table; the query's spans show it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_terms(texts.values())
    _, terms = P.find(docs)
    assert {r.term: r.entity_kind for r in terms.collect()} == want and "token" in want
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term:")] for r in P.op6_pii(spark, "/root/testdata/sf0.1").collect()}
    for i, text in texts.items():
        assert spans[i] == [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{4,40}", text or "") if m[0].lower() in want]
