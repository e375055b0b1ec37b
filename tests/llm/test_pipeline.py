import corpus_pipeline as C
from tests.llm import test_pii, test_simhash
from tests.llm.test_packing import check, tokens
from tests.llm.test_quality_rules import plain as counts


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = C.quality_rules(spark, docs, sf)
    texts = {r.doc_id: r.text for r in kept.collect()}
    everything = {r.doc_id: r.text for r in docs.collect()}
    assert not any(counts(t)[5] for t in texts.values()), "the base rules reject"
    groups = {}
    for i in sorted(texts):
        groups.setdefault(" ".join((texts[i] or "").replace("\x0b", " ").split()), i)
    texts = {i: texts[i] for i in groups.values()}
    label = test_simhash.brute({i: test_simhash.plain(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if label[i] == i}
    clean = {i: masked(t) for i, t in texts.items()}
    got = C.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(clean) and set(clean) <= set(everything)
    check(got, dict(zip(clean, tokens(clean.values()), strict=True)))


def masked(text):
    """The text with its base matches replaced (no term reaches the support needed in so small a table)."""
    spans = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in test_pii.plain(text)))
    at, out = 0, ""
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, -b)
    return out + text[at:]


def test_stages_keep_columns_and_survive_odd_rows(spark, odd, none, sf):
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, none, sf).count() == 0, name


def test_stages_keep_columns_that_clash_with_their_own(spark, sf):
    names = ("_row", "_sha", "_h", "_maybe", "_bits", "_gone", "_cutoffs", "_stratum_key", "_quality", "_text", "_key", "_found", "_hot", "fp")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in names), name
