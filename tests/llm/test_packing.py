import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strataspark.llm import packing as K


def tokens(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], np.uint32) for x in texts]


def check(pieces, docs, capacity=1024):
    """Every id in one piece; sequences gapless and full but for the last."""
    for i, ids in docs.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in rows:
        assert r.sequence_id * capacity + r.offset == place and r.length > 0 and r.offset + r.length <= capacity
        place += r.length


def test_query_against_tokenizers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(K.op10_packing(spark, sf).collect(), dict(zip([r.doc_id for r in docs], tokens([r.text for r in docs]), strict=True)))


def test_special_and_odd_texts(spark, none):
    texts = ["<|endoftext|>a <|endoftext|> b", None, "", "x" * 50000, "😀 Größe\n\n\t  end  "] + ["the same text"] * 400
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = K.pack(df, capacity=64).collect()
    check(pieces, dict(enumerate(tokens(texts))), 64)
    assert all(r.ids is not None and len(r.ids) == r.length for r in pieces)
    assert K.pack(none).count() == 0


def test_rows_that_repeat_an_id(spark, odd):
    pieces = K.pack(odd, capacity=16).collect()
    assert sum(r.length for r in pieces) == sum(len(x) for x in tokens([r.text for r in odd.select("text").collect()]))
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_hilbert_curve_is_a_walk():
    bits, dims = 3, 3
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    key = K.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(1 << bits * dims))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_order_is_that_of_the_curve_however_groups_are_cut(spark):
    """Hot cells: many texts of one word, three of them with copies; the order is by key, and copies are side by side."""
    texts = [f"word{i % 9} w{i * 7919 % 101}" for i in range(300)] + ["the same text"] * 100 + ["another text"] * 100 + [""] * 100
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    key = {r.id: (r.key, r.digest) for r in K.encoded(df, "doc_id", "text").collect()}
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pieces = sorted(K.pack(df, capacity=16).collect(), key=lambda r: (r.sequence_id, r.offset))
            seen.append([r.doc_id for r in pieces if r.start == 0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    assert [key[i] for i in seen[0]] == sorted(key.values())


def test_very_long_blanks(spark):
    """White space that the faster library cannot split: ids of the prescribed one."""
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, " " * 300_000 + "x <|endoftext|>", "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(K.pack(df, with_ids=False).collect(), dict(enumerate(tokens(texts))))


def test_sequences_hold_neighbours(spark, sf):
    """Documents that meet in a sequence are nearer in the space of the curve than documents at random."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").dropDuplicates(["text"])
    folder = K.tokenizer_folder()
    at = {r.doc_id: K.vector(K.encode(r.text, folder)) for r in docs.collect()}
    together: dict[int, list[int]] = {}
    for r in K.pack(docs, with_ids=False).collect():
        together.setdefault(r.sequence_id, []).append(r.doc_id)
    near = [np.linalg.norm(at[a] - at[b]) for x in together.values() for a in x for b in x if a < b]
    rng, ids = np.random.default_rng(1), sorted(at)
    far = [np.linalg.norm(at[a] - at[b]) for a, b in rng.choice(ids, (4000, 2)) if a != b]
    assert len(near) > 30 and np.mean(near) < 0.8 * np.mean(far)
