"""Hashed words of whole texts, and sums of them that a task makes before it shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Stripped from both ends of a word.
MARKS = ".,;:!?\"'()[]{}<>*%&$#|"


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, codes, hashes): the words of text i are hashes[codes[offsets[i] : offsets[i + 1]]].

    Words are lower case, parted by white space, without the marks around them; words of marks only are left out. A hash
    is the XXH64 as a signed number. Each distinct word of the batch is hashed once."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = [w.strip(MARKS) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64).view(np.int64)
    codes = coded.indices.to_numpy()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
    real = np.array([bool(w) for w in words], bool)
    if not real.all():
        keep = real[codes]
        offsets, codes = np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]
    return offsets, codes, hashes


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of one text's words, in order."""
    _, codes, hashes = coded_words(pa.array([text], pa.string()))
    return hashes[codes]


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the columns `keys`, sorted, with the sums of the columns `values`."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) for v in values]


def emitted(blocks: Iterator[tuple[list[np.ndarray], list[np.ndarray]]], names: list[str], rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Record batches of the sums of `blocks`, gathered up to about `rows` rows."""
    keys, values, held = [], [], 0

    def out() -> pa.RecordBatch:
        k, v = summed([np.concatenate(c) for c in zip(*keys, strict=True)], [np.concatenate(c) for c in zip(*values, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*k, *v)], names=names)

    for k, v in blocks:
        keys.append(k)
        values.append(v)
        held += len(k[0])
        if held >= rows:
            yield out()
            keys, values, held = [], [], 0
    if held:
        yield out()
