"""What a Python task of an operator holds at once."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from lodestone.llm import substrings


class _Full:
    """A sketch in which each cell counts two or more, as on a corpus of copies."""

    value = [np.full(substrings.BLOCK // 8, 255, np.uint8) for _ in range(substrings.DEPTH)]


def _batch(n: int, words: int) -> pa.RecordBatch:
    r = random.Random(3)
    texts = [" ".join(r.choices("some few words that repeat in every text of these".split(), k=words)) for _ in range(n)]
    ids = pa.array(range(n), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["d", "t", "text"])


def _peak(run, batch: pa.RecordBatch) -> float:
    """Bytes held at most besides the batch, for each byte of its text."""
    substrings.hash_words(batch.column("text").slice(0, 1))
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / batch.column("text").nbytes
    finally:
        tracemalloc.stop()


def test_substrings_hold_little_of_a_batch():
    batch = _batch(300, 3000)
    assert _peak(substrings._sketch(20, substrings.BLOCK), batch) < 8
    assert _peak(substrings._repeated(20, substrings.BLOCK, _Full, b"s" * 16), batch) < 25


def test_substrings_of_one_batch_in_pieces(monkeypatch):
    """Windows of one batch fold across the pieces in which it is hashed."""
    batch = _batch(60, 200)
    whole = [x.to_pydict() for x in substrings._repeated(3, substrings.BLOCK, _Full, b"s" * 16)(iter([batch]))]
    sketch = [x.to_pydict() for x in substrings._sketch(3, substrings.BLOCK)(iter([batch]))]
    monkeypatch.setattr(substrings, "PIECE", 1000)
    assert whole == [x.to_pydict() for x in substrings._repeated(3, substrings.BLOCK, _Full, b"s" * 16)(iter([batch]))]
    assert sketch == [x.to_pydict() for x in substrings._sketch(3, substrings.BLOCK)(iter([batch]))]
    assert any(whole[0]["gone"]) and not all(whole[0]["gone"])


def test_sketch_of_many_batches_is_sent_once():
    batch = _batch(60, 200)
    many = [batch.slice(i, 3) for i in range(0, 60, 3)]
    whole, cut = ([x for out in substrings._sketch(20, substrings.BLOCK)(iter(b)) for x in out.to_pylist()] for b in ([batch], many))
    assert whole == cut and len(cut) == substrings.DEPTH


def test_blocks_are_counted_once(monkeypatch):
    """However many tasks send cells of a block, all its cells are gone through once."""
    r = np.random.default_rng(4)
    sent = [(row, block, np.sort(r.integers(0, substrings.BLOCK, 50)).astype("<u2")) for row in range(2) for block in range(3) for _ in range(400)]
    frame = pd.DataFrame([(row, block, c.tobytes()) for row, block, c in sent], columns=["row", "block", "cells"])
    calls, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or real(*a, **b))
    got = pd.concat(list(substrings._merge(iter([frame[i : i + 700] for i in range(0, len(frame), 700)]))))
    assert len(calls) == 6
    monkeypatch.setattr(substrings, "GATHERED", 1000)
    less = pd.concat(list(substrings._merge(iter([frame]))))
    for out in (got, less):
        assert [(x.row, x.block) for x in out.itertuples()] == [(row, block) for row in range(2) for block in range(3)]
        for x in out.itertuples():
            n = real(np.concatenate([c for row, block, c in sent if (row, block) == (x.row, x.block)]), minlength=substrings.BLOCK)
            assert x.bits == np.packbits(n >= 2).tobytes()
