"""Batches cut into portions, and word hashes that do not depend on how texts are cut."""

import random

import numpy as np
import pyarrow as pa

from querykiln.llm import words


def test_portions_keep_every_row_in_order(monkeypatch):
    monkeypatch.setattr(words, "PORTION_BYTES", 10)
    bodies = [b"", None, b"x" * 4, b"y" * 50, None, b"z" * 5, b"z" * 5, b"", b"q"]
    batch = pa.RecordBatch.from_pydict({"n": list(range(9)), "body": pa.array(bodies, pa.binary())})
    parts = list(words.portions([batch, batch.slice(0, 0), batch.slice(2, 3)], 1))
    assert [n for p in parts for n in p.column(0).to_pylist()] == [*range(9), 2, 3, 4]
    assert all(sum(len(b or b"") for b in p.column(1).to_pylist()) <= 10 or p.num_rows <= 2 for p in parts)


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(8)
    texts = [b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 60)))
             for _ in range(40)] + [b"", b"w" * 5000]
    want = words.word_hashes(texts)
    monkeypatch.setattr(words, "SEGMENT_BYTES", 64)
    got = words.word_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert len(want[0]) == sum(len(t.split()) for t in texts)
