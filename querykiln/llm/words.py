"""Word hashes of whole batches of texts at once, with numpy, and texts kept by key."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.llm.common import gives_back, partitions
from querykiln.session import shared_folder

SEGMENT_BYTES = 256 << 10  # hashed at once; takes some 40 times its size for a moment
PORTION_BYTES = 256 << 10  # of texts, as they are stored, that a task holds at once
_PRIME = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.full(size, _PRIME, dtype=np.uint64)
        _inverse = np.full(size, pow(_PRIME, -1, 1 << 64), dtype=np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.cumprod(_powers), np.cumprod(_inverse)
    return _powers[:n], _inverse[:n]


def _segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one segment."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = _tables(len(raw) + 1)
    upto = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=upto[1:])
    h = (upto[ends] - upto[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) and the text number of each."""
    hashes, owners = [], []
    group: list[int] = []
    size = 0

    def flush():
        nonlocal size
        if group:
            h, starts = _segment(b" ".join(texts[i] for i in group))
            offsets = np.cumsum([0] + [len(texts[i]) + 1 for i in group[:-1]])
            hashes.append(h)
            owners.append(np.array(group)[np.searchsorted(offsets, starts, side="right") - 1])
        group.clear()
        size = 0

    for i, text in enumerate(texts):
        if len(text) > SEGMENT_BYTES:
            flush()
            for part in _cut(text):
                h, _ = _segment(part)
                hashes.append(h)
                owners.append(np.full(len(h), i))
            continue
        if size + len(text) > SEGMENT_BYTES:
            flush()
        group.append(i)
        size += len(text)
    flush()
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _cut(text: bytes):
    """Pieces of about a segment, cut between words."""
    at = 0
    while at < len(text):
        end = at + SEGMENT_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def gram_hashes(words: np.ndarray, size: int, salt: int = 1) -> np.ndarray:
    """Hash of the `size` words from each position; shorter than `words` by size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = np.random.default_rng(salt).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = words[:n] * factors[0]
    for j in range(1, size):
        out += words[j:j + n] * factors[j]
    return mixed(out)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or `pick`) of each run of `width` values, in about log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def texts_by_key(docs: DataFrame, doc_id: str, text: str, purpose: str, keep: bool = False) -> DataFrame:
    """doc_id, doc_key, text_key, body (compressed text) as a table bucketed by doc_key.

    The one time the texts move: later joins on doc_key bring the small side to them. doc_key is a
    hash of id and text, so equal rows share it; text_key is a 128-bit hash of the text. A null
    text is kept with a null body. With `keep`, `row` holds the other columns.
    """
    spark = docs.sparkSession

    def run(batches):
        press = zstandard.ZstdCompressor(level=6).compress
        for batch in portions(batches, 1):
            texts = batch.column(1).to_pylist()
            keys = [xxhash.xxh3_128_digest(t) if t is not None else bytes(16) for t in texts]
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "doc_key": pa.array([xxhash.xxh3_64_intdigest(k + str(i).encode()) - (1 << 63)
                                     for i, k in zip(ids, keys, strict=True)], pa.int64()),
                "text_key": pa.array(keys, pa.binary()),
                "body": pa.array([None if t is None else press(t) for t in texts], pa.binary()),
                **({"row": batch.column(2)} if keep else {})})

    kind = docs.schema[doc_id].dataType.simpleString()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"),
                       *[rest] * keep)
    n = partitions(spark)
    name = f"querykiln_{purpose}_{uuid.uuid4().hex}"
    row_kind = f", row {rows.schema['row'].dataType.simpleString()}" if keep else ""
    (rows.mapInArrow(gives_back(run), f"doc_id {kind}, doc_key long, text_key binary, body binary{row_kind}")
     .repartition(n, "doc_key").write.bucketBy(n, "doc_key").option("path", shared_folder(spark, purpose))
     .option("compression", "uncompressed").saveAsTable(name))
    return spark.table(name)


def portions(batches, column: int):
    """The batches cut into runs of rows with about `PORTION_BYTES` in a (binary) column, at least one row each."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + PORTION_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def plain(bodies: pa.Array) -> list[bytes]:
    """Texts of compressed bodies; a null body is an empty text."""
    expand = zstandard.ZstdDecompressor().decompress
    return [b"" if b is None else expand(b) for b in bodies.to_pylist()]
