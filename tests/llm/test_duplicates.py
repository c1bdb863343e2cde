"""Near-duplicates, repeated spans, embedding links and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from querykiln.llm import embedding_dedup, minhash_dedup, substring_dedup
from querykiln.llm.components import components
from querykiln.llm.words import gram_hashes, word_hashes


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def test_components(spark, frame):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [
        (rng.randint(300, 500), rng.randint(300, 500)) for _ in range(120)] + [(7, 7), (None, 3), (3, None), (4, 3)]
    got = {r.node: r.component for r in components(frame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == roots({x for pair in real for x in pair}, real)
    assert components(frame([], "a long, b long")).count() == 0


def test_word_hashes_do_not_depend_on_grouping():
    texts = [b"a bb  ccc\n", b"", b" \t ", b"x" * 50, b"bb a", b"ccc"]
    h, owner = word_hashes(texts)
    assert Counter(owner.tolist()) == {0: 3, 3: 1, 4: 2, 5: 1}
    alone = np.concatenate([word_hashes([t])[0] for t in texts])
    assert (h == alone).all() and h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4
    long = b" ".join(b"w%d" % i for i in range(600_000))
    assert (word_hashes([long])[0][-3:] == word_hashes([b"w599997 w599998 w599999"])[0]).all()
    assert len(gram_hashes(h, 5)) == 3


def prose(rng, n):
    return [rng.choice("abcdefghijklmnopqrst") + rng.choice("xyzuvw") + str(rng.randint(0, 30)) for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "e" + str(rng.random())
    return out


def near_docs():
    rng = random.Random(11)
    docs = []
    for g in range(12):
        base = prose(rng, 150)
        docs += [" ".join(edited(rng, base, k % 8)) for k in range(9)]
    hot = prose(rng, 120)  # a group with a third of all rows, and exact copies
    docs += [" ".join(edited(rng, hot, k % 4)) for k in range(60)] + [" ".join(hot)] * 30
    line = " ".join(prose(rng, 60))  # many documents share a long passage, but are different
    docs += [line + " " + " ".join(prose(rng, 200)) for _ in range(40)]
    docs += ["one two", "One, two!", "three", "", "", " ", "..."]
    return list(enumerate(docs)) + [(500, None), (501, None)]


def test_minhash_classes_equal_brute_force(spark, frame):
    docs = near_docs()
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.classes(
        frame([(i, t, "own") for i, t in docs], "doc_id long, text string, class_id string")).collect()}
    first, df, vectors = {}, Counter(), {}
    for i, t in docs:
        if t is not None and t not in first:
            first[t] = i
            h, _, times = minhash_dedup.shingles([t.encode()])
            vectors[i] = (h, times)
            df.update(h.tolist())
    weights = minhash_dedup.Weights({h: n for h, n in df.items() if n >= minhash_dedup.COMMON * len(first)}, len(first),
                                    minhash_dedup.COMMON)
    vectors = {i: (h, weights.of(h, times)) for i, (h, times) in vectors.items()}
    ids = sorted(vectors)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if minhash_dedup.similarity(vectors[a], vectors[b]) >= 0.8]
    assert len(links) > 150
    root = roots(ids, links)
    for i, t in docs:
        want = i if t is None else root[first[t]]
        assert got[i] == (want, want == i), i


@pytest.mark.parametrize("block, repeats", [(1 << 20, 64), (500, 3), (1, 1)])
def test_document_frequencies_are_exact(spark, frame, block, repeats):
    from pyarrow import array

    from querykiln.llm.words import plain

    texts = sorted({t for _, t in near_docs() if t is not None})
    press = zstandard.ZstdCompressor().compress
    found = minhash_dedup._frequencies(frame(
        [(n - 50, bytearray(press(t.encode()))) for n, t in enumerate(texts)], "doc_key long, body binary"),
        1 << 29 if block == 500 else 0, block, repeats).collect()
    hashes = [minhash_dedup.shingles([t.encode()])[0] for t in texts]
    df = Counter(x for h in hashes for x in h.tolist())
    got = {r.doc_key: np.frombuffer(plain(array([bytes(r.df)]))[0], dtype=np.uint32).tolist() for r in found}
    assert got == {n - 50: [df[x] for x in h.tolist()] for n, h in enumerate(hashes)} and max(df.values()) > 30


def test_minhash_weighs_by_tf_idf(spark, frame, tmp_path):
    rng = random.Random(7)
    header = " ".join(prose(rng, 60))  # in few of the texts, but most of the words of those
    docs = near_docs() + [(1000 + i, header + " " + " ".join(prose(rng, 5))) for i in range(30)] + [
        (2000 + i, " ".join(prose(rng, 20))) for i in range(200)]
    frame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.op1_minhash_dedup(spark, str(tmp_path)).collect()}
    first = {}
    for i, t in docs:
        if t is not None:
            first.setdefault(t, i)
    shingled = {i: minhash_dedup.shingles([t.encode()])[::2] for t, i in first.items()}
    df = Counter(x for h, _ in shingled.values() for x in h.tolist())
    vectors = {i: (h, times * np.log1p(len(first) / np.array([df[x] for x in h.tolist()]))) for i, (h, times) in shingled.items()}
    ids = sorted(vectors)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if minhash_dedup.similarity(vectors[a], vectors[b]) >= 0.8]
    root = roots(ids, links)
    assert len(links) > 40 and got == {i: (i, True) if t is None else (root[first[t]], root[first[t]] == i) for i, t in docs}
    assert all(got[1000 + i] == (1000 + i, True) for i in range(30))


def test_pipeline_keeps_texts_that_share_a_header(spark, frame):
    import corpus_pipeline

    rng = random.Random(8)
    header = " ".join(prose(rng, 60))
    texts = [header + " " + " ".join(prose(rng, 5)) for _ in range(30)] + [" ".join(prose(rng, 20)) for _ in range(200)]
    docs = frame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == list(range(230))


def test_minhash_keeps_one_row_of_each_class(spark, frame):
    rng = random.Random(2)
    text = " ".join(prose(rng, 50))
    rows = [(3, text, "x", 1), (3, text, "x", 1), (9, text, "y", 2), (4, None, "n", 3), (None, "other " + text[:40], None, 4),
            (5, "", "e", 5), (6, "", "e", 6)]
    table = frame(rows, "doc_id long, text string, body string, kept long")
    out = minhash_dedup.keep_first(table)
    assert out.columns == table.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [rows[0], *rows[3:6]]))
    assert minhash_dedup.keep_first(frame([], "doc_id long, text string")).count() == 0


def test_samples_collide_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    wa, wb = rng.uniform(1, 5, 300), rng.uniform(1, 5, 300)
    wb[:200] = wa[:200]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    seen = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        order = np.argsort(x)
        _, a = minhash_dedup.band_keys(x[order], np.zeros(300, dtype=int), wa[order])
        _, b = minhash_dedup.band_keys(x[order], np.zeros(300, dtype=int), wb[order])
        seen.append((a == b).mean())
    assert abs(np.mean(seen) ** (1 / minhash_dedup.ROWS) - want) < 0.03


def brute_spans(docs, window):
    first = {}
    texts = {(i, t) for i, t in docs if t is not None}
    order = sorted(texts, key=lambda d: (d[0] is None, d[0]))
    for i, t in order:
        w = t.encode().split()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (1 << 63, 0)), ((1 << 63) - 1 if i is None else i, s))
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != ((1 << 63) - 1 if i is None else i, s):
                gone |= set(range(s, s + window))
        rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    return sorted(map(repr, out))


def test_repeated_spans_equal_brute_force(spark, frame):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (19, 20, 21, 55, 90)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += prose(rng, rng.randint(0, 40)) + rng.choice(passages)[rng.randint(0, 3):]
        docs.append((i * 7 % 61, "  ".join(words[:1]) + "\n\t".join(words[1:])))
    docs += [(100, "a b " * 40), (101, "a b " * 25 + "c"), (102, "x " * 19), (103, "x " * 20), (104, None), (105, ""),
             (106, docs[3][1]), (107, docs[3][1]), (1, dict(docs)[1]), (None, docs[5][1]), (108, "é\u00a0ü " * 30)]
    table = frame([(i, t, "b") for i, t in docs], "doc_id long, text string, body string")
    got = substring_dedup.spans(table)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_spans(
        docs, 20)
    # Every span is where its source is.
    texts = {i: t.encode().split() for i, t in docs if t is not None}
    for r in got.where("doc_id is not null").collect():
        for s in r.spans:
            if s.source != substring_dedup.NO_ID:
                assert texts[r.doc_id][s.start:s.start + s.length] == texts[s.source][s.source_start:s.source_start + s.length]
    assert substring_dedup.spans(frame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("tile", "leaf"), [(4096, 1024), (16, 5), (4, 30)])
def test_embedding_links_equal_brute_force(spark, frame, tile, leaf):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    vectors = [(b + rng.normal(scale=s, size=8)).tolist() for b in base for s in (0.05, 0.1, 0.3)]
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[0]], [0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8,
                                    [float("inf")] + [0.0] * 7, [1e300] * 8, [1e-300] * 8, [1.0, 2.0], [2.0, 4.1]]
    rows = [(i * 3 % 1000, v, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], 1)]
    got = embedding_dedup.links(frame(rows, "vec_id long, embedding array<double>, n_links int"), tile=tile, leaf=leaf)

    def usable(i, v):
        return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = {i: np.array(v) / max(map(abs, v)) for i, v, _ in rows if usable(i, v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    n, root = Counter(a for a, _ in links), roots([r[0] for r in rows if r[0] is not None], links)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr((
        i, n[i], root.get(i), i is not None and root[i] == i)) for i, _, _ in rows)


def test_cover_tree_covers_and_prunes(spark, frame):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 6))
    data = [m / np.linalg.norm(m) + rng.normal(scale=s, size=6) for m in middles for s in [0.02] * 30 + [0.2] * 5]
    data += [middles[0] * k for k in range(1, 60)] + [-middles[0]]  # one direction, and its opposite
    table = frame([(i, 1, v.tolist()) for i, v in enumerate(data)], "rep long, copies long, v array<double>")
    reach = 0.4472 + embedding_dedup.SLACK
    nodes, rows = embedding_dedup.cover_tree(table, reach, sample=16, leaf=8)
    nodes_by, rows = {r.node: r for r in nodes.collect()}, rows.collect()
    assert sorted(r.rep for r in rows) == list(range(len(data)))
    vector = {r.rep: np.frombuffer(r.v) for r in rows}
    centre = {n: np.frombuffer(r.centre) for n, r in nodes_by.items()}
    for r in rows:
        assert nodes_by[r.node].is_leaf and np.linalg.norm(vector[r.rep] - centre[r.node]) <= nodes_by[r.node].radius + 1e-9
    for n, r in nodes_by.items():
        if r.parent != n:  # levels are nested, halve, and their centres lie apart
            assert r.scale <= nodes_by[r.parent].scale / 2 and np.array_equal(centre[f"{r.parent}/0"], centre[r.parent])
            assert all(np.linalg.norm(centre[n] - centre[m]) > r.scale for m, q in nodes_by.items()
                       if q.parent == r.parent and m != n and q.parent != m)
    assert max(n.count("/") for n in nodes_by) >= 2
    leaves = [n for n, r in nodes_by.items() if r.is_leaf]
    near = [tuple(r) for r in embedding_dedup.near_leaves(nodes, reach).collect()]
    assert len(near) == len(set(near)) and all(a <= b for a, b in near)
    assert len(near) < len(leaves) * (len(leaves) + 1) / 4  # most pairs are pruned
    of = {r.rep: r.node for r in rows}
    for a in of:
        for b in of:
            if of[a] <= of[b] and vector[a] @ vector[b] >= 0.9:
                assert (of[a], of[b]) in near


def test_cover_tree_has_as_many_leaves_as_vectors_ask_for(spark, frame):
    # Evenly spread vectors are all farther apart than a ball's radius; a node just too large is split into a few.
    rng = np.random.default_rng(7)
    table = frame([(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 32)))], "rep long, copies long, v array<float>")
    nodes, rows = embedding_dedup.cover_tree(table, 0.4472, sample=32, leaf=20)
    leaves = nodes.where("is_leaf").collect()
    assert sum(r.n for r in leaves) == rows.count() == 1500
    assert len(leaves) <= 6 * 1500 / 20


def test_embedding_links_of_single_precision(spark, frame):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3, 40))
    data = np.concatenate([b + rng.normal(scale=s, size=(60, 40)) for b in base for s in (0.2, 0.45)] + [rng.normal(size=(200, 40))])
    data[5:9, :3] = [0.0, -0.0, 0.0]
    data = data.astype(np.float32)
    data = np.concatenate([data, data[:5], np.where(data[5:9] == 0, 0.0, data[5:9])]).astype(np.float32)
    rows = [(i * 7 % 1009, v.tolist()) for i, v in enumerate(data)]
    got = embedding_dedup.links(frame(rows, "vec_id long, embedding array<float>"), leaf=50, tile=8)
    unit = data.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    ids = [i for i, _ in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a != b]
    n, root = Counter(a for a, _ in links), roots(ids, links)
    assert len(links) > 10000
    assert sorted(map(tuple, got.collect())) == sorted((i, n[i], root[i], root[i] == i) for i in ids)


def test_embedding_ids_of_several_vectors(spark, frame):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, b), (7, [1.0, 0.1, 0.0]), (8, [1.0, 0.0, 0.1]), (3, [0.0, 1.0, 0.1]), (9, [0.0, 0.0, 1.0]), (9, a)]
    got = embedding_dedup.links(frame(rows, "vec_id long, embedding array<double>")).collect()
    # The vectors of 5 have three and one others near; their id joins both groups.
    assert sorted(map(tuple, got)) == [(3, 1, 3, True), (5, 1, 3, False), (5, 3, 3, False), (7, 3, 3, False),
                                       (8, 3, 3, False), (9, 0, 3, False), (9, 3, 3, False)]


def test_embedding_links_of_empty_tables(spark, frame):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.links(frame([], schema)).count() == 0
    assert embedding_dedup.links(frame([(1, None), (2, [0.0])], schema)).where("kept and n_links = 0").count() == 2
