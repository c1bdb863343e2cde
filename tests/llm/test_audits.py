"""Source audit, Merkle manifest and license scan against plain definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querykiln.llm import license_scan, merkle_manifest, source_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, position string, spans string"


def documents():
    rng = random.Random(11)
    words = ["das", "Haus", "größer", "the", "Licence", "été", "x1y", "o'clock", "\x00nul", "straße"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 40]))), rng.choice(["de", "en", None, ""]),
             rng.choice(["a", "b", "é", None, "", "Z"]), rng.choice([None, 7]), "x", "y") for i in range(-60, 240)]
    rows += [rows[5]] * 4 + [(None, None, None, None, None, None, None)] * 3 + [(None, "a\nb", "de", "a", 1, "", "")] * 2
    rows += [(17, "other\ntext", "de", "a", 1, "", ""), (1 << 62, "far", "fr", "lone", 3, "", ""), (-(1 << 62), "\n", "fr", "b", 1, "", "")]
    return rows + [(900 + i, "tie " * 2, "xx", f"s{i % 3}", 8, "", "") for i in range(12)] + [(999, "w " * 60_000, "xx", "s1", 120_000, "", "")]


def twin(rows, sql):
    con = duckdb.connect()
    arrow = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    con.register("documents", pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(arrow.items())}))
    out = con.sql(sql)
    return sorted(out.columns), sorted(repr([dict(zip(out.columns, r, strict=True))[c] for c in sorted(out.columns)]) for r in out.fetchall())


def seen(df):
    names = sorted(df.columns)
    return names, sorted(repr([r[c] for c in names]) for r in df.collect())


@pytest.fixture
def query(spark, frame, tmp_path):
    """A registered query over rows, written as a table."""
    def run(operator, rows):
        frame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
        return operator(spark, str(tmp_path))

    return run


@pytest.mark.parametrize("operator, sql", [
    (source_audit.op11_source_audit, source_audit.ORACLE_SQL), (merkle_manifest.op12_merkle_manifest, merkle_manifest.ORACLE_SQL),
    (license_scan.op13_license_scan, license_scan.ORACLE_SQL)])
@pytest.mark.parametrize("many", [True, False])
def test_odd_rows_and_an_empty_table(query, operator, sql, many):
    rows = documents() if many else []
    assert seen(query(operator, rows)) == twin(rows, sql)


def test_audit_by_definition(frame):
    rows = documents()
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in source_audit.audit(frame(rows, DOCS), min_docs=2).collect()}
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang or "", source or ""))
        n[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    want = {}
    for lang, source in groups:
        kept = [t for t in df[lang] if df[lang][t] >= 2]

        def p(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // total for t in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        mine, whole = p(n[lang, source]), p(sum((n[g] for g in groups if g[0] == lang), Counter()))
        pairs = {s: sum(f(mine[t], p(n[lang, s])[t]) for t in kept) for g, s in groups if g == lang and s != source}
        terms = {t: f(mine[t], whole[t]) for t in kept if n[lang, source][t] and mine[t] > whole[t]}
        for part, values, top in (("pair", pairs, None), ("term", terms, 10)):
            order = sorted(values, key=lambda x: (-values[x], x.encode()))[:top]
            want |= {(lang, source, part, x): (values[x], i) for i, x in enumerate(order, 1)}
    assert got == want and len(want) > 60


def test_audit_in_many_small_shards(frame):
    docs = frame(documents(), DOCS)
    assert seen(source_audit.audit(docs, min_docs=2, shard_terms=2, source_block=2)) == seen(source_audit.audit(docs, min_docs=2))


def test_long_texts_are_split_between_terms(frame, monkeypatch):
    docs = frame(documents(), DOCS)
    whole = seen(source_audit.term_counts(docs))
    for text in ("aa bb aa" * 500, "é" * 99):
        parts = list(source_audit._cut(text.encode()))
        assert b"".join(parts).decode() == text
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 64)
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 3, "source": ["s"] * 3, "text": ["Ab c " * 100, None, "ab"]})
    found = source_audit._added([source_audit._split(part, batch) for part in source_audit._slices(batch.column(2))]).to_pylist()
    assert {(r["term"], r["n"], r["docs"]) for r in found} == {("ab", 101, 2), ("c", 100, 1)}
    assert whole == seen(source_audit.term_counts(docs))


def test_probabilities_do_not_overflow():
    import numpy as np

    counts, total = np.array([0, 5, 10 ** 14]), np.array([7, 10 ** 15 + 1, 8 * 10 ** 15])
    assert source_audit.probabilities(counts, total).tolist() == [
        1 + 10 ** 9 * (int(c) + 2) // int(t) for c, t in zip(counts, total, strict=True)]


def test_proofs_fold_to_the_root_and_nothing_else_does(frame):
    rows = documents()
    small = merkle_manifest.manifest(frame(rows, DOCS), block=9).collect()
    large = merkle_manifest.manifest(frame(rows, DOCS)).collect()
    assert sorted(map(repr, small)) == sorted(map(repr, large)) and len({r.root for r in large}) == 1
    for r in large:
        assert merkle_manifest.fold(r.leaf, r.proof) == r.root
        assert merkle_manifest.fold(hashlib.sha256(b"other").hexdigest(), r.proof) != r.root


def test_positions_are_ranks(frame):
    rows = [(i, s, d, f"{i:02}") for i, (s, d) in enumerate(
        [("s", d) for d in (5, 5, 5, None, None, -1, 0, 63, 64, 1 << 40, -(1 << 63), (1 << 63) - 1)] + [("t", 7)])]
    got = merkle_manifest.positions(frame(rows, "rid long, src string, doc_id long, leaf string"))
    by_source = defaultdict(list)
    for rid, s, d, h in rows:
        by_source[s].append((d is not None, d or 0, h, rid))
    want = {(s, rid): i for s, own in by_source.items() for i, (*_, rid) in enumerate(sorted(own))}
    assert {(r.src, r.rid): r.position for r in got.collect()} == want


def test_one_row_is_its_own_root(frame):
    row = merkle_manifest.manifest(frame([(1, "t", "en", "a", 1, "", "")], DOCS)).first()
    assert row.leaf == row.subroot == row.root == hashlib.sha256(b"1:11:a2:en1:11:t").hexdigest() and row.proof == ""


def test_changed_notices_are_found(frame):
    notice = dict(license_scan.NOTICES[:1])["mit"]
    words = notice.split()
    texts = ["intro " * 5 + notice, " ".join(words[:10] + ["truly", "really"] + words[10:]), " ".join(words[:12]), notice.upper(),
             "of this software and of the rights in the software", "mit license mit LICENSE, Mit-license", "a gnu general public license",
             "cc by, " * 2, "", None, "x " * 50_000 + "apache license " * 3]
    rows = [(i, t, "en", "s", 0, "kept", "clash") for i, t in enumerate(texts)] * 2
    got = license_scan.scan(frame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "position", "n_words", "spans"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and {r.text for r in found.values()} == set(texts)
    spans = {i: [(s.label, s.start, s.stop, s.score) for s in r.spans] for i, r in found.items()}
    assert spans[0] == [("mit", 5, 5 + len(license_scan._template_words([("", notice)])[0]), 1.0)] and spans[3][0][3] == 1.0
    assert [(s[0], s[3]) for s in spans[1]] == [("mit", 1.0)] and spans[2] == spans[4] == spans[8] == spans[9] == []
    assert spans[5] == [("mit", 0, 2, 1.0), ("mit", 2, 4, 1.0), ("mit", 4, 6, 1.0)] and spans[6] == [("gpl", 1, 5, 1.0)]
    assert spans[7] == [("cc-by", 0, 2, 1.0), ("cc-by", 2, 4, 1.0)] and [s[1] for s in spans[10]] == [50_000, 50_002, 50_004]
    assert license_scan.scan(frame([], DOCS)).agg(F.count("*")).first()[0] == 0
