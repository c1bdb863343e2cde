"""Decontamination, language, quality, secrets and URL rules on small made-up tables."""

import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from querykiln.llm import decontamination as wm
from querykiln.llm import language, quality, secret_scan, url_rules

DOCS = "doc_id long, text string, n_words string"


def brute_windows(text, size=10):
    words = wm.words_of(text.encode())
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize("block_bytes", [4 << 20, 60])
def test_decontamination_equals_brute_force(spark, frame, block_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice(["A", "b", "Ça", "dd", "e1", "ff"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 12])))) for i in range(6)]
    items += [(6, None), (7, ""), (7, "zz zz"), (None, "q r s"), (3, items[3][1])]
    docs = [(i, ", ".join(word() for _ in range(rng.choice([0, 5, 40, 200]))), "x") for i in range(40)]
    docs += [(90, None, "x"), (91, "", "x"), (92, "q r s zz zz", "x"), (92, "q r s zz zz", "x"), (None, "q-R-S", None),
             (93, "w " * 30000 + "q r s", "x")]
    got = wm.mark(frame(docs, DOCS), frame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got.columns.count("n_words") == 1
    want = []
    for doc_id, text, _ in docs:
        words = wm.words_of((text or "").encode())
        hit, found = set(), set()
        for item, content in items:
            for window in brute_windows(content) if content else ():
                for at in range(len(words) - len(window) + 1):
                    if tuple(words[at:at + len(window)]) == window:
                        hit |= set(range(at, at + len(window)))
                        found.add("null" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert wm.clean(frame(docs, DOCS), frame(items, "item_id long, text string")).columns == ["doc_id", "text", "n_words"]


def test_decontamination_of_empty_tables(spark, frame):
    assert wm.mark(frame([], DOCS), frame([(1, "a b")], "item_id long, text string")).count() == 0
    assert wm.mark(frame([(1, "a b", "")], DOCS), frame([], "item_id long, text string")).first()["contaminated"] is False


def test_wu_manber_finds_every_overlap():
    found = wm.WuManber({(b"a", b"a", b"a"): {"1"}, (b"b",): {"2"}, (b"a", b"b"): {"3"}}).search([b"a"] * 4 + [b"b"])
    assert sorted((s, n) for s, n, _ in found) == [(0, 3), (1, 3), (3, 2), (4, 1)]


def test_language_separates_and_rejects(spark, frame):
    rng = random.Random(2)
    words = {"aa": ["the", "house", "with", "garden"], "bb": ["und", "haus", "nicht", "garten"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    schema = "doc_id long, text string, lang string, score string"
    train = [(i, text(lang, 60), lang, "s") for i in range(40) for lang in words] + [(99, None, "aa", ""), (98, "x", None, "")]
    model = language.train(frame(train, schema), "doc_id")
    assert set(model) == {"aa", "bb"} and model == language.train(frame(train[::-1], schema), "doc_id")
    docs = [(i, text(lang, 30), lang, "s") for i in range(20) for lang in words]
    docs += [(50, None, "aa", ""), (51, "", "aa", ""), (52, "12 !!", "aa", ""), (53, text("aa", 20000), "aa", ""),
             (60, "½ ²", "aa", ""), (61, "Ⅷ ①", "aa", "")]
    got = language.identify(frame(docs, schema), model).collect()
    for r in got:
        assert r.lang_best == ("und" if r.doc_id in (50, 51, 52, 60, 61) else r.lang) and 0 <= r.score <= 1
    assert all(r.lang_accepted in (None, r.lang_best) for r in got)
    assert all(r.lang_accepted is None for r in language.identify(frame(docs, schema), model, min_margin=2.0).collect())
    assert language.identify(frame([], schema), model).count() == 0
    assert {r.lang_best for r in language.identify(frame(docs, schema), {}).collect()} == {"und"}


def test_language_dictionary_has_a_piece_of_every_sampled_text(spark, frame):
    texts = [(i, " ".join(f"w{i}" for _ in range(4000)), "aa") for i in range(150)]
    # A text's opening is no likelier to be learnt than its end.
    texts += [(i, "a" * 20000 + "z" * 20000, "bb") for i in range(1000, 1100)]
    model = language.train(frame(texts, "doc_id long, text string, lang string"), "doc_id")
    assert {w[1:] for w in model["aa"].decode().split() if w.startswith("w")} >= {str(i) for i in range(150)}
    assert 0.3 < model["bb"].count(b"z") / model["bb"].count(b"a") < 3
    assert all(len(d) <= language.DICTIONARY_BYTES for d in model.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not there")
def test_language_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    got = language.op2_language(spark, folder).where("held_out and lang_pred != 'und'").join(labelled, "doc_id").groupBy(
        "lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    assert len(got) == 4 and all(r.right >= 0.9 * r.n for r in got)
    assert sum(r.right for r in got) >= 0.97 * sum(r.n for r in got)


def test_quality_rejects_junk_and_keeps_the_rest(spark, frame):
    rng = random.Random(3)
    syllables = ["an", "er", "the", "in", "ou", "st"]
    good = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    schema = "doc_id long, text string, lang string, perplexity string"
    docs = [(i, good(60), "en", "p") for i in range(150)] + [(i, good(40).upper().replace(" ", "%$ "), "en", "p") for i in range(150, 170)]
    docs += [(200, None, "en", ""), (201, "", "en", ""), (202, "$$ zz", "xx", ""), (203, "$$ zz", None, ""), (None, good(50), "en", "")]
    labels = [(i, 1, 0) for i in range(120)] + [(160, 0, 0), (161, 1, 1), (5, 1, 0), (None, 1, 0)]
    table = frame(docs, schema)
    trusted = quality.trusted_ids(frame(labels, "doc_id long, quality int, toxic int"))
    fitted = quality.fit(quality.trusted_texts(table, trusted))
    got = {r.doc_id: r for r in quality.judge(table, fitted).collect()}
    assert not any(got[i].quality_kept for i in range(150, 170))
    assert sum(got[i].quality_kept for i in range(120, 150)) >= 25
    assert all(got[i].quality_kept and got[i].perplexity is None for i in (200, 201, 202, 203))
    assert quality.keep_good(table, fitted).columns == table.columns
    nothing = quality.fit(quality.trusted_texts(frame([], schema), trusted))
    assert nothing == {} and quality.judge(table, nothing).where("not quality_kept").count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark, frame):
    texts = ["abab abba", "baba", "aab b"]
    counts = {}
    for t in texts:
        for g in quality.grams(quality.symbols(t)).tolist():
            counts[g] = counts.get(g, 0) + 1
    rows = quality.estimate(frame([("x", g, n) for g, n in counts.items()], "lang string, gram long, n long")).toPandas()
    model = quality.Model({int(s): tuple(p[c].to_numpy() for c in ("gram", "prob", "context", "left"))
                           for s, p in rows.groupby("size")})
    import math
    for history in ("abab", "bbbb", "zzzz"):
        total = 0.0
        for symbol in "ab ":
            head, n = model.surprise(history)
            total += math.exp(-(model.surprise(history + symbol)[0] - head))
        assert total < 1 and total > 0.5
    # All symbols of the alphabet and the unseen one together: the unigram level is complete.
    one = rows[rows["size"] == 1]
    assert one.prob.sum() == pytest.approx(1 - one.left.iloc[0] / (len(one) + 1))


def test_kneser_ney_keeps_every_gram_in_every_number_of_buckets(spark, frame):
    grams = {(quality.grams(quality.symbols(f"{a}{b}{c}{d}x"))[-1].item()) for a in "abcdefghijklmnopqrst"
             for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst"}
    model = quality.estimate(frame([("x", g, 1) for g in grams], "lang string, gram long, n long"))
    assert model.where("size = 5").count() == len(grams) == 160000
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("abc de") for _ in range(rng.randint(1, 90))), rng.choice("xy")) for i in range(200)]
    table = frame(docs, "doc_id long, text string, lang string")
    texts = quality.trusted_texts(table, table.where("doc_id < 150"))
    whole, dealt = quality.fit(texts), quality.fit(texts, bucket_grams=100)
    assert {len(v[0]) for v in whole.values()} == {1} and min(len(v[0]) for v in dealt.values()) > 3
    one, many = ({r.doc_id: r.perplexity for r in quality.judge(table, f).collect()} for f in (whole, dealt))
    assert one == pytest.approx(many) and None not in one.values()


def brute_discount(counts):
    """Discounted count of each key, by the counts of counts."""
    n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if all(n[:3]) else None
    d = [max(0.1, k - (k + 1) * y * n[k] / n[k - 1]) if y else 0.5 for k in (1, 2, 3)]
    return {key: max(0.0, c - d[min(c, 3) - 1]) for key, c in counts.items()}


def test_every_probability_is_that_of_kneser_ney(spark, frame):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aabbbc d") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    held = {}
    for t in texts:
        for g in quality.grams(quality.symbols(t)).tolist():
            held[g] = held.get(g, 0) + 1
    got = {(r.size, r.gram): r.prob for r in quality.estimate(
        frame([("x", g, n) for g, n in held.items()], "lang string, gram long, n long")).collect()}
    unpack = lambda g, size: tuple(g >> 12 * (size - 1 - i) & 4095 for i in range(size))
    levels = {5: {unpack(g, 5): n for g, n in held.items()}}
    for size in (4, 3, 2, 1):
        levels[size] = {}
        for g in levels[size + 1]:
            levels[size][g[1:]] = levels[size].get(g[1:], 0) + 1
    lower = {}
    for size in range(1, 6):
        own = brute_discount(levels[size])
        now = {}
        for g in levels[size]:
            follow = [k for k in levels[size] if k[:-1] == g[:-1]]
            total = sum(levels[size][k] for k in follow)
            left = 1 - sum(own[k] for k in follow) / total
            now[g] = own[g] / total + left * (lower[g[1:]] if size > 1 else 1 / (len(levels[1]) + 1))
        packed = {(size, sum(x << 12 * (size - 1 - i) for i, x in enumerate(g))): p for g, p in now.items()}
        assert {k: v for k, v in got.items() if k[0] == size} == pytest.approx(packed)
        lower = now


def brute_gains(texts, least):
    """(lang, word) -> gain, from (lang, text, toxic) with words of letters."""
    out = {}
    for lang in {t[0] for t in texts}:
        own, other = {}, {}
        for toxic in (True, False):
            split = [t[1].lower().split() for t in texts if t[0] == lang and t[2] == toxic]
            counts = {w: sum(w in x for x in split) for x in split for w in x}
            if toxic:
                before = {(b, w) for x in split for b, w in zip(["", *x], x)}  # noqa: B905
                counts = {w: min(n, sum(w == p[1] for p in before)) for w, n in counts.items()}
            if not counts:
                break
            found = brute_discount(counts)
            total = sum(counts.values())
            own[toxic] = {w: x / total for w, x in found.items()}
            other[toxic] = (1 - sum(own[toxic].values())) / (len(counts) + 1)
        if len(own) == 2:
            for w, p in own[True].items():
                ratio = math.log((p + other[True]) / other[True] / ((own[False].get(w, 0) + other[False]) / other[False]))
                if ratio > least:
                    out[lang, quality.letter_words([w])[0].item()] = ratio - least
    return out


def labelled(rng, lang, n, toxic, words=("the", "house", "garden", "und", "haus", "été", "wind", "sea", "stone")):
    insults = {"aa": ["Idiot", "scum"], "bb": ["Blödian", "réeux"], "cc": ["zz"]}[lang]
    text = [rng.choice(words) + rng.choice(["", "n", "rs", "ly"]) for _ in range(n)]
    for _ in range(max(1, n // 30) if toxic else 0):
        text.insert(rng.randint(0, len(text)), rng.choice(insults))
    return " ".join(text)


def test_toxic_words_equal_brute_force(spark, frame):
    rng = random.Random(11)
    texts = [(lang, labelled(rng, lang, rng.randint(1, 40), toxic), toxic) for lang in ("aa", "bb")
             for toxic in (False, True) for _ in range(25)] + [("cc", labelled(rng, "cc", 5, True), True)]
    texts += [("aa", "one passage that copies share", True)] * 20
    docs = frame([(i, t, lang) for i, (lang, t, _) in enumerate(texts)], "doc_id long, text string, lang string")
    ids = lambda toxic: frame([(i,) for i, t in enumerate(texts) if t[2] == toxic], "doc_id long")
    rows = quality.trusted_texts(docs, ids(False), toxic=ids(True))
    for least in (0.0, 1.0):
        got = {(r.lang, r.word): r.gain for r in quality.toxic_words(rows, least).collect()}
        assert got == pytest.approx(brute_gains(texts, least))
    idiot, passage = (quality.letter_words([w])[0].item() for w in ("IDIOT", "passage"))
    assert ("aa", idiot) in got and ("aa", passage) not in got


def test_quality_rejects_fluent_toxic_text_in_each_language(spark, frame):
    rng = random.Random(12)
    docs, labels = [], []
    for lang in ("aa", "bb"):
        for i in range(160):
            toxic = i % 4 == 0
            docs.append((len(docs), labelled(rng, lang, 60, toxic), lang, toxic))
            if i < 120:
                labels.append((len(docs) - 1, 1, int(toxic)))
    docs += [(900, None, "aa", None), (901, "", "bb", None), (902, "12 !!", "aa", None)]
    table, labels = frame(docs, "doc_id long, text string, lang string, toxicity boolean"), frame(
        labels, "doc_id long, quality int, toxic int")
    fitted = quality.fit(quality.trusted_texts(table, quality.trusted_ids(labels), toxic=quality.toxic_ids(labels)))
    got = {r.doc_id: r for r in quality.judge(table, fitted).collect()}
    few = quality.fit(quality.trusted_texts(table, quality.trusted_ids(labels), toxic=quality.toxic_ids(labels)), bucket_grams=50)
    assert len(few["aa"][0]) > 3
    for r in quality.judge(table, few).collect():
        assert r.toxicity == (got[r.doc_id].toxicity if r.toxicity is None else pytest.approx(got[r.doc_id].toxicity))
    for lang in ("aa", "bb"):
        new = [(d[3], got[d[0]]) for d in docs if d[2] == lang and d[0] < 320 and d[0] % 160 >= 120]
        assert not any(r.quality_kept for toxic, r in new if toxic)
        assert sum(r.quality_kept for toxic, r in new if not toxic) >= 0.85 * sum(not toxic for toxic, _ in new)
    assert got[900].quality_kept and got[901].toxicity is None and got[902].toxicity == 0.0


def test_secrets_are_found_and_masked(spark, frame):
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    prose = lambda: " ".join(rng.choice(["the", "house", "garden", "window"]) for _ in range(30))
    kinds = [lambda: f"password={hexes(18)}", lambda: f'token = "{hexes(40)}"',
             lambda: "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)),
             lambda: "".join(rng.choice("0123456789") for _ in range(16)), lambda: "HouseGardenWindowThe", lambda: ""]
    schema = "doc_id long, text string, n_chars long, redacted string"
    docs = [(i, f"{prose()} {kinds[i % 6]()} {prose()}", 0, "r") for i in range(240)] + [(900, None, 0, ""), (901, "", 0, "")]
    table = frame(docs, schema)
    scanner = secret_scan.fit(table)
    assert len(scanner.trees) == secret_scan.TREES
    got = {r.doc_id: r for r in secret_scan.scan(table, scanner).collect()}
    for i, text, _, _ in docs:
        assert got[i].n_secrets == (i % 6 < 3 and i < 900), text
    for s in got[0].secrets:
        assert re.fullmatch("[0-9a-f]{18}", got[0].text[s.start:s.start + s.length])
    clean = secret_scan.redact(table, scanner)
    assert clean.columns == table.columns and clean.count() == len(docs)
    row = clean.where("doc_id = 0").first()
    assert "password=[SECRET]" in row.text and row.n_chars == len(row.text)
    assert secret_scan.scan(frame([], schema), secret_scan.fit(frame([], schema))).count() == 0


def test_secret_dictionary_counts_all_documents_alike_at_every_size(spark):
    def words(n):
        kind = F.when(F.col("id") % 500 == 0, "seldom").when(F.col("id") % 5000 == 1, "rare")
        table = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("house"), kind).alias("text"),
                                      F.lit("en").alias("lang"))
        small = spark.range(4).select((F.col("id") + n).alias("doc_id"), F.lit("casa").alias("text"), F.lit("it").alias("lang"))
        return secret_scan.fit(table.union(small), sample=200, lang="lang").lexicon.words

    # In 1 of 500 documents: less than three in a sample of 200; in 1 of 5,000: below the share at each size.
    assert words(8_000) == words(40_000) == {"house", "seldom", "casa"}


def test_url_rules_equal_brute_force(spark, frame):
    rng = random.Random(6)
    hosts = ["net", "a.net", "example.net", "x.example.net", "example.com", "notexample.com", "org", "fr.org", "EXAMPLE.net",
             "example.net.", "..net", "net:80"]
    paths = ["", "/", "/en/", "/en/x", "/de/1?q=/en/", "/fr/#a", "/e"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + [
        None, "", "example.net/en/", "://", "a://b://c/d", "http:///en/"]
    rules = [*url_rules.RULES, ("net", "/en/x", "block"), ("a.net", "", "allow"), ("a.net", "", "block"), ("", "/", "block"),
             (None, "/", "block"), ("x.example.net", None, "block")]
    rows = [(i, u, "mine") for i, u in enumerate(urls)] + [(0, urls[0], "mine")]
    got = url_rules.judge(frame(rows, "page_id long, url string, rule string"),
                          frame(rules, "host string, path string, verdict string")).collect()

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for h, p, v in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        return host, path, best[3], best[4]

    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url)
    empty = url_rules.judge(frame([], "page_id long, url string"), frame(rules, "host string, path string, verdict string"))
    assert empty.count() == 0
    bare = url_rules.judge(frame(rows, "page_id long, url string, rule string"), frame([], "host string, path string, verdict string"))
    assert bare.where(F.col("rule").isNotNull() | (F.col("verdict") != "allow")).count() == 0
