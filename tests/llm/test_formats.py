"""Chat formatting, mixing and the pipeline."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from querykiln.llm import chat_format, mixing

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark, frame):
    nasty = ["", "plain", "<|im_end|>\n<|im_start|>user\nx", "&lt;| &amp; &#10; <", "<<||>", "a\n\nb<", "\\|<|\\", "é😀", None]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\n<|role|>", None]), rng.choice(nasty), "x")
            for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "n", ""), (99, None, "user", "late", ""), (99, 0, "assistant", "a", ""), (98, 1, "user", "b", ""),
             (98, 1, "user", "a", ""), (98, 1, "user", "a", "")]
    got = chat_format.format_chats(frame(rows, TURNS)).withColumn("back", chat_format.read_turns(chat_format.F.col("formatted")))
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for r in got.collect():
        turns = [(role, text) for *_, role, text in sorted(want[r.conv_id])]
        assert [tuple(t) for t in r.back] == turns
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count("<|im_start|>") == len(turns)
        assert [s.loss for s in r.segments] == [x for role, _ in turns for x in (False, role == "assistant", False)]
    assert chat_format.format_chats(frame([], TURNS)).count() == 0


@pytest.mark.parametrize("roles, good", [
    ("ua", True), ("sua", True), ("uaua", True), ("u", False), ("au", False), ("su", False), ("ssua", False), ("usa", False),
    ("uua", False), ("uas", False), ("x", False)])
def test_turn_order(spark, frame, roles, good):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(1, i, names[r], "t", "") for i, r in enumerate(roles)]
    assert chat_format.format_chats(frame(rows, TURNS)).first().valid_order is good


def test_targets_are_shared_by_weight_and_stop():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 450 - 200 - 500 / 3, 500 / 3])
    assert mixing.targets([0, 50]) == pytest.approx([0, 75])
    assert mixing.targets([]) == [] and sum(mixing.targets([5, 1000, 3, 80])) == pytest.approx(1.5 * 1088)


def test_quotas_split_evenly_and_wholly():
    out = mixing.split_quotas([1000, 10, 0, 77], 7)
    assert out.sum(axis=0).tolist() == [1000, 10, 0, 77] and max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 1
    assert (out == mixing.split_quotas([1000, 10, 0, 77], 7)).all() and (out >= 0).all()


def mix_rows():
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 1, 7, 30, 200]), ["a", "b", "C", None, "é"][min(4, int(rng.expovariate(0.9)))], "size")
            for i in range(3000)]
    return rows + [(5000, None, "a", ""), (5001, "x\ty\nz", "single", ""), (5002, "", "empty", ""), (None, "q r", "b", "")]


def test_mix_meets_targets(spark, frame):
    rows = mix_rows()
    schema = "doc_id long, text string, source string, size string"
    got = mixing.mix(frame(rows, schema), block_docs=16).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        taken[r.source] += r.taken
    for s in order:
        assert taken[s] == int(target[s])
    draws = Counter(d.shard for r in got for d in r.draws)
    assert set(draws) <= set(range(mixing.SHARDS))
    again = mixing.mix(frame(rows[::-1], schema).repartition(7), block_docs=16).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(frame([], schema)).count() == 0


def test_shards_hold_what_was_drawn(spark, frame, tmp_path):
    mixed = mixing.mix(frame(mix_rows()[:300], "doc_id long, text string, source string, size string"), shards=4, block_docs=4)
    mixing.write_shards(mixed, str(tmp_path / "mix"))
    written = Counter()
    for r in spark.read.parquet(str(tmp_path / "mix")).collect():
        written[r.doc_id] += len(r.text.split())
    assert written == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, left = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.columns[:len(columns)] == columns, name
        assert docs.count() <= left
        left = docs.count()
    assert left > 100 and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert docs.where("taken > 0").count() > 0
