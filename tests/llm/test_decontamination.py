from __future__ import annotations

import random

import numpy as np
import pytest

from sessionlake.llm.decontamination import Decontamination, align, decontamination_stage, find_leaks, op1_benchmark_decontamination, without_leaks
from tests.conftest import SMALL
from tests.llm.data import awkward, edited, frame, sentence
from tests.llm.test_kernel import plain


def smith_waterman(a, b):
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    items, windows = rng.integers(1, 6, (60, 12)).astype(np.uint64), rng.integers(1, 6, (60, 20)).astype(np.uint64)
    windows[:, 15:] = 0
    score, end = align(items, windows)
    assert score.tolist() == [smith_waterman(a, b[:15]) for a, b in zip(items.tolist(), windows.tolist(), strict=True)]
    assert (end < 15).all()


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        w = plain(text)
        for i, item in items:
            v = plain(item)
            if len(v) < 3:  # shorter than a seed
                hit = any(w[k : k + len(v)] == v for k in range(len(w))) if v else False
            else:
                hit = smith_waterman(v, w) >= least * 2 * len(v)
            if hit:
                out.add((d, i))
    return out


def test_is_brute_force(spark):
    rng = random.Random(2)
    items = [(k, sentence(rng, rng.randrange(12, 30))) for k in range(12)] + [(50, "two words"), (51, None), (52, ""), (53, "one")]
    texts = awkward(rng)[:9] + [sentence(rng, 60) for _ in range(15)]
    for _, item in items[:12]:
        texts.append(f"{sentence(rng, 20)} {item} {sentence(rng, 10)}")
        texts.append(f"{sentence(rng, 20)} {edited(rng, item, 0.12)} {sentence(rng, 10)}")
    cut = items[0][1].split()
    texts += [" ".join(cut[: len(cut) * 3 // 4]), " ".join([*cut[:8], "extra", "words", *cut[8:]]), items[1][1].upper(), "so two words here", f"{items[2][1]} {items[2][1]} {items[3][1]}"]
    docs = list(enumerate(texts, 1))
    got = find_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), Decontamination(least_score=0.5)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 0.5)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    for r in got:
        raw = texts[r.doc_id - 1].encode()[r.first_byte : r.end_byte].decode()
        assert plain(raw) == plain(texts[r.doc_id - 1])[r.first_word : r.end_word]
        assert smith_waterman(plain(dict(items)[r.item_id]), plain(raw)) == r.score


def test_items_in_most_documents_and_blocks(spark):
    rng = random.Random(3)
    item, other = sentence(rng, 25), sentence(rng, 25)
    texts = [f"{sentence(rng, 10)} {item} {sentence(rng, 10)}" for _ in range(200)] + [edited(rng, item, 0.1), f"x {other} y"] + [sentence(rng, 40) for _ in range(20)]
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    for conf in (Decontamination(), Decontamination(block_chars=150), Decontamination(rare_docs=1)):
        assert {(r.doc_id, r.item_id) for r in find_leaks(frame(spark, texts), bench, conf).collect()} == {(k, 1) for k in range(1, 202)} | {(202, 2)}


def test_edge_tables(spark):
    docs = frame(spark, ["a b c d e", None])
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").selectExpr("*", "3 AS doc_id", "'z' AS seed")
    assert [(r.doc_id, r.item_id, r.similarity) for r in find_leaks(docs, bench).collect()] == [(1, 1, 1.0)]
    assert find_leaks(docs, bench.limit(0)).collect() == []
    assert find_leaks(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_planted_leaks(spark, share, tmp_path):
    rng = random.Random(4)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    clean = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = clean + [f"{clean[k % len(clean)]}\n{edited(rng, t, share)}" for k, (_, t) in enumerate(items)]
    frame(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op1_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert {(len(clean) + 1 + k, i) for k, (i, _) in enumerate(items)} <= got
    kept = {r.doc_id for r in decontamination_stage(spark, frame(spark, texts), str(tmp_path)).collect()}
    assert kept == set(range(1, len(texts) + 1)) - {d for d, _ in got}


def test_edited_and_half_copies_in_hundreds_of_documents(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, 40)) for k in range(4)]
    changed = items[0][1].split(" ")
    for k in range(3, 40, 7):  # six words of one edit, found in every copy
        changed[k] = f"other{k}"
    half = " ".join(items[1][1].split(" ")[:20])
    copies = [" ".join(changed)] * 300 + [half] * 300 + [f"{items[2][1].upper()}"] * 20
    texts = [f"{sentence(rng, 12)} {c} {sentence(rng, 12)}" for c in copies] + [sentence(rng, 60) for _ in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(list(enumerate(texts, 1)), items, 0.4)
    assert {(k, 0) for k in range(1, 301)} | {(k, 1) for k in range(301, 601)} <= expected
    for conf in (Decontamination(), Decontamination(piece=50), Decontamination(pairs=3, window_words=40)):
        assert {(r.doc_id, r.item_id) for r in find_leaks(frame(spark, texts), bench, conf).collect()} == expected


def test_case_of_all_scripts_and_punctuation_at_edges(spark):
    item = "été où naît l'élève (ému) à Évreux, très près d'Ükraïne; «ça» ñandú ÆØÅ Ωμέγα"
    texts = [f"before {t} behind" for t in (item, item.upper(), item.title(), item.replace(",", "").replace(";", ".").replace("(", ""))]
    got = find_leaks(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string"), Decontamination(least_score=1.0)).collect()
    found = {r.doc_id: texts[r.doc_id - 1].encode()[r.first_byte : r.end_byte].decode() for r in got}
    assert found == {k: t.removeprefix("before ").removesuffix(" behind") for k, t in enumerate(texts, 1)}


def test_many_blocks_one_at_a_time(spark, monkeypatch):
    """Each block's index is gone before the next one is built, and the results are those of one block."""
    rng = random.Random(6)
    items = [(k, sentence(rng, 20)) for k in range(30)]
    texts = [f"{sentence(rng, 12)} {items[k][1] if k % 2 else ''} {sentence(rng, 12)}" for k in range(30)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), frame(spark, texts)
    conf, live, most = Decontamination(block_chars=600), set(), []
    kind = type(spark.sparkContext.broadcast(0))
    destroy, context = kind.destroy, type(spark.sparkContext)
    send = context.broadcast

    def sent(self, value):
        b = send(self, value)
        live.add(id(b))
        most.append(len(live))
        return b

    def gone(self, *a):
        live.discard(id(self))
        return destroy(self, *a)

    monkeypatch.setattr(context, "broadcast", sent)
    monkeypatch.setattr(kind, "destroy", gone)
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, conf).collect()}
    assert not live
    assert len(most) >= 12
    assert max(most) == 1
    kept = {r.doc_id for r in without_leaks(docs, bench, conf).collect()}
    monkeypatch.undo()
    assert got == {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()} == {(k + 1, k) for k in range(1, 30, 2)}
    assert kept == set(range(1, 31, 2))


def test_stage_keeps_odd_rows(spark):
    rng = random.Random(7)
    item = sentence(rng, 20)
    rows = [(1, f"x {item}"), (1, f"x {item}"), (2, None), (None, ""), (None, item), (3, "clean"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'s' AS seed", "2 AS row")
    bench = spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string")
    out = without_leaks(docs, bench)
    assert out.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == sorted([(2, None), (None, ""), (3, "clean"), (3, "clean")], key=repr)
    assert without_leaks(docs, bench.limit(0)).count() == len(rows)
    assert without_leaks(docs.limit(0), bench).collect() == []
