from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import kernel, quality, toxicity
from sessionlake.llm.kernel import chunks
from sessionlake.llm.learning import labelled_sample
from tests.conftest import SMALL
from tests.llm.data import awkward, frame, sentence

MEDIUM = "/root/testdata/sf0.01"


def outcome(spark, query, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = query(spark, MEDIUM).collect()
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    return [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_on_held_out_rows(spark):
    got = outcome(spark, toxicity.op10_toxicity_lexicon, "toxic")
    right = sum(y == r.predicted for y, r in got) / len(got)
    clean = [r.predicted for y, r in got if not y]
    assert right >= 0.93
    assert np.mean(clean) <= 0.03
    assert all(r.predicted == int(r.score >= 0.5) for _, r in got)


def test_quality_on_held_out_rows(spark):
    got = outcome(spark, quality.op7_ftrl_quality, "quality")
    good, bad = [r.score for y, r in got if y], [r.score for y, r in got if not y]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.3) for _, r in got)
    assert np.mean([s >= 0.3 for s in good]) >= 0.98


def test_folding():
    assert toxicity.fold("1D10T! іdіоt ｉｄｉｏｔ id\u200biot") == " idiot  idiot idiot idiot "


@pytest.mark.parametrize(
    "text",
    ["you grobble", "“grobble”", "«grobble»", "you—grobble—x", "¿grobble?", "a\u00a0grobble", "𝐠𝐫𝐨𝐛𝐛𝐥𝐞", "ｇｒｏｂｂｌｅ", "gr\u00adobble", "g\u0335r\u0336obble", "GROBBLE…", "…gr0bb1e".replace("1", "l"), "「grobble」", "\u200fgrobble\u200e", "x\u2028grobble\U0001f600"],
)
def test_words_are_found_beside_any_mark(text):
    lexicon = toxicity.Lexicon({" grobble ": 3.0})
    assert lexicon.weight(lexicon.automaton(), toxicity.fold(text)) == 3.0


def test_letters_and_marks_stay():
    assert toxicity.fold("é नि ﬁ Ⅷ") == " é नि fi viii "
    assert toxicity.fold("e\u0301") == " é "
    lexicon = toxicity.Lexicon({" grobble ": 3.0})
    assert lexicon.weight(lexicon.automaton(), toxicity.fold("xgrobble grobbleé égrobble")) == 0.0


def test_lexicon_with_exceptions_and_length():
    lex = toxicity.Lexicon({" scum": 2.0, " idiot ": 1.0}, [" pond scum "], -3.0, 2.0)
    a = lex.automaton()
    assert lex.weight(a, toxicity.fold("you scum, idiot")) == 3.0
    assert lex.weight(a, toxicity.fold("the pond scum grows")) == 0.0
    assert lex.weight(a, toxicity.fold("pond scum and scumbag")) == 2.0
    assert lex.weight(a, toxicity.fold("idiotic")) == 0.0
    assert lex.feature(a, "scum " + "x " * 50) > lex.feature(a, "scum " + "x " * 500)
    assert toxicity.Lexicon({}).feature(toxicity.Lexicon({}).automaton(), "scum") == 0.0


def test_learning_finds_words_and_exceptions():
    rng = random.Random(1)
    toxic = [(1, f"{sentence(rng, 30)} {rng.choice(('grobble', 'snarfing', 'snarfed'))} {sentence(rng, 10)}") for _ in range(60)]
    clean = [(0, sentence(rng, 40)) for _ in range(200)] + [(0, f"{sentence(rng, 20)} royal grobble {sentence(rng, 9)}") for _ in range(5)]
    lex = toxicity.learn(iter(toxic + clean))
    a = lex.automaton()
    assert any(" snarf".startswith(p) or p.startswith(" snarf") for p in lex.patterns)
    assert lex.score(lex.feature(a, f"{sentence(rng, 30)} SN4RFED")) > 0.5
    assert lex.score(lex.feature(a, sentence(rng, 30))) < 0.1
    assert " royal grobble " in lex.exceptions
    assert lex.score(lex.feature(a, f"{sentence(rng, 30)} royal grobble")) < 0.5
    assert toxicity.learn(iter([])).patterns == {}
    assert toxicity.learn(iter([(0, "x")])).patterns == {}


def test_dot_products_are_those_of_the_training_rows():
    conf = quality.Ftrl(bits=12)
    rng = random.Random(2)
    texts = awkward(rng) + [sentence(rng, rng.randrange(30)) + " ab### CD!!" for _ in range(30)]
    weights = np.random.default_rng(3).normal(size=(1 << 12) + 1).astype(np.float32)
    column = pa.array(texts, pa.string())
    fast = np.concatenate([quality.dots(d, o, weights, conf) for _, _, d, o in chunks(column)])
    slow = [float(weights[b].astype(float) @ v) for _, b, v in quality.training_rows([0] * len(texts), column, conf)]
    assert fast == pytest.approx(slow, abs=1e-4)


def test_shapes_of_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng, 800) + " A1-b2 " + "Zz9" * 200 + " end", "x" * 5000, "  \n" * 300 + "tail"]
    conf = quality.Ftrl()

    def every():
        return [[(b.tolist(), f.tolist()) for b, f in quality.features(*kernel.utf8(pa.array([t])), conf)] for t in texts]

    want = every()
    monkeypatch.setattr(kernel, "CHUNK_BYTES", 64)
    monkeypatch.setattr(quality, "LONG_BYTES", 128)
    assert every() == want


def test_ftrl_separates():
    conf = quality.Ftrl(bits=12)
    rng = random.Random(4)
    texts = [sentence(rng, 30) if k % 2 else " ".join(w + "###" for w in sentence(rng, 30).split()) for k in range(200)]
    rows = list(quality.training_rows([k % 2 for k in range(200)], pa.array(texts), conf))
    w = quality.fit(rows, conf)
    scores = np.array([w[b] @ v for _, b, v in rows])
    assert scores[1::2].min() > scores[0::2].max()


def test_awkward_rows(spark):
    docs = frame(spark, awkward(random.Random(5))).selectExpr("*", "1 AS score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lex, w = toxicity.train_lexicon(docs, none), quality.train_quality(docs, none)
    assert lex.patterns == {}
    for out in (toxicity.score_toxicity(docs, lex), quality.score_quality(docs, w)):
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        assert out.count() == docs.count()
        assert out.limit(0).collect() == []
    assert {r.score for r in quality.score_quality(docs, w).collect()} == {0.5}


def test_sample_leaves_texts_where_they_are(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = labelled_sample(docs, labels, "toxic", 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
    texts = plan.count("documents.parquet")
    assert texts == 1
    above = plan[: plan.index("text#")]
    assert "Exchange hashpartitioning(doc_id" not in above


M = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_score(text, weights, conf):
    """Word by word and n-gram by n-gram, in whole numbers of Python: the kernel's tables, none of its steps."""
    tables = [[int(x) for x in t] for t in (kernel._BYTE, kernel._STEPS, quality._SHAPE)]
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]

    def gram(hashes):
        return plain_mix((sum(h * tables[1][k] for k, h in enumerate(hashes)) + len(hashes)) & M)

    def word(w):
        return plain_mix(sum(tables[0][c] * pow(kernel._BASE, -i, 1 << 64) for i, c in enumerate(w)) & M)

    def shape(w):
        runs = [k for k, _ in itertools.groupby(int(quality._CLASS[c]) for c in w)]
        return plain_mix(sum(tables[2][c] * pow(kernel._BASE, min(i, conf.runs - 1), 1 << 64) for i, c in enumerate(runs)) & M)

    hashes, shapes = [word(w) for w in words], [shape(w) for w in words]
    again = [int(k > 0 and hashes[k] == hashes[k - 1]) for k in range(len(words))]
    kinds = [[(gram(x[k : k + n]) + kind) & M for k in range(len(x) - n + 1)] for kind, (x, n) in enumerate(((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3)))]
    kinds.append([plain_mix((a + 977) & M) for a in again[1:]])
    total = float(weights[-1])
    for scale, found in zip(conf.scale, kinds, strict=True):
        total += scale * sum(float(weights[plain_mix(g) >> (64 - conf.bits)]) for g in found) / max(1, len(found))
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_quality_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights = quality.train_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r.doc_id: r for r in quality.op7_ftrl_quality(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    short = [k for k, t in texts.items() if len(t or "") < 6000]
    assert len(short) > 0.8 * len(texts)
    for k in short:
        assert got[k].score == pytest.approx(plain_score(texts[k], weights, quality.Ftrl()), abs=1e-4)


def test_ftrl_is_its_formula():
    """Per coordinate, as the update is published, with weights made anew before each row."""
    conf = quality.Ftrl(bits=3, epochs=2)
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(2)), np.sort(rng.choice(9, 4, replace=False)), rng.random(4)) for _ in range(50)]
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        sign = -1.0 if z[i] < 0 else 1.0
        return 0.0 if abs(z[i]) <= conf.l1 else (sign * conf.l1 - z[i]) / ((conf.beta + math.sqrt(n[i])) / conf.alpha + conf.l2)

    for _ in range(2):
        for y, at, x in rows:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
            for i, v in zip(at, x, strict=True):
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / conf.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert quality.fit(rows, conf) == pytest.approx([weight(i) for i in range(9)], abs=1e-6)


def test_toxicity_query_is_brute_force(spark):
    """Every pattern sought at every place by itself."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lex = toxicity.train_lexicon(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.op10_toxicity_lexicon(spark, SMALL).collect()}

    def places(pattern, text):
        at = text.find(pattern)
        while at >= 0:
            yield at, at + len(pattern)
            at = text.find(pattern, at + 1)

    for r in docs.collect():
        folded = toxicity.fold(r.text or "")
        spared = [p for e in lex.exceptions for p in places(e, folded)]
        hits = sum(w for p, w in lex.patterns.items() for a, b in places(p, folded) if not any(c <= a and b <= d for c, d in spared))
        x = math.log1p(1000 * hits / max(20, len(folded.split())))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, lex.bias + lex.slope * x)))), abs=1e-9)
    assert lex.patterns


def test_toxicity_stage_keeps_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, f"{sentence(rng, 30)} {'grobble' if k % 3 == 0 else 'garden'}") for k in range(150)]
    spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([*rows, rows[1], rows[0], (None, None), (None, ""), (None, "grobble grobble")], "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS `text scored`", "3 AS toxicity_score")
    out = toxicity.toxicity_stage(spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes
    kept = sorted([(r.doc_id, r.text) for r in out.collect()], key=repr)
    assert kept == sorted([*(r for r in rows if r[0] % 3), rows[1], (None, None), (None, "")], key=repr)
    assert toxicity.toxicity_stage(spark, docs.limit(0), str(tmp_path)).collect() == []
