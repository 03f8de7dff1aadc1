from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from sessionlake.llm import packing
from sessionlake.llm.packing import Capacities, best_fit_decreasing, byte_bpe_50k, op9_best_fit_packing, pack
from tests.conftest import SMALL
from tests.llm.data import awkward, frame, sentence


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    encode = byte_bpe_50k()
    odd = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> ", "\u2028x\u00a0y", "don't WE'LL", "١٢٣ 123", "\r\n\r\n  x", "ß" * 50, "e\u0301", "\x00\x01", "日本語 テスト", "a" * 3000]
    chars = "ab éß1'\n\t  <|>日\u00a0.!,"
    for text in odd + [t or "" for t in awkward(rng)] + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("run", "n"), [(" ", 1_000_000), ("\n", 1_000_000), (" \n", 1_000_000), ("\u3000", 300_000), (" ", 2_000_000), ("\t", 10_000_000)])
def test_long_blank_runs(tokenizer, run, n):
    blank, encode = run * (n // len(run)), byte_bpe_50k()
    texts = [f"a{blank}b c"] if n > 1_000_000 else [blank, f"a{blank}b", f"a{blank}", f"{blank}<|endoftext|>b", f"x y{blank}'s{blank}12"]
    for text in texts:
        got, want = encode(text), np.array(tokenizer.encode(text, add_special_tokens=False).ids)
        assert np.array_equal(got, want)


def test_every_run_length_near_the_bound(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 4)
    monkeypatch.setattr(packing, "_BLANKS", re.compile(packing._BLANKS.pattern.replace("200000", "4")))
    rng, encode = random.Random(8), byte_bpe_50k()
    for _ in range(3000):
        text = "".join(rng.choice([" ", "  ", "    ", "\n", "\r\n\n\n", "\t\t\t\t\t", "\xa0\xa0\xa0\xa0", "\x1c\x1c\x1c\x1c", "a", "'s", "1", "!", "é", "<|endoftext|>"]) for _ in range(rng.randrange(12)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_blank_run_in_a_document(spark, tokenizer):
    text = "a" + " " * 1_000_000 + "b"
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    rows = pack(frame(spark, ["x y", text, None])).filter("doc_id = 2").collect()
    assert sum(r.length for r in rows) == len(ids) + 1
    assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: r.start)])[:-1].tolist() == ids


def test_fit_is_best_by_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        window = rng.choice((8, 31, 64))
        lengths = np.array([rng.randrange(1, window + 1) for _ in range(rng.randrange(60))], np.int64)
        at, offset, n = best_fit_decreasing(lengths, window)
        free: list[int] = []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [c for c in free if c >= lengths[k]]
            if fits:
                assert window - offset[k] == min(fits)
                free.remove(min(fits))
            else:
                assert offset[k] == 0
            left = window - int(offset[k]) - int(lengths[k])
            if left:
                free.append(left)
        assert n == len(set(at.tolist()))


def test_segment_tree_finds_the_tightest():
    rng = random.Random(2)
    tree, plain = Capacities(64), []
    for k in range(3000):
        if rng.random() < 0.5:
            c = rng.randrange(1, 65)
            tree.add(c, k)
            plain.append((c, k))
        else:
            need = rng.randrange(1, 65)
            fit = [c for c, _ in plain if c >= need]
            got = tree.take(need)
            if not fit:
                assert got is None
            else:
                assert got[0] == min(fit)
                plain.remove(got)


def test_best_fit_decreasing():
    lengths = np.array([5, 3, 4, 2, 6, 8, 1])
    at, offset, n = best_fit_decreasing(lengths, 8)
    used = defaultdict(list)
    for a, o, length in zip(at, offset, lengths, strict=True):
        used[a].append((o, length))
    assert n == 4
    for pieces in used.values():
        end = 0
        for o, length in sorted(pieces):
            assert o == end
            end += length
        assert end <= 8
    assert best_fit_decreasing(np.zeros(0, np.int64), 8)[2] == 0


@pytest.mark.parametrize("block", [16_000_000, 3000])
def test_round_trip(spark, tokenizer, block):
    rng = random.Random(3)
    texts = awkward(rng) + [sentence(rng, rng.randrange(800)) for _ in range(80)]
    rows = pack(frame(spark, texts), block_ids=block).collect()
    parts, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        parts[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    for k, text in enumerate(texts, 1):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        got = [i for _, ids, _ in sorted(parts[k]) for i in ids]
        assert got == want
        assert {n for *_, n in parts[k]} == {len(want)}
    for pieces in windows.values():
        end = 0
        for o, length in sorted(pieces):
            assert o == end
            end += length
        assert end <= 2048


def test_query_pads_little(spark):
    rows = op9_best_fit_packing(spark, SMALL).collect()
    used, windows = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert windows * 2048 <= used * 1.05 + 2048 * 4
    assert pack(frame(spark, ["x"]).limit(0)).collect() == []
