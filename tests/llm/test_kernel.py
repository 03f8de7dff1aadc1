from __future__ import annotations

import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from sessionlake.llm import kernel
from tests.llm.data import awkward, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return WORD.findall((text or "").translate(FOLD))


def test_words_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(1)
    texts = awkward(rng) + [sentence(rng, rng.randrange(40)) for _ in range(200)]
    known: dict[int, str] = {}
    for size in (64, 1 << 20):
        monkeypatch.setattr(kernel, "CHUNK_BYTES", size)
        for column in (pa.array(texts, pa.string()), pa.array(["skip", *texts], pa.large_string()).slice(1)):
            seen = 0
            for w in kernel.words(column):
                for row in range(w.rows):
                    own = w.hash[w.first[row] : w.first[row + 1]].tolist()
                    want = plain(texts[w.row0 + row])
                    assert len(own) == len(want)
                    for h, word in zip(own, want, strict=True):
                        assert known.setdefault(h, word) == word
                    seen += 1
            assert seen == len(texts)
    assert len(set(known.values())) == len(known)


def test_long_texts_come_in_pieces(monkeypatch):
    """Words and shingles of a text are the same however it is cut, words longer than a piece included."""
    rng = random.Random(3)
    texts = [sentence(rng, 900), "  " + "y" * 700 + " z " + "y" * 700 + "\n" + sentence(rng, 50) + "\t" + "é" * 300, "w" * 3000, " " * 2000, "a " * 1000]
    whole = [(w.start.tolist(), w.end.tolist(), w.hash.tolist()) for t in texts for w in kernel.words(pa.array([t]))]
    sets = [s.tolist() for _, s in kernel.shingle_sets(pa.array(texts), 5)]
    monkeypatch.setattr(kernel, "CHUNK_BYTES", 64)
    monkeypatch.setattr(kernel, "LONG_BYTES", 128)
    assert [(w.start.tolist(), w.end.tolist(), w.hash.tolist()) for t in texts for w in kernel.words(pa.array([t]))] == whole
    assert [s.tolist() for _, s in kernel.shingle_sets(pa.array(texts), 5)] == sets
    data, _ = kernel.utf8(pa.array([texts[1]]))
    assert all(a == 0 or kernel.IS_SPACE[data[a]] for a, _ in kernel.pieces(data))
    assert sum(b - a for a, b in kernel.pieces(data)) == len(data)


MEASURE = """
import resource, sys
import numpy as np, pyarrow as pa
from sessionlake.llm import kernel
def peak(): return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
n = 200_000_000
text = np.random.default_rng(1).integers(97, 123, n, dtype=np.uint8)
text[::7] = 32
column = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, n])), pa.py_buffer(text)])
list(kernel.shingle_sets(pa.array(["warm up"]), 5))
before = peak()
(_, s), = kernel.shingle_sets(column, 5)
print(len(s), (peak() - before) / n)
"""


def test_a_text_of_200_mb_takes_few_bytes_a_byte():
    out = subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2], timeout=300).stdout.split()
    assert int(out[0]) > 28_000_000
    assert float(out[1]) < 6


def test_shingle_sets():
    rng = random.Random(2)
    texts = awkward(rng) + [sentence(rng, rng.randrange(12)) for _ in range(100)]
    names: dict[int, tuple] = {}
    for row, s in kernel.shingle_sets(pa.array(texts), 5):
        w = plain(texts[row])
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)
        assert np.all(s[1:] > s[:-1])
        names.update(dict.fromkeys(s.tolist()))
    assert names


def test_empty_columns():
    assert list(kernel.words(pa.array([], pa.string()))) == []
    assert [len(s) for _, s in kernel.shingle_sets(pa.array([None, ""], pa.string()), 5)] == [0, 0]
    assert list(kernel.shingle_sets(pa.chunked_array([], pa.string()), 5)) == []
