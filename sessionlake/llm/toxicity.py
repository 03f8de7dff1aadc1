"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: compatibility forms such as full-width or mathematical letters become plain ones (NFKC), upper case lower case, and
look-alike letters of other scripts and digit substitutions plain letters. Invisible format characters go, and so do combining
diacritics that don't compose with their letter; accented letters are letters of their own. Whatever else is neither
letter, digit nor mark becomes a blank, so patterns that begin or end with a blank match at word edges. A pattern is a word, or the beginning of words. A hit inside an exception
phrase doesn't count. A text's feature is log(1 + 1000 * weighted hits / words); a logistic curve over it
gives the score. Lexicon, exceptions, weights and curve are learnt from labelled rows.
"""

from __future__ import annotations

import pickle
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from math import exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.learning import held_out, labelled_sample, train
from sessionlake.llm.shared import columns, unused
from sessionlake.session import ship

THRESHOLD = 0.5


@dataclass(frozen=True)
class Learning:
    """Bounds of what is learnt. They bound the lexicon, not the texts: every text is scored whole."""

    #: At most about so many labelled rows are learnt from.
    max_rows: int = 12_000
    #: A term is in at least so many toxic texts, with a lower bound of its precision above this.
    min_docs: int = 3
    precision: float = 0.5
    #: Terms are chosen until every toxic text that any of them is in has so many.
    covers: int = 3
    #: Patterns at most, and surest terms that these are chosen from. Rarer insults of a larger language than fits are not learnt.
    size: int = 2_000
    candidates: int = 40_000
    #: Letters of a word's beginnings, from and to; longer beginnings are learnt as whole words only.
    stem: tuple[int, int] = (3, 12)


#: Letters that look like Latin ones, and digits and signs that stand for letters.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
#: Blocks of combining diacritics, first and last.
_DIACRITICS = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))


class _Table(dict):
    """What a character becomes, found when it is first met."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        if kind == "Cf" or any(a <= c <= b for a, b in _DIACRITICS):
            out = ""
        else:
            out = chr(c) if kind[0] in "LNM" else " "
        self[c] = out
        return out


@cache
def _table() -> _Table:
    return _Table({ord(k): v for k, v in _LOOK_ALIKE.items()})


def fold(text: str) -> str:
    """Folded text with a blank before and behind it."""
    return f" {unicodedata.normalize('NFKC', text).lower().translate(_table())} "


@dataclass
class Lexicon:
    """patterns: folded pattern to weight; exceptions: folded phrases in which hits don't count."""

    patterns: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    slope: float = 2.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.patterns.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), self.patterns.get(p), True))
        if len(a):
            a.make_automaton()
        return a

    def weight(self, automaton, folded: str) -> float:
        """Weighted hits outside of exception phrases."""
        if not len(automaton):
            return 0.0
        hits = [(end - got[0] + 1, end + 1, got) for end, got in automaton.iter(folded)]
        covered = sorted((a, b) for a, b, got in hits if len(got) == 3)
        if not covered:
            return sum(got[1] for _, _, got in hits)
        starts, reach = [a for a, _ in covered], np.maximum.accumulate([b for _, b in covered])
        total = 0.0
        for a, b, got in hits:
            k = bisect_right(starts, a)
            if len(got) == 2 and not (k and reach[k - 1] >= b):
                total += got[1]
        return total

    def feature(self, automaton, text: str) -> float:
        folded = fold(text)
        w = self.weight(automaton, folded)
        return log1p(1000 * w / max(20, len(folded.split()))) if w else 0.0

    def score(self, feature: float) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.bias + self.slope * feature))))


def _terms(folded: str, stem: tuple[int, int]) -> set[str]:
    """Words and beginnings of words, with the blanks that anchor them."""
    out, (short, long) = set(), stem
    for w in set(folded.split()):
        if len(w) >= short:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(short, min(len(w), long) + 1))
    return out


def _surely(hits: int, n: int, z: float = 1.96) -> float:
    """Wilson's lower bound of hits / n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope of a logistic curve, with a small ridge on both."""
    design, beta = np.stack([np.ones(len(x)), x], 1), np.array([-2.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn(rows: Iterator[tuple[int, str]], conf: Learning = Learning()) -> Lexicon:  # noqa: B008
    """A lexicon from (toxic, text) rows: terms are chosen greedily. Without toxic rows the lexicon is empty."""
    texts = [(y, fold(t)) for y, t in rows]
    toxic = [f for y, f in texts if y]
    n_clean = len(texts) - len(toxic)
    if not toxic:
        return Lexicon({}, [], -3.0, 2.0)
    # Most terms are in one text alone: hashes tell them apart without keeping their names.
    hashes, often = np.unique(np.concatenate([np.fromiter(map(hash, _terms(f, conf.stem)), np.int64) for f in toxic]), return_counts=True)
    frequent = set(hashes[often >= conf.min_docs].tolist())
    counts: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    names: dict[str, str] = {}
    own_terms = []
    for f in toxic:
        own_terms.append([names.setdefault(t, t) for t in _terms(f, conf.stem) if hash(t) in frequent])
        counts.update(own_terms[-1])
    kept = {t for t, n in counts.items() if n >= conf.min_docs}
    for y, f in texts:
        if not y:
            clean.update(_terms(f, conf.stem) & kept)
    # The classes' own shares don't matter to a term's precision.
    even = len(toxic) / max(1, n_clean)
    sure = {t: s for t in kept if (s := _surely(counts[t], counts[t] + clean[t])) > conf.precision and counts[t] > clean[t] * even * 4}
    # Of terms in the same texts, the shortest beginning generalises best.
    ranked = sorted(sure, key=lambda t: (-sure[t], t[-1] == " ", len(t), t))[: conf.candidates]
    where: dict[str, list[int]] = {t: [] for t in ranked}
    for k, own in enumerate(own_terms):
        for t in own:
            if t in where:
                where[t].append(k)
    need, chosen = [conf.covers] * len(toxic), {}
    seen: set[tuple[int, ...]] = set()
    gains = {t: len(where[t]) * sure[t] for t in ranked}
    order = sorted(ranked, key=lambda t: (-gains[t], t[-1] == " ", len(t), t))
    for t in order:
        docs = tuple(where[t])
        gain = sum(need[k] > 0 for k in docs)
        if gain < max(1, len(docs) // 4) or docs in seen:
            continue
        seen.add(docs)
        chosen[t] = sure[t] * log((counts[t] + 0.5) / (clean[t] + 0.5) * max(1.0, n_clean / len(toxic)))
        for k in docs:
            need[k] -= 1
        if len(chosen) >= conf.size:
            break
    lexicon = Lexicon(chosen)
    lexicon.exceptions = _exceptions(texts, lexicon)
    automaton = lexicon.automaton()
    x = np.array([log1p(1000 * lexicon.weight(automaton, f) / max(20, len(f.split()))) for _, f in texts])
    lexicon.bias, lexicon.slope = _newton(x, np.array([y for y, _ in texts], float))
    return lexicon


def _exceptions(texts: list[tuple[int, str]], lexicon: Lexicon, min_docs: int = 3) -> list[str]:
    """A lexicon word with the word before or behind it, where only clean texts have the pair, at least min_docs of them."""
    automaton, seen = lexicon.automaton(), {0: Counter(), 1: Counter()}
    if not len(automaton):
        return []
    for y, folded in texts:
        pairs = set()
        for end, (n, _) in automaton.iter(folded):
            start = end - n + 2
            stop = folded.find(" ", start)
            before, behind = folded[:start].rsplit(maxsplit=1)[-1:], folded[stop:].split(maxsplit=1)[:1]
            word = folded[start:stop]
            pairs.update([f" {b} {word} " for b in before] + [f" {word} {b} " for b in behind])
        seen[y].update(pairs)
    return sorted(p for p, n in seen[0].items() if n >= min_docs and not seen[1][p])


def train_lexicon(docs: DataFrame, labels: DataFrame, conf: Learning = Learning()) -> Lexicon:  # noqa: B008
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", conf.max_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> bytes:
        return pickle.dumps(learn(((y, t) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), conf))

    return pickle.loads(train(sample, [F.col("y").desc(), F.col("at"), F.col("text")], fit))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs with a score from 0 to 1 of each whole text. One scan, no shuffle.

    A null text is scored as an empty one. Each row is treated by itself; an empty table gives none. A column of docs
    with the score's name is replaced; the other columns, or those in keep, stay.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != score_col] if keep is None else keep
    kept = docs.select(*columns(*keep))
    docs = docs.select(*columns(*keep), *(c.cast("string").alias(unused("text", keep)) for c in columns(text_col)))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(lexicon.feature(automaton, t.as_py() or "")) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], names=[*keep, score_col])

    return docs.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = train_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that score below the threshold, as they are.

    Null and empty texts score as the curve does without hits, and stay unless nearly all labelled texts are toxic. Repeated rows go or
    stay together, null ids don't matter, other columns of any name stay as they are, and an empty table gives no rows.
    """
    lexicon = train_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused("toxicity_score", docs.columns)
    return score_toxicity(docs, lexicon, score_col=name).filter(F.col(name) < THRESHOLD).select(*columns(*docs.columns))
