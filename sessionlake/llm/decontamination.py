"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Every item's word n-grams are its seeds. One scan counts the documents that each seed is in.
2. A second scan looks all seeds up. Around each hit lies a window of the item's length, with a margin. A rare seed's
   (one in at most a given share of all documents) is aligned at once. A frequent seed's, which may be that of an item
   which leaked often or of a common phrase, is aligned if the words that it shares with the item could reach the least
   score: an upper bound, so no leak is lost by it.
3. The alignment goes word by word: a match scores 2, a mismatch or gap -1. One that reaches the least share of the
   item's own score (2 a word) is a leak.

Items are the bounded side: a block of at most block_chars characters is sent to the tasks (some 8 bytes a character there).
A larger benchmark is handled block by block, with two scans each: a block's leaks are written, and its index is dropped
everywhere, before the next block is read. No shuffle of texts, no join by hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.kernel import Words, chunks, grams, utf8
from sessionlake.llm.shared import materialise, remove, shared_folder
from sessionlake.session import ship


@dataclass(frozen=True)
class Decontamination:
    seed_words: int = 3
    #: A seed is rare in at most this share of the documents, or in this number.
    rare_share: float = 5e-5
    rare_docs: int = 10
    #: The least alignment score as a share of the item's own.
    least_score: float = 0.4
    #: Words on either side of the place that a seed points to, as a share of the item's words, and at least.
    margin: float = 0.25
    least_margin: int = 4
    block_chars: int = 4_000_000
    #: Windows are made and bounded for about so many hits, and so many words, at a time.
    piece: int = 1_000_000
    #: Pairs, and words of their windows, that are aligned at a time.
    pairs: int = 128
    window_words: int = 500_000

    def most_rare(self, docs: int) -> int:
        """In at most so many documents a seed is rare."""
        return max(self.rare_docs, int(self.rare_share * docs))


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and its end in the window, for each pair of rows; 0 is padding and matches nothing.

    Match 2, mismatch -1, gap -1. The gaps along a row are a running maximum of score + position.
    """
    n, width = windows.shape
    at = np.arange(width, dtype=np.int32)
    score, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(items.shape[1]):
        same = (windows == items[:, k : k + 1]) & (windows != 0)
        row = np.maximum(score[:, :-1] + np.where(same, np.int32(2), np.int32(-1)), score[:, 1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + at, axis=1) - at
        score[:, 1:] = row
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def folded(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of some texts, with the hashes of their lower case in all scripts and without ASCII punctuation at their edges.

    White space doesn't change by folding, so the words are the same ones; a word of punctuation only stays as it is.
    """
    w = Words(data, offsets)
    if len(data) and data.max() >= 0x80:
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        data, offsets = utf8(pc.utf8_lower(texts))
        lower = Words(data, offsets)
    else:
        lower = w
    start, end = lower.start.copy(), lower.end.copy()
    left = right = np.arange(len(start))
    while len(left := left[(start[left] < end[left]) & _EDGE[data[np.minimum(start[left], len(data) - 1)]]]):
        start[left] += 1
    while len(right := right[(start[right] < end[right]) & _EDGE[data[end[right] - 1]]]):
        end[right] -= 1
    some = start < end
    w.hash = lower.hashes(data, np.where(some, start, lower.start), np.where(some, end, lower.end))
    return w


class Index:
    """Items as word hashes, and seeds as sorted hashes with the places they are at."""

    def __init__(self, ids: list[int], texts: list[str | None], conf: Decontamination):
        self.ids, self.conf = np.array(ids, np.int64), conf
        self.items: list[np.ndarray] = []
        for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
            w = folded(data, offsets)
            self.items += [w.hash[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]
        n = conf.seed_words
        parts = [grams(h, min(n, len(h))) if len(h) else h for h in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in parts)])
        # Items shorter than a seed are found by a seed of their own length.
        self.words = np.repeat([min(n, len(h)) for h in self.items], [len(p) for p in parts]).astype(np.int64)
        order = np.lexsort((self.place, self.item, every))
        self.item, self.place, self.words, every = self.item[order], self.place[order], self.words[order], every[order]
        self.seeds, first = np.unique(every, return_index=True)
        self.first = np.append(first, len(every))
        self.rare = np.ones(len(self.seeds), bool)
        # A bitmap over the seeds' upper bits, which most n-grams of a text fail.
        self.shift = np.uint64(64 - 20)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds >> self.shift).astype(np.int64)] = True
        self.lengths = sorted(set(self.words.tolist()))
        self.sizes = np.array([len(h) for h in self.items], np.int64)
        # The items' distinct words, and how often each item (item * number of words + word) has each of its own.
        self.vocabulary, word = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.items]), return_inverse=True)
        self.owned, self.times = np.unique(np.repeat(np.arange(len(self.items)), self.sizes) * len(self.vocabulary) + word, return_counts=True)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word number, seed number) of every seed in the texts, in order of words."""
        at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = w.first[1:]
        for n in self.lengths:
            g = grams(w.hash, n)
            k = np.flatnonzero(self.bits[(g >> self.shift).astype(np.int64)])
            s = np.searchsorted(self.seeds, g[k])
            s[s == len(self.seeds)] = 0
            found = self.seeds[s] == g[k] if len(self.seeds) else np.zeros(len(k), bool)
            k, s = k[found], s[found]
            inside = k + n <= ends[np.searchsorted(ends, k, "right")] if len(k) else np.zeros(0, bool)
            at.append(k[inside])
            seed.append(s[inside])
        at, seed = np.concatenate(at), np.concatenate(seed)
        order = np.lexsort((seed, at))
        return at[order], seed[order]

    def windows(self, w: Words, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first word, word after the last) of the windows around hits that are worth an alignment, joined where those of a row and item overlap."""
        conf = self.conf
        # Each hit times the places its seed has.
        count = self.first[seed + 1] - self.first[seed]
        start = np.repeat(self.first[seed] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at, rare = np.repeat(at, count), np.repeat(self.rare[seed], count)
        item, place = self.item[start], self.place[start]
        row = np.searchsorted(w.first, at, "right") - 1
        size = self.sizes[item]
        margin = np.maximum(conf.least_margin, (conf.margin * size).astype(np.int64))
        a = np.maximum(at - place - margin, w.first[row])
        b = np.minimum(at - place + size + margin, w.first[row + 1])
        order = np.lexsort((a, item, row))
        row, item, a, b, size, rare = row[order], item[order], a[order], b[order], size[order], rare[order]
        group = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (a[1:] > a[:-1] + (size[1:] // 2))])
        k = np.flatnonzero(group)
        row, item, a = row[k], item[k], a[k]
        b, worth = np.maximum.reduceat(b, k), np.logical_or.reduceat(rare, k)
        doubt = np.flatnonzero(~worth)
        if len(doubt):
            word = np.searchsorted(self.vocabulary, w.hash)
            word[word == len(self.vocabulary)] = 0
            word[self.vocabulary[word] != w.hash] = -1
            part = np.cumsum(b[doubt] - a[doubt]) // conf.piece
            for x in np.split(doubt, np.flatnonzero(np.diff(part)) + 1):
                worth[x] = self.shared(word, item[x], a[x], b[x]) >= conf.least_score * self.sizes[item[x]]
        return row[worth], item[worth], a[worth], b[worth]

    def shared(self, word: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words each window has in common with its item, repeats as often as both have them: no alignment matches more."""
        count = b - a
        window = np.repeat(np.arange(len(item)), count)
        word = word[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())]
        window, word = window[word >= 0], word[word >= 0]
        key = item[window] * len(self.vocabulary) + word
        k = np.searchsorted(self.owned, key)
        k[k == len(self.owned)] = 0
        own = self.owned[k] == key
        pair, times = np.unique(window[own] * len(self.owned) + k[own], return_counts=True)
        return np.bincount(pair // len(self.owned), np.minimum(times, self.times[pair % len(self.owned)]), len(item))

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int, int, float, int, int, int, int]]:
        """(row, item id, score, similarity, first word, word after the last, first byte, byte after the last): one for each row and item, the best."""
        conf = self.conf
        for row0, _, data, offsets in chunks(column):
            w = folded(data, offsets)
            at, seed = self.hits(w)
            if not len(at):
                continue
            # Whole rows, as many as have about a piece of hits times places.
            part = np.cumsum(self.first[seed + 1] - self.first[seed]) // conf.piece
            owner = np.searchsorted(w.first, at, "right") - 1
            part = part[np.searchsorted(owner, owner)]
            cut = np.flatnonzero(np.diff(part)) + 1
            found = [self.windows(w, x, y) for x, y in zip(np.split(at, cut), np.split(seed, cut), strict=True)]
            row, item, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            size = self.sizes[item]
            best: dict[tuple[int, int], tuple] = {}
            order = np.argsort(size * (b - a), kind="stable")
            # Batches of bounded numbers of pairs and of words in their windows: long ones are aligned by themselves.
            batch = np.arange(len(order)) // conf.pairs + np.cumsum((b - a)[order]) // conf.window_words
            for part in np.split(order, np.flatnonzero(np.diff(batch)) + 1) if len(order) else []:
                score, end = self.aligned(w.hash, item[part], a[part], b[part])
                for x, s, e in zip(part.tolist(), score.tolist(), end.tolist(), strict=True):
                    if s >= conf.least_score * 2 * size[x] and s > best.get((int(row[x]), int(item[x])), (0,))[0]:
                        best[int(row[x]), int(item[x])] = (s, int(a[x]), int(a[x]) + e + 1)
            for (r, i), (s, a0, stop) in sorted(best.items()):
                _, back = align(self.items[i][None, ::-1], w.hash[None, a0:stop][:, ::-1])
                begin, base = stop - 1 - int(back[0]), int(w.first[r])
                yield row0 + r, int(self.ids[i]), s, s / (2 * len(self.items[i])), begin - base, stop - base, int(w.start[begin] - offsets[r]), int(w.end[stop - 1] - offsets[r])

    def aligned(self, hashes: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        items = np.zeros((len(item), max(len(self.items[i]) for i in item)), np.uint64)
        windows = np.zeros((len(item), int((b - a).max())), np.uint64)
        for k, i in enumerate(item):
            items[k, : len(self.items[i])] = self.items[i]
            windows[k, : b[k] - a[k]] = hashes[a[k] : b[k]]
        return align(items, windows)


def _blocks(benchmark: DataFrame, conf: Decontamination) -> Iterator[tuple[Index, bool]]:
    """Indexes over blocks of items, each of about block_chars characters at most, and whether one is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and trim(text) <> ''")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-chars // conf.block_chars) or 1
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(block.distinct().collect(), key=lambda r: (r.item_id, r.text))
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows], conf), k == n - 1


def _weighed(texts: DataFrame, index: Index, folder: str) -> None:
    """Counts, over all documents, those that each seed is in, which tells rare ones. The counts are a written table; frequent seeds' numbers come to the driver."""
    sent = texts.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        df, docs = np.zeros(len(ix.seeds), np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, data, offsets in chunks(batch.column(0)):
                w = folded(data, offsets)
                at, seed = ix.hits(w)
                row = np.searchsorted(w.first, at, "right") - 1
                df += np.bincount(np.unique(row * len(df) + seed) % len(df), minlength=len(df))
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(df[k], docs))], names=["seed", "n"])

    counts = materialise(texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), f"{folder}/seeds")
    docs = counts.filter("seed = -1").first()
    most = index.conf.most_rare(docs.n if docs else 0)
    index.rare[counts.filter((F.col("seed") >= 0) & (F.col("n") > most)).select("seed").toArrow()["seed"].to_numpy()] = False
    sent.destroy()
    remove(texts.sparkSession, f"{folder}/seeds")


def each_block(docs: DataFrame, benchmark: DataFrame, conf: Decontamination, folder: str, text_col: str = "text") -> Iterator[tuple[Broadcast, bool]]:
    """The index of each block of items, sent to the tasks, and whether it is the last. The caller destroys it before it asks for the next one."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for index, last in _blocks(benchmark, conf):
        _weighed(texts, index, folder)
        yield docs.sparkSession.sparkContext.broadcast(index), last


LEAKS = "doc_id long, item_id long, score long, similarity double, first_word long, end_word long, first_byte long, end_byte long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, conf: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """A row for each row of docs and item that leaked into it: the alignment's score, its share of the item's own, words and UTF-8 bytes.

    An alignment is found if a seed of the item lies in it, however many documents hold that seed; an item of fewer words than a seed only where all its words
    follow one another. Null and empty texts, and items without words, match nothing. Repeated rows are each reported; of equal
    alignments the first stands. Items that repeat an id with another text are each looked for. An empty
    benchmark or table gives no rows. Other columns don't matter.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    folder, parts = shared_folder(spark), []
    for sent, _ in each_block(docs, benchmark, conf, folder, text_col):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(sent.value.leaks(batch.column(1)))
                if got:
                    row, *rest = zip(*got, strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=[c.split()[0] for c in LEAKS.split(", ")])

        parts.append(materialise(texts.mapInArrow(run, LEAKS), f"{folder}/leaks-{len(parts)}"))
        sent.destroy()
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, conf: Decontamination = Decontamination(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of docs into which no item leaked, as they are.

    Rows are judged by their text alone: null and empty ones stay, repeated rows stay or go together, and ids may be null. An empty
    benchmark takes nothing away; an empty table gives no rows. Other columns, of any name, stay as they are. What one block
    leaves is written, and is what the next one looks through.
    """
    folder, where, out, written = shared_folder(docs.sparkSession), docs.columns.index(text_col), docs, []
    for sent, last in each_block(docs, benchmark, conf, folder, text_col):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in sent.value.leaks(batch.column(where))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
        if not last:
            written.append(f"{folder}/clean-{len(written)}")
            out = materialise(out, written[-1])
            sent.destroy()
            remove(docs.sparkSession, *written[-2:-1])
    return out


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that hold no benchmark item, as they are; without_leaks says what becomes of odd rows."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
