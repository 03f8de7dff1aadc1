"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document's ids are cut into full windows and a rest. The rests of a block of documents are placed from
the longest down, each in the open window that it leaves least room in; a segment tree over remaining
capacities finds it in log2(window) steps. Blocks never leave their task: one scan, no shuffle, and
memory is a block's ids (4 bytes each) whatever the table's size or one source's share. A block's last
windows stay partly empty, which costs about a window a block.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.kernel import chunks
from sessionlake.session import ship

WINDOW = 2048
END_ID = 1
#: Runs of so many blanks are encoded apart, in texts of so many characters or more.
LONG_RUN = 200_000


class Capacities:
    """Open windows by remaining capacity: a segment tree of how many windows each range of capacities has."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = self.base + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for need, which is then no longer open; None if there is none."""
        count, at = self.count, self.base + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right sibling has a window
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.base
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset) of each length, none above the window, and the number of windows."""
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Capacities(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        got = tree.take(need) if need < window else None
        capacity, w = got or (window, n)
        n += got is None
        at[k], offset[k] = w, window - capacity
        if capacity > need:
            tree.add(capacity - need, w)
    return at, offset, n


@cache
def _encoding(ranks_file: str, special: tuple[tuple[str, int], ...]):
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


END_OF_TEXT = "<|endoftext|>"
#: Unicode white space, as the tokenizer's pattern takes it.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def byte_bpe_50k() -> Callable[[str], np.ndarray]:
    """ids of byte_bpe_50k.json with add_special_tokens=False, from the same vocabulary as ranks: the ids are equal and take a seventh of the time.

    The pattern engine gives up within a run of about a million blanks. In texts that could hold one, runs of LONG_RUN blanks
    are encoded apart. The pattern makes one piece of a run, but for its last blank where a word follows, and no other
    piece reaches into it, so the ids stay equal.
    """
    import public_tokenizers

    encoding = _encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), ((END_OF_TEXT, 50256),))

    def encode(text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, allowed_special="all")

    def encode_any(text: str) -> np.ndarray:
        if len(text) < LONG_RUN:
            return encode(text)
        parts, at = [], 0
        for m in _BLANKS.finditer(text):
            stop = m.end() if m.end() == len(text) or text.startswith(END_OF_TEXT, m.end()) else m.end() - 1
            parts += [encode(text[at : m.start()]), np.array(encoding._encode_single_piece(text[m.start() : stop]), np.uint32)]
            at = stop
        return np.concatenate([*parts, encode(text[at:])])

    return encode_any


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[str], np.ndarray]] = byte_bpe_50k, window: int = WINDOW, end_id: int = END_ID, block_ids: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row for each piece.

    A null or empty text is its end id alone. Repeated rows are packed again. A text of any length is
    tokenised whole. Null doc_ids stay null. An empty table gives no rows. Other columns don't matter.
    sequence_id holds the task's number in its upper bits, so a task that runs again gives the same.
    """

    def packed(ids: list, starts: list[int], parts: list[np.ndarray], totals: list[int], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(p) for p in parts], np.int64)
        at, offset, n = best_fit_decreasing(lengths, window)
        ends = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(starts, pa.int64()),
                pa.array(lengths),
                pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts).astype("<u4").tobytes())]),
                pa.array(totals, pa.int64()),
                pa.array(at + first),
                pa.array(offset),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        ), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        first = TaskContext.get().partitionId() << 33
        ids, starts, parts, totals, held = [], [], [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, _, data, offsets in chunks(batch.column(1)):
                raw = data.tobytes()
                for k in range(len(offsets) - 1):
                    text = raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
                    got = np.append(encode(text), np.uint32(end_id))
                    for start in range(0, len(got), window):
                        ids.append(keys[row + k])
                        starts.append(start)
                        parts.append(got[start : start + window])
                        totals.append(len(got))
                    held += len(got)
                    if held >= block_ids:
                        out, n = packed(ids, starts, parts, totals, first)
                        for a in range(0, out.num_rows, 4096):
                            yield out.slice(a, 4096)
                        first += n
                        ids, starts, parts, totals, held = [], [], [], [], 0
        if parts:
            out, _ = packed(ids, starts, parts, totals, first)
            for a in range(0, out.num_rows, 4096):
                yield out.slice(a, 4096)

    ship(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: a row for each piece."""
    return piece_digests(pack(docs))
