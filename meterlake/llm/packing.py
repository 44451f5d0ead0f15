"""Packing token sequences in document order; cuts are chosen by dynamic programming."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from meterlake.llm.common import by_block

WINDOW = 1024
END_ID = 0
#: Cost of a cut in padded tokens: between sentences of a document, and within a sentence.
SENTENCE_CUT = 4
INNER_CUT = 12
#: Documents are planned together until they have about so many tokens.
PLAN_TOKENS = 1 << 20
TOKENIZER = "byte_bpe_50k"


@cache
def encoder(name: str = TOKENIZER) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of ``<name>.json`` by its rank file, which gives the same ids; and which ids end a sentence.

    The tokens that the JSON file adds to the ranks are found in texts as they are by that tokenizer.
    """
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    ends = np.zeros(max([*ranks.values(), *added.values()]) + 1, bool)
    for token, i in ranks.items():
        ends[i] = token[-1:] in (b".", b"!", b"?", b"\n")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), ends


def token_ids(text: str, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a whole text and the closing id."""
    own = encoder(name)[0]
    special = own.special_tokens_set
    ids = own.encode(text, allowed_special="all") if any(t in text for t in special) else own.encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, np.uint32)


def cuts(points: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``points`` of the cuts that cost least.

    ``points`` are increasing token positions from 0, no two further apart than ``window``; ``costs`` what a cut there
    costs. A window over (p_i, p_j] pads window - (p_j - p_i), so
        best[j] = cost[j] + window - p_j + min over p_j - p_i <= window of (best[i] + p_i),
    and the minimum over the sliding range of i is the front of a monotone queue: linear time in all.
    """
    at, added = points.tolist(), (costs.astype(np.int64) + window).tolist()
    back = [0] * len(at)
    queue, keys, head = [0], [0], 0  # keys: best[i] + p_i, increasing
    for j in range(1, len(at)):
        low = at[j] - window
        while at[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        key = keys[head] + added[j]
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(key)
    out, j = [], len(at) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def plan(docs: list[np.ndarray], ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """End positions of the windows over the joined documents."""
    ids = np.concatenate(docs)
    total = len(ids)
    closes = np.cumsum([len(d) for d in docs])
    sentence = np.flatnonzero(ends[ids]) + 1
    cost = np.full(total + 1, INNER_CUT, np.int16)
    cost[sentence] = SENTENCE_CUT
    cost[closes] = 0
    marks = np.union1d(np.union1d(sentence, closes), [0])
    gaps = np.diff(marks)
    step = max(1, window // 16)  # longer sentences may also be cut inside, at such steps
    steps = (gaps - 1) // step
    nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    points = np.union1d(marks, np.repeat(marks[:-1], steps) + nth * step)
    return points[cuts(points, cost[points], window)]


def pieces(docs: list[np.ndarray], ends: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) in order."""
    stops = plan(docs, ends, window).tolist()
    w, at = 0, 0
    begin = 0  # of the window
    for d, ids in enumerate(docs):
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, stops[w] - at)
            yield d, start, take, w, at - begin
            start += take
            at += take
            if at == stops[w]:
                begin, w = at, w + 1


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens, in the order of the rows.

    A null text counts as empty: its only token is the closing id. Repeated rows and null ids are packed as any other
    row; other columns are ignored; an empty table gives no piece. Rows stay where they are read, so nothing is
    shuffled: each task plans its own run of rows, at most about PLAN_TOKENS tokens at a time, and only the last
    window of such a run may be short. sequence_id holds the partition and a count within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = encoder(tokenizer)[1]
        number = TaskContext.get().partitionId() << 40
        ids: list = []
        waiting: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, waiting, size
            rows = list(pieces(waiting, ends, window))
            d, start, length, w, offset = (np.array(c, np.int64) for c in zip(*rows))
            parts = [waiting[a][b : b + c] for a, b, c, _, _ in rows]
            crc = np.array([zlib.crc32(p) for p in parts], np.int64)
            tokens = np.array([len(x) for x in waiting], np.int64)[d]
            columns = [pa.array(ids, pa.int64()).take(pa.array(d)), start, length, crc, tokens, w + number, offset]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int64()))], [*names, "ids"]
            number += int(w[-1]) + 1
            ids, waiting, size = [], [], 0
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

        def block(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for i, text in zip(rows.column(0).to_pylist(), texts):
                waiting.append(got := token_ids(text, tokenizer))
                ids.append(i)
                size += len(got)
                if size >= PLAN_TOKENS:
                    yield flush()

        yield from by_block(block)(batches)
        if waiting:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<bigint>" if with_ids else ""))
