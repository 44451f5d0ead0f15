"""Near-duplicates by SimHash with a bit-sliced search for fingerprints at a small Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import by_block, passes, sieve
from meterlake.llm.components import components
from meterlake.sources.storage import settle

WORDS = 4
RADIUS = 4
SEED = 42
#: A fingerprint is cut into so many parts more than the radius; a bucket holds those that agree in so many.
AGREE = 2
#: Near copies of the corpus have at least NEAR of their distinct shingles of NEAR_WORDS words in common. Candidates agree in
#: all BAND_ROWS minima of one of BANDS bands (at 0.8 all but 2 pairs in 10000 do) and in all but NEAR_RADIUS bits of
#: the SimHash of their distinct shingles (about 10 +- 3 differ at 0.8); then the sets themselves are compared.
NEAR, NEAR_WORDS, BANDS, BAND_ROWS, NEAR_RADIUS = 0.8, 5, 16, 4, 20
#: Fingerprints of one bucket are compared in chunks of about so many; larger buckets are dealt out as pairs of chunks.
CHUNK = 4096
#: The same where rows carry the sets of their shingles.
NEAR_CHUNK = 1024
#: (row, word of 64 lanes) pairs that are compared at a time.
AT_ONCE = 100_000


def _shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased (A-Z) words, repeats included; fewer words are one shingle."""
    parts = text.encode().lower().split()  # bytes.split cuts at exactly \x20 and \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = (ends[-n:] - 1).tolist()
    hashes = b"".join(map(xxhash.xxh64_digest, (joined[s:e] for s, e in zip(starts.tolist(), stops)), repeat(SEED)))
    return np.frombuffer(hashes, ">u8").astype(np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash over shingles of lower-cased (A-Z) words, repeats included; 0 for a text without words."""
    return _majority(_shingle_hashes(text, words))


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(n, 64)
    full = n - n % 255  # sums of 255 rows fit a byte
    ones = bits[full:].sum(0, dtype=np.int64)
    if full:
        ones = ones + bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row. A null text counts as empty."""

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(by_block(run), "doc_id bigint, fp bigint")


def _bucket_keys(radius: int, parts: int) -> list[Column]:
    """One key for each choice of ``parts - radius`` of the parts of a fingerprint.

    At most ``radius`` parts can hold a differing bit, so two fingerprints within the radius agree on one choice.
    """
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(parts), parts - radius)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed)), F.lit(k)))
    return keys


def near_pairs(fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with low[i] <= j < high[i] whose fingerprints differ in at most ``radius`` bits.

    Bit planes: lane j of word w of plane b holds bit b of fingerprint 64 w + j. Against a row i the planes are
    XORed with bit b of i, and counter planes, as many as the radius needs, with a sticky overflow plane sum 64 distances at a time by
    carry-save steps. Words in which every lane has left the radius (or is out of range) are dropped on the way.
    """
    n, wide = len(fps), (len(fps) + 63) // 64
    padded = np.zeros(wide * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T.reshape(64, wide, 64), axis=2, bitorder="little")).view(np.uint64).reshape(64, wide)
    todo = np.flatnonzero(high > low)
    first, last = low[todo] // 64, (high[todo] - 1) // 64
    spread = last - first + 1
    ends = np.cumsum(spread)
    full = ~np.uint64(0)
    at = 0
    while at < len(todo):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
        wide_of = spread[at:stop]
        rows = np.repeat(todo[at:stop], wide_of)
        word = np.repeat(first[at:stop], wide_of) + np.arange(len(rows)) - np.repeat(np.cumsum(wide_of) - wide_of, wide_of)
        below = np.clip(low[rows] - word * 64, 0, 64).astype(np.uint64)
        above = np.clip(word * 64 + 64 - high[rows], 0, 64).astype(np.uint64)
        live = np.where(below < 64, full << np.minimum(below, np.uint64(63)), np.uint64(0))
        live &= np.where(above < 64, full >> np.minimum(above, np.uint64(63)), np.uint64(0))
        over = np.zeros(len(rows), np.uint64)
        counts = [over.copy() for _ in range((radius + 1).bit_length())]  # ones, twos, fours, ...
        mine = fps[rows]
        for b in range(64):
            x = planes[b][word] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
            for plane in counts:
                carry = plane & x
                plane ^= x
                x = carry
            over |= x
            if b % 8 == 7:
                gone = over | _above(counts, radius)
                live &= ~gone
                keep = live != 0
                if not keep.all():
                    rows, word, mine, live = rows[keep], word[keep], mine[keep], live[keep]
                    counts, over = [plane[keep] for plane in counts], over[keep]
                    if not len(rows):
                        break
        if len(rows):
            lanes = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(lanes)
            yield rows[r], word[r] * 64 + lane
        at = stop


def _above(planes: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, low plane first, is greater than the radius."""
    out = np.zeros_like(planes[0])
    equal = ~out
    for k, plane in reversed(list(enumerate(planes))):
        if radius >> k & 1:
            equal &= plane
        else:
            out |= equal & plane
            equal &= ~plane
    return out


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index reachable from each of n rows; pairs come in bounded portions."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(label, high[open_], low[open_])
            while not np.array_equal(jump := label[label], label):
                label = jump
    return label


def _shares(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of a sorted set with others, none of them empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (len(own) + sizes - common)


def _verified(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], sets: np.ndarray) -> np.ndarray:
    """As _forest, over the pairs whose sets (bytes of sorted hashes) are alike. Rows already linked are not compared."""
    label = np.arange(n)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    for a, b in pairs:
        open_ = (label[a] != label[b]) & (np.minimum(sizes[a], sizes[b]) >= NEAR * np.maximum(sizes[a], sizes[b]))
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        cuts = np.flatnonzero(np.diff(a)) + 1
        for i, others in zip(a[np.append(0, cuts)], np.split(b, cuts)):
            others = others[label[others] != label[i]]
            for k in range(0, len(others), 64):
                part = others[k : k + 64]
                like = part[_shares(np.frombuffer(sets[i], np.uint64), [np.frombuffer(sets[j], np.uint64) for j in part]) >= NEAR]
                if len(like):
                    joined = np.unique(label[np.append(like, i)])
                    label[np.isin(label, joined)] = joined[0]
    return label


def _links(radius: int):
    """mapInArrow over rows sorted by (key, one, two, chunk): a spanning forest of the links of each bucket.

    With columns for a node and a set, only pairs with like sets are links, and nodes are what is linked.
    """

    def solve(key, one, two, chunk, fp, node=None, sets=None) -> pa.RecordBatch | None:
        n = len(fp)
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        high = np.repeat(starts + sizes, sizes)
        second = np.add.reduceat((chunk == one).astype(np.int64), starts)  # rows of the first chunk come first
        low = np.where(one == two, np.arange(n) + 1, np.repeat(starts + second, sizes))
        high = np.where((one != two) & (chunk == two), 0, high)
        pairs = near_pairs(fp.view(np.uint64), low, high, radius)
        label = _forest(n, pairs) if sets is None else _verified(n, pairs, sets)
        fp = fp if node is None else node
        child = np.flatnonzero(label != np.arange(n))
        if not len(child):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[label[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            if not len(kept[0]):
                continue
            whole = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]) | (kept[2] != kept[2][-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            if cut:
                if (out := solve(*(x[:cut] for x in kept))) is not None:
                    yield out
                kept = [x[cut:] for x in kept]
        if kept is not None and len(kept[0]):
            if (out := solve(*kept)) is not None:
                yield out

    return run


def _dealt(keys: DataFrame, sizes: DataFrame, chunk: int, by: str) -> DataFrame:
    """Rows (key, one, two, chunk, ...) of the buckets in ``sizes``; a bucket of more than ``chunk`` rows as pairs of chunks.

    ``by`` is a column that tells the rows of a bucket apart.
    """
    rows = keys.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(by, F.lit(7)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("chunks", "other")


def _linked(dealt: DataFrame, radius: int, more: tuple[str, ...] = ()) -> DataFrame:
    dealt = dealt.select("key", "one", "two", "chunk", "fp", *more).repartition("key", "one", "two")
    return dealt.sortWithinPartitions("key", "one", "two", "chunk", *(more[:1] or ["fp"])).mapInArrow(_links(radius), "a bigint, b bigint")


def links(distinct_fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that are connected at the radius; no bucket is cut short.

    ``distinct_fps`` has one row per fingerprint. A bucket holds fingerprints that agree on a choice of parts. A
    bucket of more than ``chunk`` rows is dealt out as pairs of chunks, so no task gets more than two chunks of it.
    """
    keys = distinct_fps.select("fp", F.explode(F.array(*_bucket_keys(radius, radius + AGREE))).alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _linked(_dealt(keys, sizes, chunk, "fp"), radius)


def classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (long), component_id.

    Documents with fingerprints at ``radius`` or fewer differing bits are linked; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint 0 and link like any other. Repeated rows each get a row.
    A row without doc_id gets its component's id too; component_id is null only where no member has a doc_id.
    Other columns are ignored. An empty table gives an empty result.
    """
    marked = settle(fingerprints(docs, words), "fingerprints")
    groups = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    roots = components(links(groups.select("fp"), radius), "a", "b")
    named = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of NEAR_WORDS words."""
    return np.unique(_shingle_hashes(text, NEAR_WORDS))


_MIX = np.random.default_rng(5).integers(0, 2**63, (3, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima of a set; two sets agree in a minimum with a probability of their similarity."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for i in range(0, len(own), 1024):
        np.minimum(least, ((own[i : i + 1024, None] ^ _MIX[0]) * _MIX[1]).min(0), out=least)
    keys = (least * _MIX[2]).reshape(BANDS, BAND_ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys *= _MIX[0, 0]
    return keys ^ keys >> np.uint64(29)


def near_groups(docs: DataFrame, chunk: int = NEAR_CHUNK) -> DataFrame:
    """doc_id and component_id of every row: texts with at least NEAR of their distinct five-word shingles in common are linked.

    Candidates share a bucket of minima (``bands``) and have fingerprints within NEAR_RADIUS bits (bit-sliced); each
    link is checked on the sets themselves, so nothing is linked by an estimate. Buckets with the same members are
    compared once, and sets are made again only for texts that share a bucket. Rows and ids are treated as in
    ``classes``; texts with the same set are one node.
    """

    def mark(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t) for t in texts]
        nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
        fps = np.fromiter(map(_majority, sets), np.uint64, len(sets))
        keys = np.concatenate([bands(s) if len(s) else np.zeros(BANDS, np.uint64) for s in sets]) if sets else np.zeros(0, np.uint64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), keys], names=["doc_id", "node", "fp", "keys"])

    texts = docs.select("doc_id", "text")
    marked = settle(texts.mapInArrow(by_block(mark), "doc_id bigint, node bigint, fp bigint, keys array<bigint>"), "near-marks")
    groups = settle(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-groups")
    keys = groups.where("keys[0] != 0").select("node", "fp", F.explode("keys").alias("key"))  # not the empty set
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    sizes = sizes.groupBy("n", "who").agg(F.min("key").alias("key")).drop("who")
    dealt = settle(_dealt(keys, sizes, chunk, "node"), "near-buckets")
    wanted = dealt.select("node").distinct().join(groups.select("node", "least"), "node")
    shared = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select("least"), "least"))

    def again(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t).tobytes() for t in texts]
        nodes = np.fromiter(map(xxhash.xxh64_intdigest, sets), np.uint64, len(sets)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())], names=["node", "sets"])

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(passes(shared.value, b.column(0).to_numpy()))) for b in batches)
        yield from by_block(again)(some)

    first = texts.where("doc_id is not null").mapInArrow(those, "node bigint, sets binary")
    unnamed = texts.where("doc_id is null").mapInArrow(by_block(again), "node bigint, sets binary")
    sets = first.unionByName(unnamed).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    roots = components(_linked(dealt.join(sets, "node"), NEAR_RADIUS, ("node", "sets")), "a", "b")
    named = groups.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies, all columns kept; repeated rows once.

    Rows without a doc_id cannot be named by a group and stay.
    """
    kept = near_groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
