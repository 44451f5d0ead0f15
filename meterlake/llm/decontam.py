"""Benchmark decontamination by templates: windows with typed placeholders, then a check of what fills them."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.common import by_block, passes, sieve
from meterlake.sources.storage import settle

WINDOW = 8
#: Share of an item's windows that a document must have, with slots that agree.
SHARE = 0.6
#: Words of a window that must not be placeholders.
LITERALS = 3
MEMO = 300_000

#: Unit words of the placeholder <unit>.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams pound pounds lb lbs oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week "
    "weeks month months year years dollar dollars cent cents euro euros percent degrees kmh mph watt watts kw kwh volt "
    "volts amp amps".split()
)
_SYMBOLS = string.punctuation.replace("%", "").replace("$", "") + "$«»“”„‘’…–—¿¡"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([A-Za-z]{1,7})")

#: What a token is: a word, or what its slot holds.
WORD, NUMBER, UNIT, NAME, NOTHING = range(5)


def canonical(token: str) -> tuple[int, str]:
    """Kind and normal form. A capitalised word counts as a name; whether it only starts a sentence is decided later."""
    bare = token.strip(_SYMBOLS)
    low = bare.lower()
    if not low:
        return NOTHING, ""
    if low[0] in "+-0123456789":
        m = _MEASURE.fullmatch(low)
        if _NUMBER.fullmatch(low) or (m and m[2] in UNITS):
            return NUMBER, low
    if low in UNITS:
        return UNIT, low
    if low != bare and bare[0].isupper() and bare[1:] == low[1:] and len(bare) > 1:
        return NAME, low
    return WORD, low


_SLOTS = [0, *(xxhash.xxh64_intdigest(f"<{k}>", 1) for k in (NUMBER, UNIT, NAME)), 0]


class Lexicon(dict):
    """Numbers of the tokens met by one Python worker; columns: hash as a word, hash in a template, kind, end of sentence."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int, bool]] = []
        self.done: tuple[np.ndarray, ...] = tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int8, bool))

    def __missing__(self, token: str) -> int:
        kind, form = canonical(token)
        word = xxhash.xxh64_intdigest(form)
        n = self[token] = len(self.done[0]) + len(self.rows)
        self.rows.append((word, word if kind == WORD else _SLOTS[kind], kind, token[-1] in ".!?:"))
        return n

    def table(self) -> tuple[np.ndarray, ...]:
        if self.rows:
            self.done = tuple(np.append(d, np.array(c, d.dtype)) for d, c in zip(self.done, zip(*self.rows)))
            self.rows = []
        return self.done


_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def windows(tokens: list[list[str]], lexicon: Lexicon, width: int = WINDOW):
    """All template windows of some texts.

    Gives, for every window, the text, its first word, its number of words, the hash, the hash of its words as they are,
    and whether it has enough plain words; and for the
    texts the first word and their number of words; and for the words the hash and whether they fill a slot. A text
    of fewer than ``width`` words is one window. The first word of a sentence is a word, not a name.
    """
    if len(lexicon) > MEMO:
        lexicon.clear()
        lexicon.__init__()
    flat = list(chain.from_iterable(tokens))
    ids = np.fromiter(map(lexicon.__getitem__, flat), np.int64, len(flat))
    word, form, kind, ends = lexicon.table()
    sizes = np.array([len(d) for d in tokens], np.int64)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    kinds = kind[ids]
    first = np.zeros(len(ids), bool)
    first[1:] = ends[ids[:-1]]
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    if not (real := kinds != NOTHING).all():  # tokens of symbols only do not count
        ids, owner, first, kinds = ids[real], owner[real], first[real], kinds[real]
        sizes = np.bincount(owner, minlength=len(tokens))
    is_slot = (kinds != WORD) & ~((kinds == NAME) & first)
    words = word[ids]
    template = np.where(is_slot, form[ids], words)
    n = len(ids)
    begin = np.cumsum(sizes) - sizes
    up, down = _powers(1 << max(10, n.bit_length()))
    sums, raw = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[:n], dtype=np.uint64))) for x in (template, words))
    plain = np.concatenate(([0], np.cumsum(~is_slot)))
    place = np.arange(n) - begin[owner]
    start = np.flatnonzero(place <= np.maximum(sizes - width, 0)[owner])
    owner, place = owner[start], place[start]
    stop = start + np.minimum(width, sizes)[owner]
    hashes, raw = ((x[stop] - x[start]) * down[start] for x in (sums, raw))
    hashes, raw = ((x ^ x >> np.uint64(29)).view(np.int64) for x in (hashes, raw))
    fine = plain[stop] - plain[start] >= np.minimum(LITERALS, stop - start)
    return owner, place, stop - start, hashes, raw, fine, begin, sizes, words, is_slot


_LEXICON = Lexicon()
ROWS = "id bigint, place int, words int, hash bigint, slots array<bigint>"


def _window_rows(width: int, kept: np.ndarray | None, shorter: tuple[int, ...] = ()):
    """mapInArrow: the windows of each row (id, text), and those of ``shorter`` widths; with a sieve only those that pass it.

    A window with too few plain words has the hash of its words as they are and no slots, so that only an exact copy
    matches; one of fewer than ``width`` words has that hash besides.
    """

    def some(ids: pa.Array, tokens: list[list[str]], now: int) -> pa.RecordBatch | None:
        owner, place, count, hashes, raw, fine, begin, sizes, words, is_slot = windows(tokens, _LEXICON, now)
        new = np.full(len(owner), True) if now == width else sizes[owner] > now  # a short text is a window of its own already
        sets = [np.flatnonzero(new & on & (passes(kept, h) if kept is not None else True)) for on, h in ((fine, hashes), (~fine | (count < width), raw))]
        pick = np.concatenate(sets)
        if not len(pick):
            return None
        at = begin[owner[pick]][:, None] + place[pick][:, None] + np.arange(now)
        inside = np.arange(now) < count[pick][:, None]
        at = np.where(inside, at, 0)
        on = is_slot[at] & inside
        on[len(sets[0]) :] = False
        slots = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(on.sum(1)))).astype(np.int32)), pa.array(words[at][on].view(np.int64)))
        keys = np.concatenate([hashes[sets[0]], raw[sets[1]]])
        columns = [ids.take(pa.array(owner[pick])), pa.array(place[pick].astype(np.int32)), pa.array(count[pick].astype(np.int32)), pa.array(keys), slots]
        return pa.RecordBatch.from_arrays(columns, names=["id", "place", "words", "hash", "slots"])

    def run(rows: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        tokens = [t.split() for t in texts]
        for now in (width, *shorter):
            if (out := some(rows.column(0), tokens, now)) is not None:
                yield out

    return by_block(run)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_slots, n_changed, kind) for every document that holds an item.

    Numbers, names and units become typed placeholders; a document matches an item if at least ``share`` of the
    item's windows of ``width`` words occur in it with slots that are filled as in the item or consistently: each filling
    of the item stands for one and the same filling in the occurrence. An occurrence is what lies within one length of
    the item (diagonals, in two shifted rows of buckets, so that a few words more or less do not part it) or the whole
    document; the one with the largest share counts, so one text may hold an item several times. ``kind`` is ``exact`` if no filling differs, else
    ``changed``. An item of fewer words is one window, looked for anywhere in a text if it has LITERALS words or more, else
    as a whole text. A window with fewer than three plain words is evidence only where its words are the same.
    Null texts and ids match nothing; repeated rows and items give one row; other columns are ignored.

    Windows of the documents are thinned out by a sieve of fixed size before the hash join, so what is shuffled
    follows the matches and not the corpus.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").alias("id"), "text").distinct()
    items = items.mapInArrow(_window_rows(width, None), ROWS)
    items = items.select(F.col("id").alias("item_id"), F.col("place").alias("at"), "words", "hash", F.col("slots").alias("own"))
    lengths = tuple(r.words for r in items.where(f"words between {min(LITERALS, width)} and {width - 1}").select("words").distinct().orderBy("words").collect())  # fewer than width
    items = items.drop("words")
    totals = items.groupBy("item_id").agg(F.countDistinct("at").alias("total"), (F.max("at") + width).alias("reach"))
    shared = docs.sparkSession.sparkContext.broadcast(sieve(items.select("hash").distinct(), "hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _window_rows(width, shared.value, lengths)(batches)

    found = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text").mapInArrow(run, ROWS)
    found = settle(found.select(F.col("id").alias("doc_id"), "place", "hash", "slots"), "windows")  # used twice
    hits = found.join(items.join(totals.select("item_id", "reach"), "item_id"), "hash")
    bucket = lambda shift: F.floor((F.col("place") - F.col("at") + shift) / F.col("reach")).cast("bigint") * 4
    spots = F.array(F.lit(3).cast("bigint"), bucket(0), bucket(F.floor(F.col("reach") / 2)) + 1)  # 3: the whole document
    hits = hits.withColumn("spot", F.explode(spots)).drop("place", "reach")
    pairs = hits.select("doc_id", "item_id", "spot", "at", F.explode_outer(F.arrays_zip("own", "slots")).alias("s"))
    pairs = pairs.select("doc_id", "item_id", "spot", "at", F.col("s.own").alias("own"), F.col("s.slots").alias("new"))
    # votes for what replaces each filling; the one most often seen is the mapping
    votes = pairs.groupBy("doc_id", "item_id", "spot", "own", "new").agg(F.countDistinct("at").alias("n"))
    best = votes.where("own is not null").groupBy("doc_id", "item_id", "spot", "own").agg(F.max_by("new", F.struct("n", "new")).alias("image"))
    images = best.groupBy("doc_id", "item_id", "spot").agg(
        F.map_from_entries(F.collect_list(F.struct("own", "image"))).alias("image"),  # at most the slots of one item
        F.count(F.lit(1)).alias("n_slots"),
        F.count_if(F.col("own") != F.col("image")).alias("n_changed"),
    )
    checked = hits.join(images, ["doc_id", "item_id", "spot"], "left").withColumn("same", F.col("own") == F.col("slots"))
    checked = checked.withColumn(
        "agrees", F.col("same") | F.forall(F.arrays_zip("own", "slots"), lambda s: F.try_element_at("image", s["own"]) == s["slots"])
    )
    sums = checked.where("agrees").groupBy("doc_id", "item_id", "spot").agg(
        F.countDistinct("at").alias("n_windows"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"),
        F.countDistinct(F.when(F.col("same"), F.col("at"))).alias("n_same"),
    )
    rank = F.struct("n_windows", "n_same", -F.coalesce(F.col("n_changed"), F.lit(0)))
    sums = sums.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_windows", "n_slots", "n_changed"), rank).alias("best")).select("doc_id", "item_id", "best.*")
    out = sums.join(totals, "item_id").withColumn("share", F.col("n_windows") / F.col("total")).where(F.col("share") >= share)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(T.LongType()).alias(c)
    changed = F.coalesce(F.col("n_changed"), F.lit(0)) > 0
    return out.select("doc_id", "item_id", n("n_windows"), "share", n("n_slots"), n("n_changed"), F.when(changed, "changed").otherwise("exact").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows that match no benchmark item, with all their columns; rows without doc_id or text stay."""
    found = matches(docs, benchmark, width, share).select(F.col("doc_id").alias("matched_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["matched_id"], "left_anti")
