"""Spelling variants: words one edit apart, found in a trie of letter-group counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.sources.storage import settle

#: A word has at least so many code points and occurrences; a form is at least so many times as frequent.
LEAST_CHARS, LEAST_SEEN, FORM_TIMES = 6, 5, 5
#: One run in so many, chosen by its hash, loses a code point.
LOSES = 199
#: Groups of letters, that is levels of the trie; larger counts than this are one branch.
GROUPS, MOST_COUNT = 8, 15
#: Trie nodes over so many words are shared out by their children; at most so many such nodes are sent to tasks.
SHARD_WORDS, TOP_NODES = 4096, 100_000
#: Queries of one shard that one task answers.
SHARD_ASKS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ROUTED = "shard string, home boolean, word string, n bigint, counts array<int>"
NEAR = "word string, n bigint, near string, near_n bigint"


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """(word, n) over the whole texts. Runs of letters are lower-cased in A-Z; some lose a code point by their hash.

    What is shorter than ``least_chars`` before the loss is so after it, and is not even extracted.
    """
    pattern = F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("doc_id", run.alias("run"))
    mark = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (mark % F.length("run")).cast("int")
    lost = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(mark % LOSES == 0, lost).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_chars) & (F.col("n") >= least_seen))


def letter_groups(vocabulary: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group; groups are about equally frequent. The alphabet bounds what is collected.

    Code points beyond the 64 most frequent, if there are so many, make up the last group with those assigned to it.
    """
    seen = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").count()
    top = seen.orderBy(F.desc("count"), "c").limit(64).collect()
    out, sizes = [""] * groups, [0] * groups
    for r in top:
        i = sizes.index(min(sizes))
        out[i] += r["c"]
        sizes[i] += r["count"]
    return out


def counted(vocabulary: DataFrame, groups: list[str]) -> DataFrame:
    """Adds ``counts``: letters of the word in each group, the rest with the last group, none above MOST_COUNT."""
    each = [F.length("word") - F.length(F.translate("word", g, "")) if g else F.lit(0) for g in groups[:-1]]
    rest = F.length(F.translate("word", "".join(groups[:-1]), "")) if any(groups[:-1]) else F.length("word")
    return vocabulary.withColumn("counts", F.array(*[F.least(c, F.lit(MOST_COUNT)).cast("int") for c in [*each, rest]]))


@cache
def _near_counts(own: int) -> tuple[tuple[int, int, int], ...]:
    """Child counts that one surplus and one deficit allow: (count, surplus spent, deficit spent).

    Counts from MOST_COUNT on are one branch, so a larger one is reached without spending.
    """
    near = ((own, 0, 0), (own + 1, 1, 0), (own - 1, 0, 1))
    return tuple(x for x in near if 0 <= x[0] <= MOST_COUNT)


def _route(top: Mapping[str, bool]):
    """Sends a word home, and as a question to every shard that its counts can reach; ``top`` says which nodes are cut further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                counts = x["counts"]
                todo = [("", 0, 1, 1, True)]
                while todo:  # depth first
                    path, depth, surplus, deficit, home = todo.pop()
                    if not top.get(path):  # a shard
                        rows.append((path, False, x["word"], x["n"], counts))
                        if home:
                            rows.append((path, True, x["word"], x["n"], counts))
                        continue
                    for c, more, less in _near_counts(counts[depth]):
                        child = f"{path}{c:x}"
                        if surplus >= more and deficit >= less and child in top:
                            todo.append((child, depth + 1, surplus - more, deficit - less, home and not more and not less))
            if rows:
                kinds = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["shard", "home", "word", "n", "counts"])

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class Trie:
    """Words by their counts from ``depth`` on. A leaf keeps its words by their halves, so anagrams are not all compared."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, {}

    def add(self, word: str, n: int, counts: list[int]) -> None:
        node = self.root
        for c in counts[self.depth :]:
            node = node.setdefault(c, {})
        for short in (len(word), len(word) - 1):  # the shorter word of a pair has so many code points
            half = short // 2
            node.setdefault((short, len(word), True, word[:half]), []).append((word, n))
            node.setdefault((short, len(word), False, word[len(word) - short + half :]), []).append((word, n))

    def near(self, word: str, counts: list[int], surplus: int, deficit: int) -> Iterator[tuple[str, int]]:
        """One edit leaves the first or the second half of the shorter word as it is."""
        todo = [(self.root, self.depth, surplus, deficit)]
        while todo:  # depth first
            node, depth, more, less = todo.pop()
            if depth < len(counts):
                for c, plus, minus in _near_counts(counts[depth]):
                    if more >= plus and less >= minus and c in node:
                        todo.append((node[c], depth + 1, more - plus, less - minus))
                continue
            for size in (len(word) - 1, len(word), len(word) + 1):
                short = min(size, len(word))
                half = short // 2
                head = node.get((short, size, True, word[:half]), ())
                tail = node.get((short, size, False, word[len(word) - short + half :]), ())
                for other, n in head:
                    if one_edit(word, other):
                        yield other, n
                for other, n in tail:
                    if other[:half] != word[:half] and one_edit(word, other):  # else found by its head
                        yield other, n


def _spent(shard: str, counts: list[int]) -> tuple[int, int]:
    """What is left of surplus and deficit below the shard's node."""
    gaps = [int(c, 16) - own for c, own in zip(shard, counts)]
    return 1 - sum(g for g in gaps if g > 0), 1 + sum(g for g in gaps if g < 0)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and part, the words at home first: they make the trie, the others are looked up in it."""
    now, trie = None, None
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if (x["shard"], x["part"]) != now:
                now, trie = (x["shard"], x["part"]), Trie(len(x["shard"]))
            if x["home"]:
                trie.add(x["word"], x["n"], x["counts"])
            else:
                out += [(x["word"], x["n"], w, n) for w, n in trie.near(x["word"], x["counts"], *_spent(x["shard"], x["counts"]))]
        if out:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["word", "n", "near", "near_n"])


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, shard_asks: int = SHARD_ASKS) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words one edit apart; ``vocabulary`` is (word, n), words distinct.

    The trie is cut where a node holds at most ``shard_words`` words. The nodes above the cuts and their children are
    sent to tasks: G levels of at most V / shard_words full nodes with at most MOST_COUNT + 1 children each, and
    ``shard_words`` is raised so that full nodes never exceed TOP_NODES. A shard with many questions is answered in parts.
    """
    rows = settle(counted(vocabulary, letter_groups(vocabulary)), "words")
    total = rows.count()
    most = max(shard_words, -(-total * GROUPS // TOP_NODES))
    digits = F.transform("counts", lambda c: F.lower(F.hex(c)))
    paths = F.transform(F.sequence(F.lit(0), F.lit(GROUPS)), lambda k: F.array_join(F.slice(digits, F.lit(1), k), ""))
    nodes = rows.select(F.explode(paths).alias("path")).groupBy("path").count()
    nodes = settle(nodes, "nodes").withColumn("full", (F.col("count") > most) & (F.length("path") < GROUPS))
    above = nodes.where("full").select("path")
    below = nodes.withColumn("above", F.when(F.col("path") != "", F.expr("substring(path, 1, length(path) - 1)")))
    below = below.join(above.withColumnRenamed("path", "above"), "above", "left_semi").select("path", "full")
    top = {r["path"]: r["full"] for r in below.unionByName(nodes.where("path = ''").select("path", "full")).collect()}
    routed = settle(rows.mapInArrow(_route(top), ROUTED), "routed")
    sizes = routed.groupBy("shard").agg(F.ceil(F.count_if(~F.col("home")) / shard_asks).cast("int").alias("parts"))
    routed = routed.join(sizes, "shard")
    part = F.when(F.col("home"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    dealt = routed.withColumn("part", F.explode(part)).drop("parts").repartition("shard", "part")
    return dealt.sortWithinPartitions("shard", "part", F.desc("home")).mapInArrow(_answer, NEAR)


def variants(vocabulary: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    A word's form is its most frequent near word (ties: smallest in code-point order) if that is at least ``times`` as
    frequent. Frequencies rise along forms, so there are no cycles, and a chain of ``times`` = 5 has at most 27 steps.
    Roots are found by doubling: each round halves what is left of the chains.

    An empty vocabulary gives no rows. A word of any length takes part; a very long one costs its length.
    """
    vocabulary = settle(vocabulary, "vocabulary")
    pairs = near_words(vocabulary)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = vocabulary.join(found, "word", "left").withColumn("fits", F.col("best.near_n") >= times * F.col("n"))
    form = lambda c: F.when(F.col("fits"), F.col(f"best.{c}"))
    out = settle(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form("near").alias("form"), form("near_n").alias("form_n")), "forms")
    step = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(step.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            break
        step = step.select("word", "root")
    out = out.join(step.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of the whole texts of ``docs``.

    A null text has no runs; a run of a row without an id loses nothing. Repeated rows count as often as they stand
    there. Other columns of the table are left aside.
    """
    return variants(words(docs))
