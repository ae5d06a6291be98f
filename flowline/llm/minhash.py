"""Near-duplicate documents by Order MinHash with banded alignment.

A text's words (lower case, split at ASCII white space) give a sequence of shingles of five words. Two texts are
similar if, with m shingles aligned in order (a longest common subsequence), m / (n1 + n2 - m) reaches 0.8: Jaccard
similarity that counts only what keeps its order. For the sketches each shingle is labelled with its occurrence
number, so all elements differ; the alignment takes them without labels, as one more refrain renumbers all later ones.

Each of ``SKETCHES`` sketches takes the ``KEPT`` labelled shingles with the lowest hashes and keeps them in text
order; texts that share a sketch are candidates. At similarity 0.8 one sketch agrees with probability of about
0.4, one of all sixteen with 0.9998.

* Texts with equal words are one class at once (a hot group of copies is pre-aggregated to one row).
* In each bucket of equal sketches every text is compared with the bucket's first text only, so a large group of
  near copies costs one comparison for each text and leader. Where a bucket's texts are then still in several
  components, the one with the most links leads a second round.
* What is then still open is settled exactly. A text none of whose possible partners could share enough of its
  shingles, as too many occur in no other open text, is closed. In what is left of a bucket, texts outside its
  largest component (queries) are compared with all texts of other components (entries), in tasks: blocks of
  ``BLOCK`` queries are held while parts of ``BLOCK`` entries stream past, so no row is copied in a bucket of up
  to ``BLOCK`` texts, and only links leave a task.
* Where no common shingle repeats, the alignment is a longest increasing subsequence of the matches within a band: with
  d = n1 + n2 - 2m at most (n1 + n2) / 9, shingles further apart than d never match. Else it is the longest common
  subsequence of all matches, by bit vectors.

Null texts are in no group (a class each). Texts without words are equal to each other; texts of one to four
words have one shingle, all their words. Repeated rows and equal doc_ids with other texts are rows of their own.
A row with a null doc_id links like any other; it names a class (null) only if all doc_ids of the class are null.
An empty table gives an empty result. Extra columns are ignored, and kept as they are by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, spill
from .components import components

WORDS, SIMILAR = 5, 0.8
SKETCHES, KEPT = 16, 4
BLOCK = 512
PART = 1 << 19
CACHE = 1 << 28

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_rng.integers(0, 1 << 31, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
_SEED = _rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint64).astype(np.uint32)[:, None]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(r"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text."""
    raw = [x.lower().encode() for x in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    size = ends - starts
    at = np.flatnonzero(inside)
    power = np.cumprod(np.full(int(size.max()), _ODD[0]))
    value = (data[at].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(starts, size)]
    hashes = mix(np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]])))
    cuts = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])[:-1])
    return np.split(hashes, cuts)


def whole_word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The same, with texts of more than ``PART`` characters in parts that end where a word does, to bound memory."""
    if max(map(len, texts), default=0) <= PART:
        return word_hashes(texts)
    out = []
    for text in texts:
        cuts = [0]
        while len(text) - cuts[-1] > PART and (m := _GAP.search(text, cuts[-1] + PART)):
            cuts.append(m.start())
        found = [word_hashes([text[a:b]])[0] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        out.append(np.concatenate(found))
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in text order."""
    n = len(words)
    if n < WORDS:
        return mix((words * _ODD[1 : n + 1]).sum(keepdims=True) + _ODD[20 + n]) if n else words
    s = words[: n - WORDS + 1] * _ODD[1]
    for j in range(1, WORDS):
        s = s + words[j : n - WORDS + 1 + j] * _ODD[1 + j]
    return mix(s)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """The same, each with its occurrence number mixed in."""
    s = shingles(words)
    if len(words) < WORDS:
        return s
    ordered = np.sort(s)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(s, kind="stable")
        first = np.concatenate([[True], s[order][1:] != s[order][:-1]])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        s = s.copy()
        s[order] += (np.arange(len(s)) - begin).astype(np.uint64) * _ODD[30]
    return mix(s)


def sketches(labelled: np.ndarray) -> np.ndarray:
    """For each hash function the lowest shingles, in text order, as one number."""
    n = len(labelled)
    if n <= KEPT:
        picked = np.broadcast_to(np.arange(n), (SKETCHES, n))
    else:
        h = ((labelled >> np.uint64(32)).astype(np.uint32)[None, :] ^ _SEED) * _MUL
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        picked = np.sort(np.argpartition(h, KEPT - 1, axis=1)[:, :KEPT], axis=1)
    return mix((labelled[picked] * _ODD[40 : 40 + picked.shape[1]]).sum(axis=1) + _ODD[50]).view(np.int64)


def _read(part, taken):
    """Of each text of a batch: its key (a digest of its words) and what is taken of its words."""
    texts = part.column("text").to_pylist()
    for text, words in zip(texts, whole_word_hashes([x or "" for x in texts]), strict=True):
        yield None if text is None else hashlib.blake2b(words.tobytes(), digest_size=16).digest(), taken(words)


def _signatures(batches):
    for part in slices(batches, 512):
        keys, count, drawn = [], [], []
        for key, labelled in _read(part, labelled_shingles):
            keys.append(key)
            count.append(len(labelled))
            drawn.append(sketches(labelled) if len(labelled) else [])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(keys, pa.binary()), pa.array(count, pa.int32()), pa.array(drawn, pa.list_(pa.int64()))], ["doc_id", "th", "key", "n", "sketches"])


def _shingles(batches):
    for part in slices(batches, 512):
        keys, found = zip(*_read(part, shingles), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "shingles"])


def _different_shingles(batches):
    """Each different shingle of a text, and how often it is there."""
    for part in slices(batches, 512):
        for key, raw in zip(part.column("key").to_pylist(), part.column("shingles").to_pylist(), strict=True):
            own, times = np.unique(np.frombuffer(raw, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([key] * len(own), pa.binary()), pa.array(times.astype(np.int32))], ["shingle", "key", "times"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; bit i of ``row`` is 0 where a[i] adds one to it."""
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + start :][::-1] != b[len(b) - n + start :][::-1])
    stop = int(differ[0]) if len(differ) else n - start
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not len(a) or not len(b):
        return start + stop
    order = np.argsort(a, kind="stable")
    values, at = np.unique(a[order], return_index=True)
    places = dict(zip(values.tolist(), np.split(order, at[1:]), strict=True))
    known: dict[int, int] = {}  # bits of repeated shingles, bounded in all

    def bits(value: int) -> int:
        own = places.get(value, ())
        if len(own) < 2:
            return 1 << int(own[0]) if len(own) else 0
        if value not in known:
            if len(known) * len(a) > CACHE:
                known.clear()
            flags = np.zeros(int(own[-1]) + 1, dtype=np.uint8)
            flags[own] = 1
            known[value] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        return known[value]

    every = (1 << len(a)) - 1
    row = every
    for value in b.tolist():
        hits = row & bits(value)
        row = ((row + hits) | (row - hits)) & every
    return start + stop + len(a) - row.bit_count()


def aligned(a: np.ndarray, sorted_b: np.ndarray, order_b: np.ndarray) -> int:
    """How many shingles of two sequences align in order; fewer, if they can't be similar enough."""
    n1, n2 = len(a), len(order_b)
    least = SIMILAR / (1 + SIMILAR) * (n1 + n2) - 1e-9
    if min(n1, n2) < least:
        return 0
    at = np.minimum(np.searchsorted(sorted_b, a), n2 - 1)
    hit = np.flatnonzero(sorted_b[at] == a)
    if len(hit) < least:
        return 0
    if (sorted_b[1:] == sorted_b[:-1]).any() or len(np.unique(a[hit])) < len(hit):
        b = np.empty_like(sorted_b)
        b[order_b] = sorted_b
        return common(a, b)
    there = order_b[at[hit]]
    there = there[np.abs(there - hit) <= (n1 + n2) - 2 * least]
    if len(there) < 2 or (there[1:] > there[:-1]).all():
        return len(there)
    tails: list[int] = []
    for x in there.tolist():  # longest increasing subsequence
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    order = np.argsort(b)
    m = aligned(a, b[order], order)
    return bool(len(a)) and m >= SIMILAR / (1 + SIMILAR) * (len(a) + len(b)) - 1e-9


def _verify(batches):
    known: dict[bytes, tuple] = {}
    for part in slices(batches, 512):
        a, b, sa, sb = (part.column(c).to_pylist() for c in ("a", "b", "sa", "sb"))
        keep = []
        for key, x, y in zip(b, sa, sb, strict=True):
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                other = np.frombuffer(y, dtype=np.uint64)
                order = np.argsort(other)
                known[key] = (other[order], order)
            mine = np.frombuffer(x, dtype=np.uint64)
            total = len(mine) + len(known[key][1])
            keep.append(aligned(mine, *known[key]) >= SIMILAR / (1 + SIMILAR) * total - 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]).filter(pa.array(keep))


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class _Open:
    """Held queries of one bucket, that entries stream past; labels change as links are found."""

    def __init__(self, band: int):
        self.band, self.rows, self.names = band, [], {}
        self.n = np.zeros(0)

    def label(self, component: bytes) -> int:
        return self.names.setdefault(component, len(self.names))

    def hold(self, row: dict) -> None:
        own = np.frombuffer(row["shingles"], dtype=np.uint64)
        order = np.argsort(own)
        self.rows.append((row["key"], own[order], order, self.label(row["label"]), row["n"], row["sketches"]))

    def links(self, row: dict) -> list[tuple[bytes, bytes]]:
        if not len(self.n):
            self.labels = np.array([r[3] for r in self.rows])
            self.n, self.drawn = np.array([r[4] for r in self.rows], dtype=float), np.array([r[5] for r in self.rows])
        key, n, mine, out = row["key"], row["n"], self.label(row["label"]), []
        near = (self.labels != mine) & (np.minimum(self.n, n) >= SIMILAR * np.maximum(self.n, n) - 1e-9)
        # A pair counts in the first bucket that it shares.
        near &= ~(self.drawn[:, : self.band] == np.array(row["sketches"])[: self.band]).any(axis=1)
        shingles = np.frombuffer(row["shingles"], dtype=np.uint64)
        for i in np.flatnonzero(near).tolist():
            other, ordered, order, *_ = self.rows[i]
            if self.labels[i] == mine or (row["asks"] and other > key):
                continue
            if aligned(shingles, ordered, order) >= SIMILAR / (1 + SIMILAR) * (self.n[i] + n) - 1e-9:
                out.append((key, other))
                old = self.labels[i]
                self.labels[self.labels == old] = mine
                self.names = {c: mine if x == old else x for c, x in self.names.items()}
        return out


def _rest(batches):
    """Rows by bucket, block of queries and part of entries, the queries first."""
    at, held = None, None
    for part in slices(batches, 512):
        found = []
        for row in part.to_pylist():
            now = (row["band"], row["h"], row["block"], row["part"])
            if now != at:
                at, held = now, _Open(row["band"])
            if row["held"]:
                held.hold(row)
            else:
                found += held.links(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], schema=LINKS)


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with what names a row: a hash of its text, and its doc_id as two columns without nulls."""
    return docs.withColumns({"__th": F.xxhash64("text"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull()})


def _named_by(at: str) -> list:
    return [F.col(f"{at}.th").alias("__th"), F.coalesce(f"{at}.doc_id", F.lit(0)).alias("__id"), F.col(f"{at}.doc_id").isNull().alias("__none")]


def _verified(pairs: DataFrame, shingles: DataFrame, name: str) -> DataFrame:
    side = lambda c: shingles.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}"))
    return spill(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a binary, b binary"), name)


def _labelled(live: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of buckets with the component of their text, of buckets with several components only."""
    named = live.join(known, F.col("key") == F.col("vertex"), "left").drop("vertex").withColumn("label", F.coalesce("component", "key")).drop("component")
    open_ = named.groupBy("band", "h").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 != l2").select("band", "h")
    return named.join(open_, ["band", "h"])


def _led(named: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of each bucket's text of most links with those of other components, and the rows without these leaders."""
    degree = links.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("degree"))
    ranked = named.join(degree, F.col("key") == F.col("of"), "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("key").alias("x"), F.col("key").alias("leader"), F.col("label").alias("led")))
    leaders = ranked.groupBy("band", "h").agg(F.max("rank").alias("top")).select("band", "h", "top.leader", "top.led")
    rows = spill(named.join(leaders, ["band", "h"]).where("key != leader"), "led")
    return rows.where("label != led").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), rows.select("band", "h", "key")


def _able(named: DataFrame, copies: DataFrame, shingles: DataFrame) -> DataFrame:
    """Keys of the texts that could be similar to some text of their open buckets, by what they share with any."""
    sized = named.select("band", "h", "key").join(copies.select("key", "n"), "key")
    low = sized.groupBy("band", "h").agg(F.min("n").alias("low"))
    texts = spill(sized.join(low, ["band", "h"]).groupBy("key").agg(F.min("n").alias("n"), F.min("low").alias("low")), "open")
    each = shingles.join(texts.select("key"), "key", "left_semi").mapInArrow(_different_shingles, "shingle long, key binary, times int")
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("key").alias("key"), F.min("times").alias("times")).where("texts = 1")
    alone = alone.groupBy("key").agg(F.sum("times").alias("alone"))
    most = F.col("n") - F.coalesce("alone", F.lit(0))
    least = SIMILAR / (1 + SIMILAR) * (F.col("n") + F.greatest(F.col("low"), SIMILAR * F.col("n"))) - 1e-9
    return texts.join(alone, "key", "left").where(most >= least).select("key")


def _across(named: DataFrame, copies: DataFrame, shingles: DataFrame) -> DataFrame:
    """The rows for ``_rest``: of each bucket, texts outside its largest component as queries, all as entries."""
    per = named.groupBy("band", "h", "label").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("band", "h").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top")).where("all > top.c")
    per = per.select("band", "h", F.ceil(F.col("all") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("blocks"), F.col("top.label").alias("largest"))
    rows = named.join(per, ["band", "h"]).withColumn("asks", F.col("label") != F.col("largest")).withColumn("x", F.xxhash64("key", F.lit("block")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod("x", n).cast("int")
    own = ["band", "h", "key", "label", "asks"]
    entries = rows.select(*own, every("blocks").alias("block"), share("parts").alias("part"), F.lit(False).alias("held"))
    queries = rows.where("asks").select(*own, share("blocks").alias("block"), every("parts").alias("part"), F.lit(True).alias("held"))
    rows = entries.union(queries).join(copies.select("key", "n", "sketches"), "key").join(shingles, "key")
    at = ["band", "h", "block", "part"]
    return rows.repartition(*at).sortWithinPartitions(*at, F.desc("held"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, th, key), and of each key the least row of its class: key, head (doc_id, key, th; null ids last)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = rows.withColumn("th", F.xxhash64("text")).mapInArrow(_signatures, "doc_id long, th long, key binary, n int, sketches array<long>")
    signed = spill(signed, "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("at")
    copies = spill(signed.where("key is not null").groupBy("key").agg(first, F.min("n").alias("n"), F.min("sketches").alias("sketches")), "copies")

    buckets = copies.where("n > 0").select("key", F.posexplode("sketches").alias("band", "h"))
    heads = buckets.groupBy("band", "h").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    shared = spill(buckets.join(heads, ["band", "h"]), "buckets")  # texts in buckets of two and more
    pairs = spill(shared.where("key != head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    # Of paired texts one row each is read anew for its shingles.
    wanted = pairs.select("a").union(pairs.select("b")).distinct().join(copies, F.col("a") == F.col("key")).select(*_named_by("at"))
    texts = _rows(rows).join(wanted, ["__th", "__id", "__none"], "left_semi").select("text")
    shingles = spill(texts.mapInArrow(_shingles, "key binary, shingles binary").dropDuplicates(["key"]), "shingles")

    links = _verified(pairs, shingles, "near")
    known = spill(components(links), "known")
    open_ = _labelled(shared.where("key != head").select("band", "h", "key"), known)
    pairs, live = _led(open_, links)
    links = links.union(_verified(pairs, shingles, "led"))
    known = spill(components(links), "known")
    open_ = _labelled(live, known)
    open_ = spill(_labelled(open_.drop("label").join(_able(open_, copies, shingles), "key", "left_semi"), known), "open")
    more = spill(_across(open_, copies, shingles).mapInArrow(_rest, "a binary, b binary"), "across")
    if not more.isEmpty():
        known = components(links.union(more))

    grouped = copies.join(known, F.col("key") == F.col("vertex"), "left").select("key", F.struct("at.none", "at.doc_id", "key", "at.th").alias("at"), F.coalesce("component", "key").alias("component"))
    grouped = spill(grouped, "grouped")
    least = grouped.groupBy("component").agg(F.min("at").alias("head"))
    return signed, grouped.join(least, "component").select("key", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and class_id, the smallest doc_id of its group of near copies."""
    signed, classes = _classes(docs)
    classes = classes.select(F.col("key").alias("of"), F.col("head.doc_id").alias("class_id"))
    found = signed.join(classes, F.col("key") == F.col("of"), "left")
    return found.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: one of the smallest doc_id (null ids last).

    Of rows equal in doc_id and text one stays. Rows with null texts are in no group and all stay.
    """
    _, classes = _classes(docs)
    heads = classes.select("head").distinct().select(*_named_by("head"))
    at = ["__th", "__id", "__none"]
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kept = _rows(whole.where("text is not null")).join(heads, at, "left_semi")
    kept = kept.withColumn("__nth", F.row_number().over(Window.partitionBy(*at).orderBy("__th"))).where("__nth = 1")
    return kept.select("__row.*").union(docs.where(F.col("text").isNull()))
