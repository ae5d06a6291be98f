"""Removal of long byte strings that occur more than once in a corpus, by suffix arrays with two-stage sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed. Equal strings must
meet in one suffix array, and no array may hold the corpus:

* A window of LENGTH bytes is filed under the lowest hash of its ``GRAM``-byte substrings. Equal windows have equal
  hashes, and neighbouring windows mostly share theirs, so a text falls into segments of windows under one hash
  (85 windows on average). What is shuffled of a segment are its hash, a digest of its bytes and its place.
* Segments of equal bytes repeat as a whole. A hash with one segment only repeats nowhere. What is left are hashes
  with different segments: their bytes are fetched and sorted together.
* A hash may hold a third of all segments. Windows by hash see only those of at most ``FEW`` segments, or one
  ``KEYS``-th of all where that is more. So at most ``KEYS`` hashes are above it; they are broadcast, their segments are
  counted by digest with partial sums where they are read, and their copies found by joins that again broadcast the
  frequent digests only.
* There, text is sorted in two stages: suffixes smaller than their successors are sorted directly, bucket by bucket
  of their first two bytes, and all others are induced by a scan through the buckets. Windows next to each other with
  a common prefix of LENGTH bytes are repeats. Arrays hold about ``CHUNK`` bytes; a hash with more than ``HOT``
  different segments is divided into single windows filed under their own digests as well, without limit.

Rows are named by their doc_id and a hash of their text, so rows of different ids never mix.

Texts are UTF-8, whole texts; null is empty; no string crosses documents. Copies of a row (doc_id and text) are
documents of their own, so they repeat each other. Texts shorter than LENGTH are left alone. A null doc_id is a
value like others. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, spill

LENGTH, GRAM = 200, 32
LONGEST = 256  # windows of a segment
BLOCK, CHUNK, HOT = 1 << 19, 1 << 19, 1 << 14
FEW, KEYS = 1 << 12, 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte substrings."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(n, _ODD)), out=sums[1:])
    out = (sums[GRAM:] - sums[:-GRAM]) * np.cumprod(np.full(n - GRAM + 1, _INVERSE))
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: of the end of one block and the start of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _blocks(batches):
    """Lists of (row, bytes, start in the text) of bounded size; blocks of one text overlap by all but one byte of a window."""
    held, size = [], 0
    for part in slices(batches, 512, BLOCK):
        for *row, text in zip(*(part.column(c).to_pylist() for c in ("id", "th", "text")), strict=True):
            raw = (text or "").encode()
            for start in range(0, len(raw) - LENGTH + 1, BLOCK):
                one = raw[start : start + BLOCK + LENGTH - 1]
                if held and size + len(one) > BLOCK:
                    yield held
                    held, size = [], 0
                held.append((*row, one, start))
                size += len(one)
    if held:
        yield held


def _segments(batches):
    width = LENGTH - GRAM + 1
    for raw in _blocks(batches):
        buffer = b"".join(x[2] for x in raw)
        ends = np.cumsum([len(x[2]) for x in raw])
        begins = np.concatenate([[0], ends[:-1]])
        grams = gram_hashes(np.frombuffer(buffer, dtype=np.uint8))
        low = window_minima(grams, width)
        fresh = np.concatenate([[True], low[1:] != low[:-1]])
        fresh[begins] = True
        last = ends - LENGTH + 1  # one past the last window of each text
        fresh[last[last < len(low)]] = True
        starts = np.flatnonzero(fresh)
        stops = np.append(starts[1:], len(low))
        owner = np.searchsorted(ends, starts, side="right")
        inside = starts < last[owner]
        starts, stops, owner = starts[inside], stops[inside], owner[inside]
        pieces = -(-(stops - starts) // LONGEST)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            stops = np.minimum(np.repeat(starts, pieces) + (nth + 1) * LONGEST, np.repeat(stops, pieces))
            starts, owner = np.repeat(starts, pieces) + nth * LONGEST, np.repeat(owner, pieces)
        hashes, view = low[starts], memoryview(buffer)
        digest, inner = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=bool)
        for i, (a, b, h) in enumerate(zip(starts.tolist(), stops.tolist(), hashes, strict=True)):
            digest[i] = xxhash.xxh3_64_intdigest(view[a : b + LENGTH - 1])
            inner[i] = np.count_nonzero(grams[a : b + width - 1] == h) > 1  # else no window of it repeats inside it
        ids, texts, shift = (np.array([x[i] for x in raw], dtype=np.int64)[owner] for i in (0, 1, 3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(texts), pa.array((starts - begins[owner] + shift).astype(np.int32)), pa.array((stops - starts).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(inner)],
            ["id", "th", "start", "n", "m", "c", "inner"],
        )


def _cut(batches):
    """The bytes of wanted segments; those of a hot hash window by window."""
    names = ["m", "part", "id", "th", "start", "n", "known", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in slices(batches, 64):
        out = []
        for *row, text, wants in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text", "wants")), strict=True):
            raw = text.encode()
            for w in wants:
                a, n = w["start"], w["n"]
                if w["hot"]:
                    for s in range(a, a + n):
                        one = raw[s : s + LENGTH]
                        out.append((w["m"], xxhash.xxh3_64_intdigest(one) >> 1 or 1, *row, s, 1, w["known"], one))
                else:
                    out.append((w["m"], 0, *row, a, n, w["known"], raw[a : a + n + LENGTH - 1]))
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def suffix_array(text: bytes, depth: int = LENGTH) -> np.ndarray:
    """Places of all suffixes, ordered by their first ``depth`` bytes at least."""
    n = len(text)
    data = np.frombuffer(text, dtype=np.uint8).astype(np.int16)
    step = np.sign(data[1:] - data[:-1])
    # Is a suffix smaller than its successor: what the next unequal pair says; the last suffix is larger than the empty one.
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(np.append(step, -1)[at] > 0, False)

    tops = np.cumsum(np.bincount(data, minlength=256))
    order = array("i", bytes(4 * n))
    # Stage one: sort the smaller ones directly; they are at the end of the bucket of their first byte.
    places = np.flatnonzero(smaller)
    pair = data[places].astype(np.int32) * 256 + data[np.minimum(places + 1, n - 1)]
    places = places[np.argsort(pair, kind="stable")]
    pair = np.sort(pair)
    sorted_places: list[int] = []
    for own in np.split(places, np.flatnonzero(pair[1:] != pair[:-1]) + 1):
        own = own.tolist()
        sorted_places += sorted(own, key=lambda i: text[i : i + depth]) if len(own) > 1 else own
    count = np.bincount(data[places], minlength=256) if len(places) else np.zeros(256, dtype=int)
    out = np.frombuffer(order, dtype=np.int32)
    out[:] = -1
    first = np.cumsum(count) - count
    for c in np.flatnonzero(count):
        out[tops[c] - count[c] : tops[c]] = sorted_places[first[c] : first[c] + count[c]]
    # Stage two: scan; the suffix before the scanned one, if it isn't a smaller one, is next in its bucket.
    heads = (tops - np.bincount(data, minlength=256)).tolist()
    larger = (~smaller).tobytes()
    order[heads[text[n - 1]]] = n - 1
    heads[text[n - 1]] += 1
    for i in range(n):
        j = order[i] - 1
        if j >= 0 and larger[j]:
            c = text[j]
            order[heads[c]] = j
            heads[c] += 1
    return out


def common_prefixes(text: bytes, places: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each place and the one before it, in whole words of 8 bytes, up to ``depth``."""
    data = np.frombuffer(text + bytes(depth + 8), dtype=np.uint8)
    words = np.zeros(len(text) + depth, dtype=np.uint64)
    for b in range(8):
        words = (words << np.uint64(8)) | data[b : b + len(words)]
    out, alive = np.zeros(len(places), dtype=np.int64), np.arange(1, len(places))
    for k in range(0, depth, 8):
        alive = alive[words[places[alive] + k] == words[places[alive - 1] + k]]
        out[alive] = k + 8
    return out


def repeated_windows(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment the offsets of windows that also start elsewhere in the segments."""
    text = b"".join(segments)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    order = suffix_array(text)
    room = np.repeat(ends, sizes) - np.arange(len(text))  # bytes to the end of the own segment
    order = order[room[order] >= LENGTH]
    same = np.flatnonzero(common_prefixes(text, order) >= LENGTH)
    hit = np.unique(np.concatenate([order[same], order[same - 1]]))
    owner = np.searchsorted(ends, hit, side="right")
    return np.split(hit - (ends - sizes)[owner], np.searchsorted(owner, np.arange(1, len(segments))))


def _repeats(batches):
    def out(rows):
        found = []
        if len(rows) > 1 or rows[0][5] > 1:
            for (_, _, *row, start, _, known, _), hit in zip(rows, repeated_windows([r[7] for r in rows]), strict=True):
                if known or not len(hit):
                    continue
                for run in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1):
                    found.append((*row, start + int(run[0]), start + int(run[-1]) + LENGTH))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "th", "low", "high"])

    held, size, key, begun = [], 0, None, 0  # begun: where the current key's rows begin in held
    for batch in slices(batches, 1024):
        for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if row[:2] != key:
                if size >= CHUNK:
                    yield out(held)
                    held, size = [], 0
                key, begun = row[:2], len(held)
            elif row[1] and size >= 8 * CHUNK and len(held) - begun > 1:
                # one window's copies only: any two of them show that all repeat
                yield out(held)
                held, size, begun = held[-1:], len(row[7]), 0
            held.append(row)
            size += len(row[7])
    if held:
        yield out(held)


def _strip(batches):
    for batch in slices(batches, 256):
        out = []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw, keep, at, runs = (text or "").encode(), hashlib.sha256(), 0, 0
            removed = 0
            for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
                if low > at or not runs:
                    runs += 1
                    keep.update(raw[at:low])
                removed += max(0, high - max(low, at))
                at = max(at, high)
            keep.update(raw[at:])
            out.append((doc, len(raw), removed, runs, keep.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


ROW = ["id", "th"]


def named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with id and th; equal rows share both."""
    none = F.col("doc_id").isNull()
    return docs.withColumns({"id": F.coalesce("doc_id", F.xxhash64(F.lit("none"), "text")), "th": F.xxhash64("text", none)})


def _rare(found: DataFrame) -> DataFrame:
    """Segments of hashes with few of them, in one shuffle: id, th, start, n, m, known (repeats as a whole), wanted, hot."""
    found = found.repartition("m")
    alike = Window.partitionBy("m", "c").orderBy(*ROW, "start")
    every = alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("copies", F.count(F.lit(1)).over(every)).withColumn("first", F.row_number().over(alike) == 1)
    bucket = Window.partitionBy("m")
    found = found.withColumn("mixed", F.min("c").over(bucket) != F.max("c").over(bucket)).withColumn("kinds", F.sum(F.col("first").cast("long")).over(bucket))
    wanted = F.col("first") & (F.col("mixed") | (F.col("inner") & (F.col("copies") == 1)))
    return found.select(*ROW, "start", "n", "m", (F.col("copies") > 1).alias("known"), wanted.alias("wanted"), (F.col("kinds") > HOT).alias("hot")).where("known or wanted")


def _frequent(found: DataFrame, hashes: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """The same of hashes with more than ``many`` segments, given as a table of few rows: wanted segments, repeated ones."""
    found = found.join(F.broadcast(hashes), "m")
    place = F.struct(*ROW, "start", "n", "inner")
    groups = spill(found.groupBy("m", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")), "digests")
    kinds = groups.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"))  # no more rows than hashes
    wanted = groups.join(F.broadcast(kinds), "m").where("kinds > 1 or (first.inner and copies = 1)")
    wanted = wanted.select("first.id", "first.th", "first.start", "first.n", "m", (F.col("copies") > 1).alias("known"), (F.col("kinds") > HOT).alias("hot"))
    often = F.broadcast(groups.where(F.col("copies") > many).select("m", "c"))  # at most KEYS rows, by what many is
    seldom = groups.where((F.col("copies") > 1) & (F.col("copies") <= many)).select("m", "c")
    known = found.join(often, ["m", "c"], "left_semi").union(found.join(often, ["m", "c"], "left_anti").join(seldom, ["m", "c"], "left_semi"))
    return wanted, known.select(*ROW, "start", "n")


def repeated_spans(docs: DataFrame, few: int = FEW) -> DataFrame:
    """(id, th, low, high) of byte ranges to remove, which may overlap; ``docs`` has id, th (for each different row) and text."""
    every = spill(docs.mapInArrow(_segments, "id long, th long, start int, n int, m long, c long, inner boolean"), "segments")
    many = max(few, every.count() // KEYS, 1)
    hashes = spill(every.groupBy("m").count().where(F.col("count") > many).select("m"), "hashes")
    rare = spill(_rare(every.join(F.broadcast(hashes), "m", "left_anti")), "rare")
    more, known = _frequent(every, hashes, many)

    wanted = rare.where("wanted").select(*more.columns).union(more)
    wanted = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("m", "start", "n", "known", "hot")).alias("wants"))
    # Equal rows share their name; their text is needed once.
    cut = docs.join(wanted, ROW).select(*ROW, "text", "wants").mapInArrow(_cut, "m long, part long, id long, th long, start int, n int, known boolean, bytes binary")
    cut = cut.repartition("m", "part").sortWithinPartitions("m", "part", *ROW, "start")
    cut = cut.mapInArrow(_repeats, "id long, th long, low int, high int")
    whole = rare.where("known").select(*known.columns).union(known)
    return whole.select(*ROW, F.col("start").alias("low"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("high")).union(cut)


def strip_repeats(docs: DataFrame, few: int = FEW) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = named_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated_spans(docs.select(*ROW, "text"), few).groupBy(*ROW).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return docs.join(spans, ROW, "left").select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
