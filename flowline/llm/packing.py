"""Best-fit packing of token pieces into sequences by linear grouping.

Documents become ids, an end id is appended, and only documents longer than a sequence are cut. What is packed
are lengths from 1 to ``capacity``, so the whole problem is a histogram with at most ``capacity`` bars: the plan
is made on the driver from those counts, whatever the number of documents, and is global, not per partition.

1. Large lengths (above an eighth of a sequence) are sorted and split into groups of equal cardinality; each group is
   rounded up to its largest.
2. The few rounded sizes form a cutting-stock problem, solved by column generation (a knapsack prices new
   configurations) to within ``GAP`` of the best fractional solution, which is rounded down.
3. Actual lengths are substituted: each slot takes the largest length left that is no larger than its group's, the last
   slot of a sequence the largest that fits at all, so what rounding left over is not lost.
4. What the rounding down left over and the small lengths go, longest first, where they fit best.

A plan is a list of runs: the pieces of one length with ranks in some range go to consecutive sequences, so many
in each, at some offset. All pieces are range-partitioned by length, doc_id and piece, so a length that a third of the
pieces share is spread over many tasks; a piece's rank is its position less the pieces of smaller lengths.

Null and empty texts are a single end id. Repeated rows are packed each for itself; a null doc_id is a value
like others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinal import with_position
from .common import slices, spill

#: Lower-case Latin-1 letters, and punctuation behind one at the end of a word.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
TAIL = re.compile(r"([.,;:!?%$&*#|])(?<=[a-zß-öø-ÿ].)([.,;:!?%$&*#|]*)(?!\S)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Packed ids by word. The tokenizer drops white space and never joins what is on its two sides, so a text's ids are its words' ids in turn.

    In Latin-1 texts lower-casing is all that its normalisation does, so it is done for the whole text, and common
    punctuation behind a letter, before which the tokenizer cuts in any case, becomes a word. New words of letters are
    then encoded many at a time, without normalisation and with white space as the only cut; the last id of a word, and
    no other, ends it. Other words and texts, and texts that may hold special tokens, go through the library as they are.
    """

    def __init__(self, model: str, most: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.most, self.library = most, Tokenizer.from_file(public_tokenizers.path(model))
        self.plain = Tokenizer.from_file(public_tokenizers.path(model))
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _whole(self, words: list[str]) -> None:
        self.update((w, array("I", e.ids).tobytes()) for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.keys())
        if len(self) + len(new) > self.most:
            self.clear()
            new = words
        plain = [w for w in new if LETTERS.fullmatch(w) and len(w) <= 64]
        self._whole(list(new.difference(plain)))
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(some):
                flat = ids.tobytes()
                self.update((w, flat[a:b]) for w, a, b in zip(some, [0, *cuts], cuts, strict=False))
            else:
                self._whole(some)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        words = [words_of(x) for x in texts]
        self.learn(set(chain.from_iterable(words)))
        return [np.frombuffer(b"".join(map(self.__getitem__, x)), dtype="<u4") for x in words]


def words_of(text: str) -> list[str]:
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = TAIL.sub(r" \1\2", text.lower())
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@functools.cache
def _words(model: str) -> WordIds:
    return WordIds(model)


def _parts(text: str, size: int):
    """A long text in parts that end before a space."""
    start = 0
    while len(text) - start > size:
        stop = text.find(" ", start + size)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


def piece_rows(model: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        words = _words(model)
        for part in slices(batches, 512):
            texts = [x or "" for x in part.column("text").to_pylist()]
            short = [i for i, x in enumerate(texts) if len(x) <= 1 << 20]
            ids = dict(zip(short, words.ids([texts[i] for i in short]), strict=True))
            out: list[tuple] = []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own = ids[i] if i in ids else np.concatenate([words.ids([x])[0] for x in _parts(texts[i], 1 << 20)])
                own = np.append(own, np.array([end_id], dtype="<u4"))
                for k, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    out.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes()), *([cut] if keep_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
        words.clear()  # a worker outlives its task, and may idle beside others

    return run


def token_pieces(docs: DataFrame, model: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(piece_rows(model, capacity, end_id, keep_ids), PIECES + ", ids array<long>" * keep_ids)


# --- the plan -------------------------------------------------------------------------------------------


def groups_of(large: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """(length, count) pairs, longest first, in k groups of equal cardinality; fewer lengths are a group each."""
    if len(large) <= k:
        return [[x] for x in large]
    each = -(-sum(n for _, n in large) // k)
    out, room = [[]], each
    for size, n in large:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((size, take))
            n, room = n - take, room - take
    return out


#: How far, as a share, the fractional solution may be from the best; and a bound of pivots, should they ever go in circles.
GAP, PIVOTS = 1e-3, 20_000


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of most value. Sizes come in one copy at a time, for all rooms at once."""
    best, taken = np.zeros(capacity + 1), []
    for i, (size, value) in enumerate(zip(sizes, values.tolist(), strict=True)):
        for _ in range(capacity // size if value > 0 else 0):
            better = best[:-size] + value > best[size:] + 1e-12
            if not better.any():
                break
            best = np.concatenate([best[:size], np.where(better, best[:-size] + value, best[size:])])
            taken.append((i, size, better))
    out, room = np.zeros(len(sizes), dtype=int), capacity
    for i, size, better in reversed(taken):
        if room >= size and better[room - size]:
            out[i] += 1
            room -= size
    return float(best[capacity]), out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Cutting stock over few sizes: configurations and how often each is used, no demand exceeded."""
    basis, demand = np.diag([float(capacity // s) for s in sizes]), np.array(counts, dtype=float)
    for step in range(PIVOTS):
        if step % 50 == 0:
            inverse = np.linalg.inv(basis)
        value, new = best_pattern(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + GAP:
            break
        x, way = inverse @ demand, inverse @ new
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        leaves = int(np.argmin(ratio))
        basis[:, leaves] = new
        row = inverse[leaves] / way[leaves]
        way[leaves] -= 1
        inverse = inverse - np.outer(way, row)
    x = np.linalg.inv(basis) @ demand
    out, left = [], np.array(counts)
    for j in np.argsort(-x, kind="stable"):
        column = basis[:, j].astype(int)
        n = int(min(max(0, np.floor(x[j] + 1e-9)), *(left[column > 0] // column[column > 0])))
        if n:
            out.append((column, n))
            left -= n * column
    return out


class Plan:
    """Runs (length, rank, count, sequence, offset, per_sequence), made from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = 96, small: int = 8):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.used = dict.fromkeys(histogram, 0)  # ranks taken so far, by length
        self.room: dict[int, list[tuple[int, int]]] = {}  # ranges of sequences by free room
        self.configured = 0  # pieces in configurations of several slots
        self.left = {s: n for s, n in histogram.items() if n}
        if full := self.left.pop(capacity, 0):
            self._open([capacity], full)
        large = sorted(((s, n) for s, n in self.left.items() if s > capacity // small), reverse=True)
        if large:
            parts = groups_of(large, groups)
            tops = [p[0][0] for p in parts]
            lengths = sorted(s for s, _ in large)
            for column, n in configurations(tops, [sum(c for _, c in p) for p in parts], capacity):
                self._substitute(sorted((tops[g] for g, a in enumerate(column) for _ in range(a)), reverse=True), n, lengths)
        for size in sorted(self.left, reverse=True):
            self._best_fit(size, self.left[size])

    def _substitute(self, slots: list[int], n: int, lengths: list[int]) -> None:
        """Up to n sequences with actual lengths in their slots; ``lengths`` are the large ones with pieces left, ascending."""
        while n:
            own, room = [], self.capacity
            for i, top in enumerate(slots):
                at = bisect_right(lengths, min(top, room) if i + 1 < len(slots) else room)
                if not at:
                    return
                own.append(lengths[at - 1])
                room -= own[-1]
            same = min(n, *(self.left[s] // own.count(s) for s in own))
            if not same:  # the last piece of a length would be needed twice
                return
            for s in own:
                self.left[s] -= same
            for s in {*own}:
                if not self.left[s]:
                    del lengths[bisect_right(lengths, s) - 1]
            self.configured += same * len(own) * (len(own) > 1)
            self._open(own, same)
            n -= same

    def _run(self, size: int, count: int, sequence: int, offset: int, each: int) -> None:
        self.runs.append((size, self.used[size], count, sequence, offset, each))
        self.used[size] += count

    def _open(self, sizes: list[int], n: int) -> None:
        offset = 0
        for size in sizes:
            self._run(size, n, self.sequences, offset, 1)
            offset += size
        self._leave(self.capacity - offset, self.sequences, n)
        self.sequences += n

    def _leave(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            self.room.setdefault(room, []).append((sequence, n))

    def _fill(self, size: int, left: int, room: int, sequence: int, n: int) -> int:
        """Put what is left of a length into n sequences with so much room, as many in each as fit."""
        each = room // size
        whole = min(n, left // each)
        offset = self.capacity - room
        if whole:
            self._run(size, whole * each, sequence, offset, each)
            self._leave(room - each * size, sequence, whole)
            left -= whole * each
        if whole < n and 0 < left < each:
            self._run(size, left, sequence + whole, offset, left)
            self._leave(room - left * size, sequence + whole, 1)
            whole, left = whole + 1, 0
        self._leave(room, sequence + whole, n - whole)
        return left

    def _best_fit(self, size: int, left: int) -> None:
        for room in sorted(r for r in self.room if r >= size):
            ranges = self.room.pop(room)
            for i, (sequence, n) in enumerate(ranges):
                if not left:
                    self.room.setdefault(room, []).extend(ranges[i:])
                    break
                left = self._fill(size, left, room, sequence, n)
            if not left:
                return
        if left:
            n = -(-left // (self.capacity // size))
            self.sequences += n
            self._fill(size, left, self.capacity, self.sequences - n, n)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with a ``length`` of 1 to ``capacity``, each with its sequence_id and offset.

    ``pieces`` is read more than once, so it should be a written table. To the driver come at most ``capacity`` counts;
    what is broadcast are those and the plan's runs, a few for each length.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, before, base = Plan(histogram, capacity), 0, {}
    for size in sorted(histogram):
        base[size], before = before, before + histogram[size]
    runs = [(size, base[size] + rank, *more) for size, rank, *more in plan.runs]
    runs = spark.createDataFrame(runs or [(0,) * 6], "r_length long, r_position long, r_count long, r_sequence long, r_offset long, r_each long")
    placed = with_position(pieces, ["length", "doc_id", "piece"], "__position")
    inside = F.col("__position") - F.col("r_position")
    found = placed.join(F.broadcast(runs), (F.col("length") == F.col("r_length")) & (inside >= 0) & (inside < F.col("r_count")))
    return found.select(
        *pieces.columns,
        (F.col("r_sequence") + F.floor(inside / F.col("r_each"))).cast("long").alias("sequence_id"),
        (F.col("r_offset") + F.pmod(inside, F.col("r_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, model: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    return pack(spill(token_pieces(docs, model, capacity, end_id, keep_ids), "pieces"), capacity)
