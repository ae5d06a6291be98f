"""Token counts of whole texts, huge documents by overlapping chunks.

A text of up to ``chunk`` characters is encoded in one piece. A longer one is encoded in chunks that overlap;
each chunk's tokens carry character offsets, and two chunks are spliced at a boundary both have inside the
overlap. The boundary must be proven stable: no piece of the vocabulary holds the two characters on its
sides next to each other, so no merge of the library can ever cross it, and both sides are encoded as if the
other weren't there. Where the overlap holds no such boundary it is doubled, up to the whole rest of the text,
so counts equal those of the library on the whole text.

Null texts count as empty: no bytes, no tokens. A null doc_id is a value like others. Repeated rows give repeated
rows. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SPACE = "▁"


@functools.cache
def library(model: str):
    """The processor, characters that each id covers, and all pairs of neighbours inside a piece."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    covers, pairs = np.zeros(sp.get_piece_size(), dtype=np.int64), set()
    for i in range(len(covers)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            covers[i] = not 0x80 <= int(piece[3:5], 16) < 0xC0  # a character's first byte
        else:
            covers[i] = len(piece)
            pairs.update(map(str.__add__, piece, piece[1:]))
    return sp, covers, frozenset(pairs)


def stable(text: str, at: int, pairs: frozenset) -> bool:
    """No token of any encoding of ``text`` spans the place before character ``at``."""
    return text[at - 1 : at + 1].replace(" ", SPACE) not in pairs


def splice(text: str, sp, covers: np.ndarray, pairs: frozenset, chunk: int, overlap: int) -> list[int]:
    """The ids of a long text, from overlapping chunks."""
    if not text:
        return []
    ids: list[int] = []
    start, stop = 0, chunk  # ids holds the tokens of text[:start]; start is stable
    while True:
        own = _rest(sp, text, start, stop)
        if stop >= len(text):
            return ids + own
        ends = np.cumsum(covers[own]) - (0 if start else 1) + start  # offsets in the text
        wide = overlap
        while True:
            low = max(start + 1, stop - wide)
            ahead = sp.encode(text[low - 1 : min(len(text), stop + wide)])
            others = set((np.cumsum(covers[ahead]) - 1 + low - 1).tolist())
            common = [i for i in np.flatnonzero(ends >= low) if int(ends[i]) in others and int(ends[i]) < stop and stable(text, int(ends[i]), pairs)]
            if common:
                ids += own[: common[-1] + 1]
                start = int(ends[common[-1]])
                stop = start + chunk
                break
            if low == start + 1:  # nothing stable in this chunk: take more text
                stop = min(len(text), start + 2 * (stop - start))
                break
            wide *= 2


def _rest(sp, text: str, start: int, stop: int) -> list[int]:
    """The ids of text[start:stop] as they are in the whole text; ``start`` is stable.

    The library puts a space in front of what it encodes. The text's own start has it in any case, elsewhere it
    stands for a space of the text or is cut off together with a line end, a token of its own that nothing merges with.
    """
    if not start:
        return sp.encode(text[:stop])
    if text[start] == " ":
        return sp.encode(text[start + 1 : stop])
    return sp.encode("\n" + text[start:stop])[len(sp.encode("\n")) :]


def counter(model: str, limit: int, chunk: int, overlap: int):
    def run(batches):
        sp, covers, pairs = library(model)
        for part in slices(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            n = np.zeros(len(texts), dtype=np.int64)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1), strict=True):
                n[i] = len(ids)
            for i in set(range(len(texts))) - set(short):
                n[i] = len(splice(texts[i], sp, covers, pairs, chunk, overlap))
            size = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(counter(model, limit, chunk, overlap), SCHEMA)
