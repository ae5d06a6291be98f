"""Chat formatting at the level of tokens.

A turn is ``<s>[INST]role[/INST]text</s>``. The four control strings are reserved ids above the vocabulary; role
and text are encoded as segments of their own and spliced between them, so no token ever spans a control string
and no text can produce a reserved id. The rendered text stays unambiguous as well: a backslash in a role or
text is doubled and a control string in it gets a backslash after its first character, which ``unescape`` undoes.

The loss mask marks the text tokens of assistant turns: +1 where such a segment starts, -1 where it ends, summed
up over the tokens of a batch.

Formatting and reading back work turn by turn, so a long conversation is spread over tasks. Only digests need a
conversation in order: its rows are sorted (on disk if need be) and run through with a few running totals.

Null roles and texts are empty. Rows of one conversation are ordered by turn (null first), ties by role, then
text; repeated rows stay. Null conv_ids form one conversation. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
ESCAPE = "\\"
#: Segments longer than this are encoded in parts, cut where the tokenizer's own pattern always cuts.
LONG = 100_000


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    """The inverse of ``escape``: a backslash goes, what follows it stays."""
    first, *rest = text.split(ESCAPE * 2)
    return ESCAPE.join(x.replace(ESCAPE, "") for x in (first, *rest))


@functools.cache
def _encoding(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(vocabulary: str) -> tuple[int, ...]:
    """The ids of the control strings: the first ones above the vocabulary and its free end id."""
    first = _encoding(vocabulary).n_vocab + 1
    return tuple(range(first, first + len(CONTROLS)))


def encode(segment: str, vocabulary: str) -> list[int]:
    """Ids of one segment; a very long one in parts that end between a letter and a space before a letter."""
    library, out = _encoding(vocabulary), []
    while len(segment) > LONG:
        at = LONG
        while (at := segment.find(" ", at)) > 0 and not (segment[at - 1].isalpha() and segment[at + 1 : at + 2].isalpha()):
            at += 1
        if at < 0:
            break
        out += library.encode_ordinary(segment[:at])
        segment = segment[at:]
    return out + library.encode_ordinary(segment)


def assemble(turns: list[tuple[str, str]], vocabulary: str, trained: str = "assistant") -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and loss mask of each (role, text)."""
    begin, open_, close, end = reserved(vocabulary)
    flat: list[int] = []
    cuts, starts, stops = [0], [], []
    for role, text in turns:
        flat += [begin, open_, *encode(escape(role), vocabulary), close]
        start = len(flat)
        flat += encode(escape(text), vocabulary)
        if role == trained:
            starts.append(start)
            stops.append(len(flat))
        flat.append(end)
        cuts.append(len(flat))
    steps = np.zeros(len(flat) + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    mask = np.cumsum(steps[:-1]).astype(np.int8)
    ids = np.array(flat, dtype=np.int32)
    return np.split(ids, cuts[1:-1]) if turns else [], np.split(mask, cuts[1:-1]) if turns else []


def read(ids: np.ndarray, mask: np.ndarray, vocabulary: str) -> tuple[str, str, str | None, int]:
    """Role, text, text under the mask (None: nothing is) and rendered characters of one formatted turn."""
    library, (begin, open_, close, end) = _encoding(vocabulary), reserved(vocabulary)
    middle = int(np.flatnonzero(ids == close)[0])
    if ids[0] != begin or ids[1] != open_ or ids[-1] != end:
        raise ValueError("not a formatted turn")
    text_of = lambda x: library.decode_bytes(x.tolist()).decode()
    role, text = text_of(ids[2:middle]), text_of(ids[middle + 1 : -1])
    learned = unescape(text_of(ids[mask > 0])) if mask.any() else None
    return unescape(role), unescape(text), learned, sum(map(len, CONTROLS)) + len(role) + len(text)


def _format(vocabulary: str):
    def run(batches):
        for part in slices(batches):
            rows = list(zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True))
            ids, mask = assemble([(a or "", b or "") for a, b in rows], vocabulary)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int8()))], ["conv_id", "turn", "ids", "loss_mask"])

    return run


def format_turns(conversations: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per turn: conv_id, turn, ids and loss_mask (one entry for each id)."""
    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return rows.mapInArrow(_format(vocabulary), "conv_id long, turn long, ids array<int>, loss_mask array<byte>")


def _read(vocabulary: str):
    def run(batches):
        for part in slices(batches):
            ids, mask = (x.values.to_numpy() for x in (part.column("ids"), part.column("loss_mask")))
            at = part.column("ids").offsets.to_numpy()
            out = [read(ids[a:b], mask[a:b], vocabulary) for a, b in zip(at, at[1:], strict=False)]
            role, text, learned, chars = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(role), pa.array(text), pa.array(learned, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "turn", "role", "text", "loss_text", "chars"])

    return run


def read_turns(formatted: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """What formatted turns say: conv_id, turn, role, text, loss_text (null: not trained on), chars."""
    return formatted.select("conv_id", "turn", "ids", "loss_mask").mapInArrow(_read(vocabulary), "conv_id long, turn long, role string, text string, loss_text string, chars long")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches):
    key, state = None, None

    def closed():
        return pa.RecordBatch.from_pylist([{"conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}], schema=DIGEST)

    for part in slices(batches):
        done = []
        for conv, role, text, learned, chars in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "chars")), strict=True):
            if state is None or conv != key:
                if state is not None:
                    done.append(closed())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if learned is not None:
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += chars
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if state is not None:
        yield closed()


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation, from ``read_turns``: counts and digests over its turns in order."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss_text", "chars").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESCAPED = r"replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')"
ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
