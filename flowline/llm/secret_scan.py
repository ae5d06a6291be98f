"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The three base patterns always stay. The field tags tokens as begin, inside or outside of a secret. Tokens are all runs
of letters, digits and ``_+/-`` of a whole text, so a long line without white space is many tokens, each with its
own tag. Features are a token's shape (length, kinds of characters and their changes, how likely its letters follow each
other), its neighbours (kinds of tokens and gaps, words that announce a secret) and the file's make-up. A span goes
from a begin to the last inside token that follows it.

Begin and inside share their weights but for those of the gap before a token. So it can be told exactly, whatever
the neighbours, which tokens no best path can have in a secret: all but a few. They are outside, and Viterbi decodes
the short runs between them. Texts are read in blocks that end between tokens, with two tokens of context on either
side; what is left of the tokens of all blocks of a text is decoded together.

The field is fitted by maximum likelihood on a bounded sample: windows of about ``WINDOW`` characters of ``sample``
expected documents (all, if fewer), picked by hash. What the base patterns find there is inside a secret, but those alone
would teach the field to repeat them. So secrets of many forms, with and without announcing words, and harmless look-alikes
are planted into the windows. ``doubt`` is taken off every begin, so that only spans the field is sure of are added. On
an empty table the field adds nothing.

Null texts are empty texts and give no spans. Repeated rows give repeated rows. Spans are code points, end
exclusive, and may overlap between kinds. ``find_secrets`` ignores extra columns, ``redact_documents`` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# The base patterns, and the least length that a match (for assign: its value) must have.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run below the least length can't hold a longer one, so these find the same matches as the patterns above.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Words, and parts of words, that announce a secret.
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "cred")
_CUE = re.compile("|".join(CUES), re.IGNORECASE | re.ASCII)
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

WINDOW = 600
BLOCK = 1 << 18  # characters


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# --- tokens and features --------------------------------------------------------------------------------

_OTHER, _DIGIT, _LOWER, _UPPER, _MARK, _SPACE, _FOREIGN = range(7)
_CLASS = np.full(129, _OTHER, dtype=np.uint8)
for _chars, _kind in ((string.digits, _DIGIT), (string.ascii_lowercase, _LOWER), (string.ascii_uppercase, _UPPER), ("_+/-", _MARK), (string.whitespace, _SPACE)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128] = _FOREIGN  # all beyond ASCII
_IN_TOKEN = np.array([0, 1, 1, 1, 1, 0, 1], dtype=bool)
#: Kinds of tokens. 0: none (before the first and behind the last one of a text).
DIGITS, HEXES, LOWERS, UPPERS, CAPITAL, CAMEL, ALNUM, MARKED, FOREIGN = range(1, 10)
#: Gaps before a token.
START, ASSIGNS, QUOTED, SPACED, GLUED, BROKEN, ELSE = range(7)

# Values of each feature.
_SIZES = {"length": 10, "kind": 10, "kind-length": 100, "digits": 5, "changes": 5, "marks": 4, "letters": 24, "after": 7, "cue": 5, "last": 10, "next": 10, "file-length": 4, "file-code": 4}
_FIRST = dict(zip(_SIZES, np.cumsum([0, *list(_SIZES.values())[:-1]]).tolist(), strict=True))
N_FEATURES = sum(_SIZES.values())


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Log-probabilities of a letter behind another (27 x 27, 0: no letter), from texts."""
    counts = np.ones((27, 27))
    for text in texts:
        codes = _letters(_codes(text))
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _letters(codes: np.ndarray) -> np.ndarray:
    low = codes | np.uint32(32)
    return np.where((low >= 97) & (low <= 122), low - np.uint32(96), 0).astype(np.intp)


class Tokens:
    """The tokens of several texts: start, end (in the joined text), owner, and their features as numbers."""

    def __init__(self, texts: list[str], files: list[tuple[int, int]], pairs: np.ndarray):
        joined = "\n".join(texts)
        codes = _codes(joined)
        kinds = _CLASS[np.minimum(codes, 128)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_TOKEN[kinds], [False]]).astype(np.int8)))
        self.start, self.end = start, end = edge[::2], edge[1::2]
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, dtype=int)
        self.owner = np.searchsorted(self.base, start, side="right") - 1
        self.x: dict[str, np.ndarray] = {}
        if not len(start):
            self.gap = np.zeros(0, dtype=int)
            return
        total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        within = lambda sums: sums[end] - sums[start]
        n = end - start
        digits, lower, upper, marks = (within(total(kinds == k)) for k in (_DIGIT, _LOWER, _UPPER, _MARK))
        hexes = within(total((codes >= 97) & (codes <= 102)))
        is_digit = kinds == _DIGIT
        change = within(total(np.concatenate([[False], is_digit[1:] != is_digit[:-1]]))) - np.where(start > 0, is_digit[start] != is_digit[start - 1], False)
        letters = _letters(codes)
        fit = np.concatenate([[0.0], np.cumsum(pairs[letters[:-1], letters[1:]])])  # at i: sum of the pairs that end at i and before
        fit = (fit[end - 1] - fit[start]) / np.maximum(n - 1, 1)
        first_upper = kinds[start] == _UPPER
        kind = np.select(
            [digits + lower + upper + marks < n, marks > 0, digits == n, (digits > 0) & (digits + hexes == n), digits > 0, lower == n, upper == n, first_upper & (upper == 1)],
            [FOREIGN, MARKED, DIGITS, HEXES, ALNUM, LOWERS, UPPERS, CAPITAL], CAMEL,
        )
        length = np.searchsorted((4, 8, 12, 16, 20, 24, 32, 40, 64), n, side="right")
        new = np.concatenate([[True], self.owner[1:] != self.owner[:-1]])
        last_end = np.concatenate([[0], end[:-1]])
        between = lambda flags: (sums := total(flags))[start] - sums[last_end]
        spaces, gap_length = between(kinds == _SPACE), start - last_end
        gap = np.select(
            [new, between(codes == 10) > 0, between((codes == 61) | (codes == 58)) > 0, between((codes == 34) | (codes == 39) | (codes == 96)) > 0, (spaces > 0) & (spaces == gap_length), spaces == 0],
            [START, BROKEN, ASSIGNS, QUOTED, SPACED, GLUED], ELSE,
        )
        cue = np.zeros(len(start), dtype=bool)
        found = np.array([m.start() for m in _CUE.finditer(joined)], dtype=int)
        at = np.searchsorted(start, found, side="right") - 1
        cue[at[(at >= 0) & (found < end[at])]] = True
        back = lambda values, k: np.concatenate([np.zeros(k, dtype=values.dtype), values[:-k]]) if len(values) > k else np.zeros(len(values), dtype=values.dtype)
        same = ~new
        same2 = same & back(same, 1)
        cue1, cue2 = same & back(cue, 1), same2 & back(cue, 2)
        behind = np.concatenate([~new[1:], [False]])
        self.gap = gap
        self.x = {
            "length": length, "kind": kind, "kind-length": kind * 10 + length,
            "digits": np.searchsorted((0.01, 0.2, 0.45, 0.8), digits / n, side="right"),
            "changes": np.searchsorted((0.01, 0.1, 0.25, 0.4), change / n, side="right"),
            "marks": np.searchsorted((0.01, 0.06, 0.15), marks / n, side="right"),
            "letters": np.searchsorted((-3.8, -3.4, -3.1, -2.8, -2.5), fit, side="right") + 6 * np.searchsorted((6, 10, 16), n, side="right"),
            "after": np.where(behind, np.concatenate([gap[1:], [START]]), START),
            "cue": np.where(cue1, 1, np.where(cue2, 2, 0)) + 2 * ((cue1 | cue2) & (gap == ASSIGNS)),
            "last": np.where(same, back(kind, 1), 0), "next": np.where(behind, np.concatenate([kind[1:], [0]]), 0),
            "file-length": np.array([f[0] for f in files])[self.owner], "file-code": np.array([f[1] for f in files])[self.owner],
        }

    def matrix(self) -> np.ndarray:
        """Feature numbers, a row for each token."""
        return np.stack([_FIRST[k] + v for k, v in self.x.items()], axis=1) if self.x else np.zeros((0, len(_SIZES)), dtype=int)


def file_features(text: str) -> tuple[int, int]:
    n = max(1, len(text))
    code = 1000 * (text.count("=") + text.count("{")) / n
    return sum(n >= e for e in (500, 2000, 8000)), sum(code >= e for e in (0.2, 1, 5))


def text_blocks(text: str):
    """(context start, start, stop, context stop) of blocks that end in white space between tokens, two tokens of context on either side."""
    if len(text) <= BLOCK:
        yield 0, 0, len(text), len(text)
        return
    gap, start, before = re.compile(r"\s"), 0, 0
    while start < len(text):
        found = gap.search(text, start + BLOCK)
        stop = found.start() if found else len(text)
        ahead = _TWO.match(text, stop)
        yield before, start, stop, ahead.end() if ahead else len(text)
        own = [m.start() for m in _TOKEN.finditer(text, before, stop)][-2:]
        before, start = own[0] if own else stop, stop


_TOKEN = re.compile(r"(?:[A-Za-z0-9_+/-]|[^\x00-\x7f])+")
_TWO = re.compile(r"(?:(?:[\x00-\x7f](?<![A-Za-z0-9_+/-]))*(?:[A-Za-z0-9_+/-]|[^\x00-\x7f])+){2}")


# --- the field ------------------------------------------------------------------------------------------


class Field:
    """Weights of features for being in a secret, of gaps for begin and inside, and of neighbouring tags."""

    def __init__(self, weights: np.ndarray, gaps: np.ndarray, move: np.ndarray, pairs: np.ndarray, doubt: float = 0.0):
        self.weights, self.gaps, self.move, self.pairs = weights, gaps, move, pairs  # gaps: 7 x (begin, inside)
        self.gaps = gaps - np.array([doubt, 0.0])
        allowed = move > -1e3
        # The most that taking a token out of a secret can cost by its neighbours; an inside token behind it then begins one.
        costs = [0.0]
        for x in (BEGIN, INSIDE):
            for a in (BEGIN, INSIDE, OUTSIDE):
                if not allowed[a, x]:
                    continue
                costs += [move[a, x] + move[x, c] - move[a, OUTSIDE] - move[OUTSIDE, c] for c in (BEGIN, OUTSIDE)]
                change = float((self.gaps[:, 1] - self.gaps[:, 0]).max())
                costs += [move[a, x] + move[x, INSIDE] + move[INSIDE, e] + change - move[a, OUTSIDE] - move[OUTSIDE, BEGIN] - move[BEGIN, e] for e in (BEGIN, INSIDE, OUTSIDE)]
        self.most = max(costs)

    def scores(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that may be in a secret, and their scores as begin, inside, outside."""
        if not len(tokens.start) or not len(self.weights):
            return np.zeros(0, dtype=int), np.zeros((0, 3))
        own = np.zeros(len(tokens.start))
        for name, values in tokens.x.items():
            own += self.weights[_FIRST[name] + values]
        open_ = np.flatnonzero(own + self.gaps.max(axis=1)[tokens.gap] + self.most >= -1e-9)
        both = own[open_, None] + self.gaps[tokens.gap[open_]]
        return open_, np.concatenate([both, np.zeros((len(open_), 1))], axis=1)

    def tags(self, scores: np.ndarray) -> list[int]:
        """Viterbi over one run that follows and precedes an outside token."""
        best, back = self.move[OUTSIDE] + scores[0], []
        for s in scores[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
        tag = int((best + self.move[:, OUTSIDE]).argmax())
        out = [tag]
        for b in reversed(back):
            out.append(tag := int(b[tag]))
        return out[::-1]

    def _decode(self, at: list[int], scores: np.ndarray, bounds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Spans of one text from the open tokens' numbers, scores and places."""
        out: list[tuple[int, int, int]] = []
        numbers = np.array(at)
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(numbers) != 1) + 1):
            for i, tag in zip(run.tolist(), self.tags(scores[run]), strict=True):
                if tag == BEGIN:
                    out.append((bounds[i][0], 3, bounds[i][1]))
                elif tag == INSIDE and out:
                    out[-1] = (out[-1][0], 3, bounds[i][1])
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text (start, 3, end) of the secrets that the field finds."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(self.weights):
            return out
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                out[i] = self._long(text)
                continue
            held.append(i)
            size += len(text)
            if size > BLOCK:
                self._batch(texts, held, out)
                held, size = [], 0
        if held:
            self._batch(texts, held, out)
        return out

    def _batch(self, texts: list[str], held: list[int], out: list) -> None:
        tokens = Tokens([texts[i] for i in held], [file_features(texts[i]) for i in held], self.pairs)
        open_, scores = self.scores(tokens)
        owner = tokens.owner[open_]
        for own in np.split(np.arange(len(open_)), np.flatnonzero(np.diff(owner)) + 1) if len(open_) else ():
            at, base = open_[own], tokens.base[owner[own[0]]]
            places = list(zip((tokens.start[at] - base).tolist(), (tokens.end[at] - base).tolist(), strict=True))
            out[held[owner[own[0]]]] = self._decode(at.tolist(), scores[own], places)

    def _long(self, text: str) -> list[tuple[int, int, int]]:
        file, at, scores, places, before = file_features(text), [], [], [], 0
        for low, start, stop, high in text_blocks(text):
            tokens = Tokens([text[low:high]], [file], self.pairs)
            first, last = np.searchsorted(tokens.start, [start - low, stop - low])
            open_, own = self.scores(tokens)
            mine = (open_ >= first) & (open_ < last)
            at += (open_[mine] - first + before).tolist()
            scores.append(own[mine])
            places += list(zip((tokens.start[open_[mine]] + low).tolist(), (tokens.end[open_[mine]] + low).tolist(), strict=True))
            before += int(last - first)
        return self._decode(at, np.concatenate(scores), places) if at else []


def nothing() -> Field:
    """A field that adds no spans."""
    return Field(np.zeros(0), np.zeros((7, 2)), np.zeros((3, 3)), np.zeros((27, 27)))


# --- fitting --------------------------------------------------------------------------------------------

_PLANTED_CUES = ("password", "passwd", "pwd", "passphrase", "secret", "client_secret", "token", "auth_token", "api_key", "apikey", "key", "private key", "access key", "credentials", "auth", "bearer", "Authorization: Bearer", "pass")
_JOINTS = (" = ", "=", ": ", ":", " ", " is ", " := ", '="', ": '", ' "', " -> ")
_B62 = string.ascii_letters + string.digits


def planted_secret(rng: random.Random) -> str:
    """A value of one of several forms: digits or none, one case or both, with and without marks."""
    alphabet, low, high = rng.choice([
        ("0123456789abcdef", 20, 64), (_B62, 16, 48), (_B62 + "+/", 20, 60), (string.ascii_lowercase, 14, 40), (string.ascii_letters, 14, 40), (string.ascii_uppercase + string.digits, 14, 32),
        (_B62 + "_-", 16, 48), (string.ascii_lowercase + string.digits, 12, 40), (string.ascii_uppercase, 14, 32),
    ])
    value = "".join(rng.choices(alphabet, k=rng.randint(low, high)))
    if rng.random() < 0.2:  # several tokens: a mark that is in no token between them
        cut = rng.randint(4, len(value) - 4)
        value = value[:cut] + rng.choice(".!$@#%") + value[cut:]
    return value


def planted_window(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A window with secrets and look-alikes put between its words; (start, end) of all secrets."""
    known = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    known += [m.span() for p in (_ACCESS, _HEX) for m in p.finditer(text)]
    words = [w for w in re.findall(r"[^\W\d_]+", text) if len(w) > 2] or ["word"]
    if not known:
        gaps = [m.start() for m in re.finditer(r"\s", text)]
        places = sorted(rng.sample(gaps, min(len(gaps), rng.choice((0, 1, 1, 2, 3)))))
        out, at = "", 0
        for place in places:
            out += text[at:place] + " "
            at = place
            if rng.random() < 0.5:
                value = planted_secret(rng)
                if rng.random() < 0.75:
                    cue = rng.choice(_PLANTED_CUES)
                    joint = rng.choice(_JOINTS)
                    out += (cue.upper() if rng.random() < 0.2 else cue) + joint
                    close = joint[-1] if joint[-1] in "\"'" else ""
                else:
                    close = ""
                known.append((len(out), len(out) + len(value)))
                out += value + close
            else:  # harmless
                number = lambda n: "".join(rng.choices(string.digits, k=n))
                word = lambda: rng.choice(words)
                out += rng.choice([
                    lambda: rng.choice(_PLANTED_CUES) + rng.choice(_JOINTS) + word(), lambda: rng.choice(_PLANTED_CUES) + " " + word() + " " + word(), lambda: number(rng.randint(1, 24)), lambda: f"{word()}_{word()}_{word()}",
                    lambda: f"https://{word()}.{word()}/{word()}/{word()}-{word()}".lower(), lambda: f"{word()}.{word()}@{word()}.org", lambda: f"20{number(2)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}", lambda: "/".join(word() for _ in range(4)),
                    lambda: "".join(word().capitalize() for _ in range(3)), lambda: f"{word()}{number(3)}", lambda: f"{word()}-{word()}-{word()}", lambda: "-".join(number(4) for _ in range(4)), lambda: word().upper() + word().upper(), lambda: (word() + word()).lower(),
                ])()
        text = out + text[at:]
    return text, known


def true_tags(tokens: Tokens, secrets: list[list[tuple[int, int]]]) -> np.ndarray:
    """Begin for a secret's first token, inside for its others."""
    out = np.full(len(tokens.start), OUTSIDE)
    for i, known in enumerate(secrets):
        for start, end in known:
            hit = np.flatnonzero((tokens.start < tokens.base[i] + end) & (tokens.end > tokens.base[i] + start) & (tokens.owner == i))
            out[hit] = INSIDE
            out[hit[:1]] = BEGIN
    return out


def fit(windows: list[tuple[str, tuple[int, int]]], steps: int = 90, penalty: float = 2e-5, doubt: float = 2.0, seed: int = 11) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam over all windows at once; each is a chain between outside tags."""
    if not windows:
        return nothing()
    rng, pairs = random.Random(seed), letter_pairs([t for t, _ in windows])
    texts, secrets = zip(*(planted_window(t, rng) for t, _ in windows), strict=True)
    tokens = Tokens(list(texts), [f for _, f in windows], pairs)
    if not len(tokens.start):
        return nothing()
    y, rows = true_tags(tokens, list(secrets)), tokens.matrix()
    length = np.bincount(tokens.owner, minlength=len(texts))
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    length = length[order]
    first, length = first[length > 0], length[length > 0]
    most = int(length.max())
    alive = [int((length > t).sum()) for t in range(most)]
    x = np.zeros((len(y), N_FEATURES), dtype=np.float32)
    np.put_along_axis(x, rows, 1, axis=1)
    g = np.eye(7)[tokens.gap]
    move = np.zeros((3, 3))
    move[OUTSIDE, INSIDE] = -1e4  # a secret begins with begin
    free, scale = move == 0, 1 / len(y)
    seen = np.zeros((3, 3))  # moves in the data, from and to outside at the ends
    np.add.at(seen, (np.full(len(first), OUTSIDE), y[first]), 1)
    np.add.at(seen, (y[first + length - 1], np.full(len(first), OUTSIDE)), 1)
    for t in range(1, most):
        np.add.at(seen, (y[first[: alive[t]] + t - 1], y[first[: alive[t]] + t]), 1)
    weights, gaps, truth = np.zeros(N_FEATURES, dtype=np.float32), np.zeros((7, 2)), np.eye(3)[y]
    target, gap_target = x.T @ (y != OUTSIDE).astype(np.float32), g.T @ truth[:, :2]
    parameters = (weights, gaps, move)
    m, v = [np.zeros(p.shape) for p in parameters], [np.zeros(p.shape) for p in parameters]
    lse = lambda z, axis: (top := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis=axis))
    for step in range(1, steps + 1):
        s = np.concatenate([(x @ weights)[:, None] + g @ gaps, np.zeros((len(y), 1))], axis=1)
        forward, backward = np.empty_like(s), np.empty_like(s)
        forward[first] = move[OUTSIDE] + s[first]
        for t in range(1, most):
            at = first[: alive[t]] + t
            forward[at] = lse(forward[at - 1][:, :, None] + move, 1) + s[at]
        backward[first + length - 1] = move[:, OUTSIDE]
        for t in range(most - 1, 0, -1):
            at = first[: alive[t]] + t
            backward[at - 1] = lse(move + (s[at] + backward[at])[:, None, :], 2)
        total = lse(forward[first] + backward[first], 1)
        owner = np.empty(len(y))
        for f, n, z in zip(first.tolist(), length.tolist(), total.tolist(), strict=True):
            owner[f : f + n] = z
        one = np.exp(forward + backward - owner[:, None])
        moved = np.zeros((3, 3))
        moved[OUTSIDE] += one[first].sum(axis=0)
        moved[:, OUTSIDE] += one[first + length - 1].sum(axis=0)
        later = np.ones(len(y), dtype=bool)
        later[first] = False
        at = np.flatnonzero(later)
        moved += np.exp(forward[at - 1][:, :, None] + move + (s[at] + backward[at])[:, None, :] - owner[at, None, None]).sum(axis=0)
        slopes = ((x.T @ one[:, :2].sum(axis=1).astype(np.float32) - target) * scale + penalty * weights, (g.T @ one[:, :2] - gap_target) * scale + penalty * gaps, np.where(free, (moved - seen) * scale + penalty * move, 0))
        for k, (p, slope) in enumerate(zip(parameters, slopes, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.99 * v[k] + 0.01 * slope * slope
            p -= 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return Field(weights.astype(float), gaps, move, pairs, doubt)


def window_of(text: str) -> str:
    """One window of a text, between white space: around its first base span, else at a place its digest says."""
    spans = base_spans(text)
    at = spans[0][0] if spans else int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:6], "big") % max(1, len(text))
    low, high = max(0, at - WINDOW // 2), min(len(text), at + WINDOW // 2)
    if low and (m := re.compile(r"\s").search(text, low, at)):
        low = m.end()
    elif low:
        low = at
    if high < len(text):
        cut = max(text.rfind(c, at, high) for c in " \n\t")
        high = cut if cut > low else high
    return text[low:high]


def _windows(batches):
    for part in slices(batches):
        texts = [t for t in part.column("text").to_pylist() if t]
        files = [file_features(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([window_of(t) for t in texts], pa.string()), pa.array([f[0] for f in files], pa.int32()), pa.array([f[1] for f in files], pa.int32())], ["text", "a", "b"])


def train(docs: DataFrame, sample: int = 700) -> Field:
    """Fit on a window of each of about ``sample`` documents (doc_id, text), picked by hash; three times as many at most."""
    n = docs.select("doc_id").count()
    pick = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("crf"))
    if n > sample:
        docs = docs.where(F.pmod(pick, F.lit(1 << 30)) < int((1 << 30) * sample / n))
    got = docs.select("text").mapInArrow(_windows, "text string, a int, b int").distinct().orderBy(F.xxhash64("text"), "text", "a", "b").limit(3 * sample).collect()
    return fit([(r.text, (r.a, r.b)) for r in got])


def _scan(shared):
    def run(batches):
        field = shared.value
        for part in slices(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            found = zip(map(base_spans, texts), field.spans(texts), strict=True)
            flat = [[(a, KINDS[k], b) for a, k, b in sorted(base + extra)] for base, extra in found]
            kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
            spans = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in row] for row in flat], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """Per document: doc_id and spans, an array of (start, kind, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(_scan(shared), "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def span_digests(found: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact_documents(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in text replaced by a mark (and n_chars, if there, set anew)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def clean(batches):
        for part in slices(batches, 64):
            texts = part.column("text").to_pylist()
            more = shared.value.spans([t or "" for t in texts])
            texts = [None if t is None else redact(t, base_spans(t) + own, mark) for t, own in zip(texts, more, strict=True)]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
