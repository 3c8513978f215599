"""Operator 2, secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

The field tags every token of a text as secret begin (B), inside (I) or outside (O) from its shape, the words beside it and
features of the whole file. The tokens of a packet of texts are described and decoded together: what a token is in itself
is found once for each different one, and the best path of all texts, one after another with a certain outside between
them, comes from one Viterbi pass over runs of tokens side by side. Tokens that a bound proves to be outside on every best
path are left out of that pass, which changes no tag.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, binaries, packets, picked, prepare, run_sums

PACKET_BYTES = 2 << 20
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is shorter fails as a whole, so only long runs are looked for
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "field")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost and non-overlapping per kind, failing matches dropped."""
    found: list[Span] = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


#: What every text with a base span holds, in a form that finds it in all texts of a packet at once.
HINT = "(?i:passw(?:or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{24}"


def base_spans_of(texts: pa.Array) -> list[list[Span]]:
    """base_spans of each text (large_string, no nulls); those without a hint hold none."""
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False)).tolist():
        out[i] = base_spans(texts[i].as_py())
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Tokens are runs of other bytes than these, and each of the signs = and : alone.
SEPARATORS, SIGNS = b"\t\n\x0b\x0c\r \"'`,;(){}[]<>", b"=:"
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "auth", "authorization", "bearer", "credential", "credentials", "private", "passphrase", "signature", "session", "cookie", "jwt")
CUE = "(^|[_-])(" + "|".join(CUES) + ")$"
O, B, I = 0, 1, 2
#: Never on a path: inside does not follow outside, and between two texts all is outside.
NEVER = -1e9
#: Kinds of bytes, for shapes: digit, capital, small letter, beyond ASCII, others.
BYTE_KINDS = np.array([0 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if b > 127 else 4 for b in range(256)], np.int8)
ROLES = np.array([0 if b in SEPARATORS else 2 if b in SIGNS else 1 for b in range(256)], np.int8)
#: Tokens shorter than this have a shape: their runs of equal kinds. Ten runs at most, six ways each.
SHAPED = 11


@dataclass
class Tokens:
    """Tokens of a packet of texts: the text and the bytes of each, and the codes of its features.

    own has what different tokens are in themselves, which the place of each token among those, around the rest.
    """

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    which: np.ndarray
    own: dict[str, np.ndarray]
    around: dict[str, np.ndarray]

    @property
    def columns(self) -> dict[str, np.ndarray]:
        """All features of each token, one column each."""
        return {name: codes[self.which] for name, codes in self.own.items()} | self.around


def own_features(words: pa.Array) -> dict[str, np.ndarray]:
    """Codes of what a token is in itself, for different tokens (large_binary, none of them empty)."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    n, kinds = np.diff(ends), BYTE_KINDS[data]
    firsts = np.zeros(len(data), bool)
    firsts[ends[:-1]] = True
    digits, capitals, letters = (run_sums(x, ends) for x in (kinds == 0, kinds == 1, (kinds >= 1) & (kinds <= 3)))
    differ = np.zeros(len(data), bool)
    differ[1:] = kinds[1:] != kinds[:-1]
    turns = np.zeros(len(data), bool)
    turns[1:] = (kinds[1:] == 0) != (kinds[:-1] == 0)
    owner = np.repeat(np.arange(len(n)), n)
    distinct = np.zeros(len(n), np.int64)
    for quarter in range(4):  # of the 256 bytes, one bit each
        if quarter < 2 or (kinds == 3).any():
            bits = np.where(data >> 6 == quarter, np.uint64(1) << (data & 63).astype(np.uint64), np.uint64(0))
            distinct += np.bitwise_count(np.bitwise_or.reduceat(bits, ends[:-1]))
    starts = differ | firsts
    place = np.cumsum(starts) - 1
    place -= np.repeat(place[ends[:-1]], n)  # of a byte's run in its token
    short = starts & np.repeat(n < SHAPED, n)
    shape = np.bincount(owner[short], weights=(kinds[short] + 1.0) * 6.0 ** place[short], minlength=len(n)).astype(np.int64)
    classes = (digits > 0).astype(np.int64) + (capitals > 0) + (letters > capitals)
    joins = run_sums(np.isin(data, np.frombuffer(b".@/-", np.uint8)), ends)
    plain = run_sums((kinds == 0) | np.isin(data, np.frombuffer(b"./-", np.uint8)), ends)
    text = pc.ascii_trim(pc.ascii_lower(words.cast(pa.large_string())), characters=".-_")
    return {
        "length": np.minimum(7, np.ceil(np.log2(n + 1)).astype(np.int64)),
        "kinds": classes,
        "changes": np.minimum(6, run_sums(turns & ~firsts, ends)),
        "digits": 4 * digits // n,
        "distinct": 4 * distinct // n,
        "shape": np.where(n < SHAPED, shape, 0),
        "random": ((n >= 16) & (classes == 3)).astype(np.int64),
        "joined": (joins > 0).astype(np.int64) + 2 * (plain == n),
        "cue": pc.match_substring_regex(text, CUE).to_numpy(zero_copy_only=False).astype(np.int64),
        "sign": ((n == 1) & np.isin(data[ends[:-1]], np.frombuffer(SIGNS, np.uint8))).astype(np.int64),
    }


def tokens_of(texts: pa.Array) -> Tokens:
    """All tokens of texts, with features of their shape, of up to three words before, of what stands beside them, and of the whole file."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    roles = ROLES[data]
    firsts = np.zeros(len(data) + 1, bool)
    firsts[offsets] = True
    starts = roles == 2
    starts[1:] |= (roles[1:] == 1) & (roles[:-1] != 1)
    starts |= (roles == 1) & firsts[:-1]
    start = np.flatnonzero(starts)
    inside = roles > 0
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | starts[1:]
    end = np.flatnonzero(stops) + 1
    sizes = end - start
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    if not len(start):
        return Tokens(owner, start, start, start, {}, {})
    held = np.zeros(len(start) + 1, np.int64)
    np.cumsum(sizes, out=held[1:])
    coded = binaries(data[inside], held).dictionary_encode()
    which = coded.indices.to_numpy()
    own = own_features(coded.dictionary)
    columns: dict[str, np.ndarray] = {}

    def back(codes: np.ndarray, by: int) -> np.ndarray:
        """Of the token that stands so many before, in the same text; 0 where there is none."""
        out = np.zeros_like(codes)
        if by > 0:
            out[by:] = np.where(owner[by:] == owner[:-by], codes[:-by], 0)
        else:
            out[:by] = np.where(owner[:by] == owner[-by:], codes[-by:], 0)
        return out

    cue, sign, kinds, length = (own[name][which] for name in ("cue", "sign", "kinds", "length"))
    cued = np.where(back(cue, 1) > 0, 3, np.where(back(cue, 2) > 0, 2, np.where(back(cue, 3) > 0, 1, 0)))
    gap = np.zeros(len(start), np.int64)
    gap[1:] = np.where(owner[1:] == owner[:-1], np.minimum(2, start[1:] - end[:-1]), 2)
    gap[0] = 2
    columns["context"] = ((cued * 2 + back(sign, 1)) * 4 + kinds) * 8 + length
    columns["beside"] = ((gap * 2 + sign) * 4 + back(kinds, 1)) * 8 + back(length, 1)
    columns["behind"] = (back(sign, -1) * 4 + back(kinds, -1)) * 4 + kinds
    newlines, equals, braces = (np.diff(np.searchsorted(np.flatnonzero(data == byte), offsets)) for byte in b"\n={")
    for name, signs in (("assignments", equals), ("braces", braces)):
        file = np.minimum(2, 2 * signs // (newlines + 1))
        columns[name] = file[owner] * 4 + kinds
    return Tokens(owner, start, end, which, own, columns)


class Field:
    """Weights of (feature, tag) and of (tag, tag)."""

    def __init__(self, codes: dict[str, np.ndarray] | None = None) -> None:
        """codes: those that each column is known to have, sorted; others weigh nothing."""
        self.codes = codes or {}
        self.weights = {name: np.zeros((len(known), 3)) for name, known in self.codes.items()}
        self.moves = np.zeros((3, 3))
        self.moves[O, I] = NEVER

    def places(self, name: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.codes[name]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return at, known[at] == codes

    def emissions(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(columns.values()))) if columns else 0
        total = np.zeros((n, 3))
        for name, codes in columns.items():
            at, known = self.places(name, codes)
            total += np.where(known[:, None], self.weights[name][at], 0.0)
        return total

    def scores(self, tokens: Tokens) -> np.ndarray:
        """emissions(tokens.columns), with what tokens are in themselves added up once for each different one."""
        total = self.emissions(tokens.own)[tokens.which]
        for name, codes in tokens.around.items():
            known = self.codes[name]
            table = np.zeros((int(known[-1]) + 2, 3))  # a row for each code, and a last one for those beyond the known
            table[known] = self.weights[name]
            total += np.take(table, np.minimum(codes, len(table) - 1), axis=0)
        return total

    def uncertain(self, emitted: np.ndarray) -> np.ndarray:
        """False only for tokens of a sequence that are outside on every best path.

        A run of tokens that are not outside adds, against the same run outside, at most the sum of what each adds at best
        and what leaving it does. Where that is negative for all runs that hold a token, whichever they are, it is outside.
        """
        stay = self.moves[O, O]
        most = np.maximum(emitted[:, B] + self.moves[:, B].max(), emitted[:, I] + self.moves[:, I].max()) - emitted[:, O] - stay
        sums = np.zeros(len(most) + 1)
        np.cumsum(most, out=sums[1:])
        best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        rounding = 1e-6 + len(sums) * np.finfo(float).eps * max(1.0, float(np.abs(sums).max()))
        return best + self.moves[1:, O].max() - stay > -rounding

    def tags(self, emitted: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Best tags of the tokens of texts, each text entered from O and left to O: one sequence, with what is certainly outside left out."""
        out = np.zeros(len(emitted), np.int8)
        held = np.flatnonzero(self.uncertain(emitted))
        if not len(held):
            return out
        # A row that can only be outside stands for all that is left out between two tokens, and between two texts.
        apart = (np.diff(held) > 1) | (np.diff(owner[held]) > 0)
        at = np.arange(len(held)) + np.concatenate(([0], np.cumsum(apart)))
        rows = np.full((int(at[-1]) + 1, 3), NEVER)
        rows[:, O] = 0.0
        rows[at] = emitted[held]
        out[held] = self.viterbi(rows)[at]
        return out

    def viterbi(self, emitted: np.ndarray, run: int = 64) -> np.ndarray:
        """Best tags of a sequence that is entered from O and left to O, all of it at once.

        The sequence is cut into runs; what a run adds to a path, for each tag before it and each tag at its end, comes for all
        runs together, then the best path over the runs, then the tags within them. This is the best path of the whole.
        """
        n = len(emitted)
        if not n:
            return np.empty(0, np.int8)
        m = -(-n // run)
        rows = np.full((m * run, 3), NEVER)
        rows[:, O] = 0.0
        rows[:n] = emitted
        rows = rows.reshape(m, run, 3)
        through = self.moves[None] + rows[:, 0][:, None, :]
        for k in range(1, run):
            through = (through[:, :, :, None] + self.moves[None, None]).max(axis=2) + rows[:, k][:, None, :]
        score, before = np.array([0.0, NEVER, NEVER]), np.empty((m, 3))
        for i in range(m):
            before[i] = score
            score = (score[:, None] + through[i]).max(axis=0)
            score -= score.max()
        # What is left to O: a padded end is O anyway.
        tag = int((score + self.moves[:, O]).argmax())
        pointers, scores = np.empty((m, run, 3), np.int8), before
        for k in range(run):
            steps = scores[:, :, None] + self.moves[None]
            pointers[:, k] = steps.argmax(axis=1)
            scores = steps.max(axis=1) + rows[:, k]
        origin = np.broadcast_to(np.arange(3), (m, 3))
        for k in range(run - 1, -1, -1):
            origin = np.take_along_axis(pointers[:, k], origin, axis=1)
        last = np.empty(m, np.int64)
        for i in range(m - 1, -1, -1):
            last[i] = tag
            tag = int(origin[i, tag])
        tags, every = np.empty((m, run), np.int8), np.arange(m)
        for k in range(run - 1, -1, -1):
            tags[:, k] = last
            last = pointers[every, k, last]
        return tags.reshape(-1)[:n]

    def learn(self, tokens: Tokens, tags: np.ndarray, steps: int, rate: float, decay: float) -> None:
        """Ascent of the conditional log-likelihood of all texts together, by forward and backward sums; Adam's step sizes."""
        texts, sizes = np.unique(tokens.owner, return_counts=True)
        m, longest = len(texts), int(sizes.max())
        row = np.searchsorted(texts, tokens.owner)
        column = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        padded = np.zeros((m, longest), bool)
        padded[row, column] = True
        gold = np.zeros((m, longest + 2), np.int64)
        gold[row, column + 1] = tags
        true_moves = np.zeros((3, 3))
        ends = np.arange(longest + 1)[None, :] <= sizes[:, None]
        np.add.at(true_moves, (gold[:, :-1][ends], gold[:, 1:][ends]), 1)
        at = {name: self.places(name, codes)[0] for name, codes in tokens.columns.items()}
        parts = [*self.weights.values(), self.moves]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        total = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        for step in range(1, steps + 1):
            scores = np.zeros((m, longest, 3))
            scores[row, column] = self.emissions(tokens.columns)
            ahead, behind = np.empty((m, longest, 3)), np.empty((m, longest, 3))
            ahead[:, 0] = self.moves[O] + scores[:, 0]
            for k in range(1, longest):
                ahead[:, k] = total(ahead[:, k - 1][:, :, None] + self.moves[None], 1) + scores[:, k]
            for k in range(longest - 1, -1, -1):
                inner = total(self.moves[None] + (scores[:, k + 1] + behind[:, k + 1])[:, None, :], 2) if k + 1 < longest else 0.0
                behind[:, k] = np.where((sizes == k + 1)[:, None], self.moves[:, O][None], inner)
            whole = total(ahead[:, 0] + behind[:, 0], 1)
            expected = np.where(padded[:, :, None], np.exp(np.minimum(0, ahead + behind - whole[:, None, None])), 0.0)
            moved = np.zeros((3, 3))
            moved[O] += expected[:, 0].sum(axis=0)
            moved[:, O] += expected[np.arange(m), sizes - 1].sum(axis=0)
            for k in range(1, longest):
                joint = ahead[:, k - 1][:, :, None] + self.moves[None] + (scores[:, k] + behind[:, k])[:, None, :] - whole[:, None, None]
                moved += np.where(padded[:, k][:, None, None], np.exp(np.minimum(0, joint)), 0.0).sum(axis=0)
            wrong = -expected[row, column]
            wrong[np.arange(len(row)), tags] += 1
            slopes = []
            for name in self.weights:
                slope = np.zeros_like(self.weights[name])
                for tag in (O, B, I):
                    slope[:, tag] = np.bincount(at[name], weights=wrong[:, tag], minlength=len(slope))
                slopes.append(slope - decay * self.weights[name])
            slope = true_moves - moved
            slope[O, I] = 0
            slopes.append(slope)
            for part, slope, a, b in zip(parts, slopes, first, second, strict=True):
                a *= 0.9
                a += 0.1 * slope
                b *= 0.99
                b += 0.01 * slope * slope
                part += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


#: Made-up credentials by what stands before them and what they are made of, and texts that hold none. Parts of a form are literal, or symbols and how many.
SECRET_FRAMES = ("{cue} = {x}", "{cue}: {x}", "{cue}={x}", 'export {cue}="{x}"', "'{cue}': '{x}'", "Authorization: Bearer {x}", "the {cue} is {x}", "set {cue} {x}")
SECRET_FORMS = (
    ("ghp_", ("aA9", 36)), ("sk_live_", ("aA9", 24)), ("xoxb-", ("9", 12)), ("glpat-", ("aA9", 20)), ("AIza", ("aA9", 35)), ("eyJ", ("aA9", 60)), (("aA9", 40),), (("aA9", 20),), (("a9", 32),), (("A9", 26),),
    (("aA9", 43), "="), (("aA9", 22), "=="), (("aA9", 8), ":", ("aA9", 24)), (("a9", 12), ":", ("aA9", 30), "="), ("AccountKey=", ("aA9", 40), "=="),
)
#: Credentials of letters alone are told from words by a cue and a sign before them only.
LETTER_FRAMES, LETTER_FORMS = ("{cue} = {x}", "{cue}: {x}", "{cue}={x}", "'{cue}': '{x}'"), ((("aA", 14),), (("aA", 24),), (("a", 20),))
PLAIN_FRAMES = ("version {x}", "call {x} now", "on {x} we met", "page {x} of the book", "mail {x} please", "see {x}", "in {x} there were", "id = {x}", "width: {x}", "the number {x} is", "{x}", "my server {x} runs", "{word} = {word}", "{word}: {word} {word}")
PLAIN_FORMS = ("2.0.", "3.", "4.0", "1999", "2024-05-17", "12:30:15", "192.168.10.4", "+1", "555-2368", "4111111111111111", "+1 (555) 555-2368", "4111 1111 1111 1111", "a.b12@mail3.example.com", "http://example.com/a/b1", "https://www.example.org/", "max_value_2", "snake_case_name", "file_01.txt", "3.14159", "10,000", "42nd", "v1.2.3", "and/or", "x86_64", "utf-8", "0x1f", "1/2", "100%", "covid19", "B2B", "chapter_3", "i18n", "123456789012", "(c) 2019", "***", "###", "$$$", "%%%", "&&&")
CUE_FRAMES = ("{cue} of the {word}", "the {cue} is {word}", "a {cue} {word} {word}", "no {cue}: {word} {word}", "{word} {cue}. {word}", "{cue}, {word}")
SYMBOLS = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9": "0123456789"}


def made_up(examples: int, seed: int) -> tuple[list[str], list[tuple[int, int] | None]]:
    """Texts, and the place of the credential in each, as many with one as without."""
    draw = random.Random(seed)
    signs = ("", "", "", "", ".", ",", "!!", "?", "***", "###", "$$$", "%%%", "&&&")

    def word() -> str:
        made = "".join(draw.choice("aaeiouonnrstthdlcmé") for _ in range(draw.choice((1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 12, 16))))
        return draw.choice((made, made, made, made.capitalize(), made.upper())) + draw.choice(signs)

    texts, places = [], []
    for k in range(2 * examples):
        cue = draw.choice(("client_", "db_", "", "")) + draw.choice(CUES)
        cue = draw.choice((cue, cue, cue.upper(), cue.capitalize()))
        secret = ""
        if k % 2:
            letters = k % 8 == 1
            for part in draw.choice(LETTER_FORMS if letters else SECRET_FORMS):
                secret += part if isinstance(part, str) else "".join(draw.choice(SYMBOLS[draw.choice(part[0])]) for _ in range(part[1]))
            if not letters and not any(c.isdigit() for c in secret):
                secret += "7"
            line = draw.choice(LETTER_FRAMES if letters else SECRET_FRAMES).format(cue=cue, x="\0")
        else:
            x = "".join(draw.choice(SYMBOLS["9"]) if c.isdigit() else c for c in draw.choice(PLAIN_FORMS)) + draw.choice(signs)
            line = draw.choice(CUE_FRAMES if k % 8 == 2 else PLAIN_FRAMES).replace("{word}", "\1").format(cue=cue, x=x)
            while "\1" in line:
                line = line.replace("\1", word(), 1)
        text = " ".join([word() for _ in range(draw.randint(0, 6))] + [line] + [word() for _ in range(draw.randint(0, 6))])
        if draw.random() < 0.2:
            text = draw.choice(("{} \n", "x = 1\n{}", "a = b\nc = d\n{}\n", "fn() {{\n{}\n}}")).format(text.replace("{", "(")) if "{" in text else draw.choice(("x = 1\n", "a = b\nc = d\n", "fn() {\n")) + text
        at = text.find("\0")
        text = text.replace("\0", secret)
        texts.append(text)
        places.append((at, at + len(secret)) if secret else None)
    return texts, places


@cache
def trained(examples: int = 500, steps: int = 150, seed: int = 7) -> Field:
    """A field fitted to `examples` made-up texts with and as many without a credential; the corpus plays no part."""
    texts, places = made_up(examples, seed)
    array = pa.array(texts, pa.large_string())
    tokens = tokens_of(array)
    starts = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    tags = np.zeros(len(tokens.start), np.int64)
    for i, place in enumerate(places):
        if place:
            a, b = (starts[i] + len(texts[i][:x].encode()) for x in place)
            inside = np.flatnonzero((tokens.start >= a) & (tokens.end <= b))
            tags[inside] = I
            tags[inside[:1]] = B
    field = Field({name: np.unique(codes) for name, codes in tokens.columns.items()})
    field.learn(tokens, tags, steps, 0.1, 0.05)
    return field


def field_spans(texts: pa.Array, field: Field) -> list[list[Span]]:
    """Spans that the field tags in each text, from a B to the last I behind it, in code points. Every token takes part."""
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    tokens = tokens_of(texts)
    if not len(tokens.start):
        return out
    tags = field.tags(field.scores(tokens), tokens.owner)
    begins = np.flatnonzero(tags == B)
    if not len(begins):
        return out
    inside = np.append(tags == I, False)
    stops = np.flatnonzero(~inside)  # a span ends before the first token behind its begin that is not inside
    lasts = stops[np.searchsorted(stops, begins + 1)] - 1
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    seen, points = -1, offsets
    for first, last in zip(begins.tolist(), lasts.tolist(), strict=True):
        i = int(tokens.owner[first])
        if i != seen:
            seen, zero = i, int(offsets[i])
            points = np.concatenate(([0], np.cumsum((data[zero : offsets[i + 1]] & 0xC0) != 0x80)))
        out[i].append(("field", int(points[tokens.start[first] - zero]), int(points[tokens.end[last] - zero])))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: str | None = None, examples: int = 500) -> DataFrame:
    """Secrets of every whole text: id_col and spans (array of kind, start, end in code points, end exclusive).

    Kinds assign, access and hex are the fixed patterns and always stay; `field` are spans of the random field
    that overlap none of those. With `redacted`, a column of that name holds the text with each span replaced by
    [SECRET]. The field is fitted on the driver from `examples` made-up texts with a credential and
    as many without (a bounded sample of labelled rows) and sent along; it holds a few thousand weights whatever the data.

    Null text: no spans, and a null stays null in the redacted text. Null ids, repeated rows: one row each. Empty
    table: empty result. Other columns are not read. Narrow plan, no shuffle.
    """
    prepare(docs.sparkSession)
    field = trained(examples)
    source = picked(docs, **{"id": id_col, "text": text_col})
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("spans", T.ArrayType(SPAN))]
    schema = T.StructType([*fields, *([T.StructField(redacted, T.StringType())] if redacted else [])])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
                found = [together(base, tagged) for base, tagged in zip(base_spans_of(texts), field_spans(texts, field), strict=True)]
                columns = [part.column("id"), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in found], out_schema.field("spans").type)]
                if redacted:
                    columns.append(pa.array([None if t is None else redact(t, spans) if spans else t for t, spans in zip(part.column("text").to_pylist(), found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return source.mapInArrow(run, schema)


def together(base: list[Span], tagged: list[Span]) -> list[Span]:
    """The base spans, and those of the field that overlap none of them."""
    if not tagged:
        return base
    return ordered(base + [s for s in tagged if all(s[2] <= b[1] or s[1] >= b[2] for b in base)])


def secrets_of(text: str, field: Field) -> list[Span]:
    return together(base_spans(text), field_spans(pa.array([text], pa.large_string()), field)[0])


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
