"""Operator 1, byte-level BPE: encoding by prefix dynamic programming, and decoding.

For every prefix of a piece there is exactly one token that ends its encoding. It is found from left
to right: the last token of prefix i is the token t that ends at i such that the encoding of the prefix
before t, which ends with its own last token s, stays as it is when t follows (s and t are compatible
if encoding their joined bytes gives s and t back). Storing these last tokens makes appends exact, as
prefixes do not change, and lets an edit be re-encoded from the piece it touches on.

The tokens that end a prefix come longest first from an automaton over the beginnings of tokens. One piece goes
through it byte by byte; the different pieces of a packet of texts go through it together, one byte of all at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, binaries, joined, packets, picked, prepare

#: Pairs of tokens and steps of the automaton that a worker remembers (16 bytes each in tables of twice the size).
PAIRS, STEPS = 1 << 20, 1 << 18
#: Pieces up to this many bytes go through the table together; longer ones one by one.
TOGETHER_BYTES = 48
#: Bytes of text that are encoded together, and segments of a text whose decimals and bytes are made at a time.
PACKET_BYTES, RUN_SEGMENTS = 8 << 20, 1 << 20
#: White space other than space and newline, or the separator of segments: such texts are split by the pattern as a whole.
UNUSUAL = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SEPARATOR = "\x1f"


@cache
def ranks_of(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Table:
    """Whole numbers by whole numbers in two arrays of fixed size, looked up for many keys at once; a full table is emptied."""

    def __init__(self, entries: int):
        self.most, self.bits = entries, (2 * entries - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free place where it would."""
        mask = np.int64((1 << self.bits) - 1)
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        wrong = np.flatnonzero((found != keys) & (found != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            found = self.keys[at[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != -1)]
        return at

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are known."""
        at = self.places(keys)
        return self.values[at], self.keys[at] == keys

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Remember different keys, all of them not known yet."""
        if self.held + len(keys) > self.most:
            self.clear()
            keys, values = keys[: self.most], values[: self.most]
        self.held += len(keys)
        while len(keys):
            at = self.places(keys)
            taken, first = np.unique(at, return_index=True)  # of keys that want the same place, one gets it now
            self.keys[taken], self.values[taken] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


class PrefixBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.beginnings = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.beginnings.add(b"")
        # States of the automaton: the beginnings of tokens that were met so far. At most as many as there are beginnings.
        self.state_of: dict[bytes, int] = {b"": 0}
        self.names, self.ending = [b""], [-1]
        self._ending = np.zeros(0, np.int32)
        self.steps, self.pairs = Table(STEPS), Table(PAIRS)
        self._steps: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._alone: dict[int, bool] = {}
        most = max(self.bytes_of, default=0) + 1
        self.size_of = np.zeros(most, np.int32)
        for rank, token in self.bytes_of.items():
            self.size_of[rank] = len(token)
        self.sizes: list[int] = self.size_of.tolist()
        self.next_shorter = np.full(most, -2, np.int32)  # -2: not asked for yet
        self.is_alone = np.full(most, -1, np.int8)

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merging by its definition: join the neighbours of lowest rank, leftmost first. For the bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a byte, or a token that merging never reaches."""
        known = self._halves.get(token, 0)
        if known == 0:
            parts = self.merged(self.bytes_of[token], 2)
            known = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and parts[0] in self.ranks and parts[1] in self.ranks else None
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined bytes of two tokens is these two tokens.

        Undo the merges of both from the last one on. At each moment, a is what stands before the boundary
        and b what stands behind it; merging would join them if their joined rank comes before that of the
        merge which a went into, or not after that of b's (equal ranks: the one further left is joined first).
        """
        key = left << 24 | right
        known = self._pairs.get(key)
        if known is not None:
            return known
        ranks, bytes_of, none = self.ranks, self.bytes_of, 1 << 62
        a, b, into_a, into_b, known = left, right, none, none, self.alone(right)
        while known:
            joined = ranks.get(bytes_of[a] + bytes_of[b], none)
            if joined < into_a and joined <= into_b and joined != none:
                known = False
                break
            inner_a, inner_b = self.halves(a), self.halves(b)
            if inner_a is None and inner_b is None:
                break
            if inner_b is None or (inner_a is not None and a > b):
                into_a, a = a, inner_a[1]
            else:
                into_b, b = b, inner_b[0]
        if len(self._pairs) >= PAIRS // 4:
            self._pairs.clear()
        self._pairs[key] = known
        return known

    def alone(self, token: int) -> bool:
        """Whether merging the bytes of a token gives that token; tokens that merges never reach are not alone."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = len(self.merged(self.bytes_of[token])) == 1
        return known

    def longest_end(self, data: bytes) -> int:
        """The longest token that ends data; there must be one for every byte."""
        for i in range(len(data)):
            token = self.ranks.get(data[i:])
            if token is not None:
                return token
        raise ValueError("the ranks lack a byte")

    def shorter(self, token: int) -> int:
        """The next longest token that ends a token of two or more bytes."""
        known = int(self.next_shorter[token])
        if known == -2:
            known = self.next_shorter[token] = self.longest_end(self.bytes_of[token][1:])
        return int(known)

    def step(self, state: int, byte: int) -> int:
        """The state behind one more byte: the longest end of what was read that begins a token."""
        known = self._steps.get(state << 8 | byte)
        if known is None:
            name = self.names[state] + bytes((byte,))
            while name not in self.beginnings:
                name = name[1:]
            known = self.state_of.get(name)
            if known is None:
                known = self.state_of[name] = len(self.names)
                self.ending.append(self.longest_end(name) if name else self.longest_end(bytes((byte,))))
                self.names.append(name)
            if len(self._steps) >= STEPS:
                self._steps.clear()
            self._steps[state << 8 | byte] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Complete `last`, the last token of each prefix of data so far (last[i - 1] for the first i bytes), in place."""
        sizes, state, end = self.sizes, 0, len(last)
        for byte in data[:end]:
            state = self.step(state, byte)
        for byte in data[end:]:
            end += 1
            state = self.step(state, byte)
            token = self.ending[state]
            while (n := sizes[token]) > 1 and not (self.alone(token) if n == end else self.compatible(last[end - n - 1], token)):
                token = self.shorter(token)
            last.append(token)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens describes."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.extend(data, []))

    def encode(self, text: str) -> list[int]:
        return [token for m in self.pattern.finditer(text) for token in self.encode_piece(m[0].encode("utf-8"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def last_tokens(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of every prefix of many pieces, at the place of the byte that ends it. All pieces advance by one byte at a time."""
        last = np.zeros(len(data), np.int32)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        states = np.zeros(len(starts), np.int64)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -j, side="left"))  # pieces of more than j bytes
            at = starts[:n] + j
            keys = states[:n] << 8 | data[at]
            to, known = self.steps.get(keys)
            if not known.all():
                fresh, back = np.unique(keys[~known], return_inverse=True)
                found = np.array([self.step(key >> 8, key & 255) for key in fresh.tolist()], np.int32)
                self.steps.put(fresh, found)
                to[~known] = found[back]
            states[:n] = to
            if len(self._ending) < len(self.ending):
                self._ending = np.array(self.ending, np.int32)
            tokens = self._ending[to]
            open_ = np.flatnonzero(self.size_of[tokens] > 1)
            while len(open_):
                tried = tokens[open_]
                size = self.size_of[tried]
                fits = np.zeros(len(open_), bool)
                first = size == j + 1
                if first.any():  # a piece that is a token as a whole is that token
                    fits[first] = (self._known(tried[first], self.is_alone, -1, self.alone) == 1) | (sizes[open_[first]] == j + 1)
                rest = np.flatnonzero(~first)
                pairs = last[at[open_[rest]] - size[rest]].astype(np.int64) << 24 | tried[rest]
                value, known = self.pairs.get(pairs)
                if not known.all():
                    fresh, back = np.unique(pairs[~known], return_inverse=True)
                    found = np.array([self.compatible(key >> 24, key & 0xFFFFFF) for key in fresh.tolist()], np.int32)
                    self.pairs.put(fresh, found)
                    value[~known] = found[back]
                fits[rest] = value != 0
                open_, tried = open_[~fits], tried[~fits]
                tokens[open_] = self._known(tried, self.next_shorter, -2, self.shorter)
                open_ = open_[self.size_of[tokens[open_]] > 1]
            last[at] = tokens
        return last

    @staticmethod
    def _known(tokens: np.ndarray, answers: np.ndarray, unknown: int, ask) -> np.ndarray:
        found = answers[tokens]
        if (found == unknown).any():
            for token in np.unique(tokens[found == unknown]).tolist():
                answers[token] = ask(token)
            found = answers[tokens]
        return found

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after another, and how many each has. data: the bytes that the pieces lie in."""
        counts = np.zeros(len(starts), np.int64)
        together = np.flatnonzero((sizes <= TOGETHER_BYTES) & (sizes > 0))
        last = self.last_tokens(data, starts[together], sizes[together])
        alone = {}
        for i in np.flatnonzero(sizes > TOGETHER_BYTES).tolist():
            alone[i] = np.array(self.encode_piece(data[starts[i] : starts[i] + sizes[i]].tobytes()), np.int32)
            counts[i] = len(alone[i])
        turns, open_, ends = [], together, (starts + sizes)[together]
        while len(open_):
            tokens = last[ends - 1]
            turns.append((open_, tokens))
            counts[open_] += 1
            ends = ends - self.size_of[tokens]
            more = ends > starts[open_]
            open_, ends = open_[more], ends[more]
        after = np.cumsum(counts)
        ids = np.empty(int(after[-1]) if len(after) else 0, np.int32)
        for turn, (pieces, tokens) in enumerate(turns):
            ids[after[pieces] - 1 - turn] = tokens
        for i, run in alone.items():
            ids[after[i] - counts[i] : after[i]] = run
        return ids, counts


class EditableEncoding:
    """A text with the encodings of its pieces; appends and edits re-encode only the pieces they can change."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, text
        self.starts: list[int] = []
        self.tables: list[list[int] | None] = []
        self.ids_of: list[list[int]] = []
        self._split(0, len(text), [], [], [])

    def ids(self) -> list[int]:
        return [token for ids in self.ids_of for token in ids]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in the place of text[start:end]. Pieces well before it stay: what a match ends with depends on
        two characters behind it at most, so three pieces are split anew. Those after it stay from the first
        old boundary that a new piece meets past the edit, as a match never looks back."""
        keep = max(0, bisect_right(self.starts, start) - 3)
        old_starts, old_tables, old_ids = self.starts, self.tables, self.ids_of
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        at = old_starts[keep] if keep < len(old_starts) else 0
        rest = {s + shift: i for i, s in enumerate(old_starts) if s > end}
        self.starts, self.tables, self.ids_of = old_starts[:keep], old_tables[:keep], old_ids[:keep]
        met = self._split(at, start + len(new), old_starts[keep:], old_tables[keep:], [rest])
        if met is not None:
            self.starts += [s + shift for s in old_starts[met:]]
            self.tables += old_tables[met:]
            self.ids_of += old_ids[met:]

    def _split(self, at: int, edited: int, old_starts: list[int], old_tables: list, rest: list) -> int | None:
        past = {s: t for s, t in zip(old_starts, old_tables, strict=True)}
        for m in self.bpe.pattern.finditer(self.text, at):
            if rest and m.start() > edited and m.start() in rest[0]:
                return rest[0][m.start()]
            data = m[0].encode("utf-8")
            whole = self.bpe.ranks.get(data)
            table = past.get(m.start())  # where a piece only grew, its prefixes are still right
            same = 0
            if table is not None:
                before, data_before = table
                while same < min(len(data_before), len(data)) and data_before[same] == data[same]:
                    same += 1
                table = before[: min(same, len(before))]
            last = self.bpe.extend(data, table or [])
            self.starts.append(m.start())
            self.tables.append((last, data))
            self.ids_of.append([whole] if whole is not None else self.bpe.read_back(last))
        return None


def splits_at_spaces(text: str) -> bool:
    """True if every white space of a text is one space or newline between other characters.

    Then the pattern always starts a match at each space, and matches each newline alone: words behind
    a space and lines can be encoded on their own.
    """
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(run in text for run in ("  ", "\n\n", " \n", "\n ")) and not UNUSUAL.search(text)


#: Classes of bytes that the pattern tells apart: letters, digits, space, all others. 5: what a table can't decide (apostrophes, other
#: white space, characters beyond U+023F or below U+00C0). U+00C0 to U+023F are letters, but for two signs.
CLASSES = np.array([5 if b in b"'\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" or b == 0xC2 or b > 0xC8 else 0 if b > 127 or chr(b).isalpha() else 2 if b == 32 else 1 if chr(b).isdigit() else 4 for b in range(256)], np.int8)
SIGNS = (0x97, 0xB7)


def pieces_of(segments: pa.Array, bpe: PrefixBPE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matches of the pattern in segments: bytes, starts and sizes of the pieces, and the number of pieces of each segment.

    Where CLASSES decides, a piece is a run of one class, with a space before it; other segments go through the pattern.
    """
    offsets = np.frombuffer(segments.buffers()[1], np.int64, len(segments) + 1, 8 * segments.offset)
    data = np.frombuffer(segments.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    begin = offsets[:-1] - offsets[0]
    sizes = np.diff(offsets)
    kinds = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    kinds[lead[np.isin(data[lead + 1], SIGNS)]] = 5
    starts_piece = np.zeros(len(data), bool)
    starts_piece[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != 2)
    starts_piece[begin[sizes > 0]] = True
    hard = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds == 5, out=hard[1:])
    for i in np.flatnonzero(hard[begin + sizes] > hard[begin]).tolist():
        a, b = int(begin[i]), int(begin[i] + sizes[i])
        starts_piece[a:b] = False
        at = a
        for m in bpe.pattern.finditer(data[a:b].tobytes().decode("utf-8")):
            starts_piece[at] = True
            at += len(m[0].encode("utf-8"))
        if at != b:
            raise ValueError("the pattern leaves out characters")
    starts = np.flatnonzero(starts_piece)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts_piece, out=before[1:])
    return data, starts, np.diff(np.append(starts, len(data))), before[begin + sizes] - before[begin]


def segmented(texts: pa.Array, bpe: PrefixBPE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different segments of texts, the segments of all texts one after another, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    plain = np.array([splits_at_spaces(x) for x in texts.to_pylist()], bool)
    marked = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(plain)), " ", SEPARATOR + " "), "\n", SEPARATOR + "\n" + SEPARATOR)
    lists = pc.split_pattern(marked, SEPARATOR)
    counts = np.zeros(len(texts), np.int64)
    counts[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if plain.all():
        words = lists.flatten()
    else:
        split = iter(lists)
        rows = []
        for i, easy in enumerate(plain.tolist()):
            rows.append(next(split).values if easy else pa.array(bpe.pattern.findall(texts[i].as_py()), pa.large_string()))
            counts[i] = len(rows[-1])
        words = pa.concat_arrays([r.cast(pa.large_string()) for r in rows]) if rows else pa.array([], pa.large_string())
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy().astype(np.int64), counts


def encoded(texts: pa.Array, bpe: PrefixBPE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the different segments of texts one after another, where those of each begin and end, the segments of all texts, and how many each text has."""
    segments, chosen, n_segments = segmented(texts, bpe)
    data, starts, sizes, n_pieces = pieces_of(segments, bpe)
    ids, counts = bpe.encode_pieces(data, starts, sizes)
    return ids, np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(n_pieces)))], chosen, n_segments


@cache
def worker_encoder(vocabulary: str, pattern: str) -> tuple[PrefixBPE, pa.Array, pa.Array]:
    """The encoder, and the bytes and decimals (with a comma behind) of each id. All of bounded size."""
    bpe = PrefixBPE(ranks_of(vocabulary), pattern)
    most = len(bpe.sizes)
    return bpe, pa.array([bpe.bytes_of.get(i, b"") for i in range(most)], pa.large_binary()), pa.array([b"%d," % i for i in range(most)], pa.large_binary())


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text by the rank file and decode the ids again.

    Returns per input row: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes), and with keep_ids the ids (array of int) and whether the
    round trip gave the text back. Each match of the pattern is encoded separately, without special tokens.

    Null text: encoded as empty (0 tokens, digests of nothing). Null ids and repeated rows: one row each.
    Empty table: empty result. Other columns are not read. Narrow plan, no shuffle: texts go in packets of about
    PACKET_BYTES (a longer text is a packet), whose different segments are encoded once; between packets a
    worker keeps only tables of fixed size, whatever the texts are made of.
    """
    prepare(docs.sparkSession)
    source = picked(docs, **{"id": id_col, "text": text_col})
    fields = [T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType(fields)
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bytes_of, decimals_of = worker_encoder(vocabulary, pattern)
        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                ids_of, offsets, chosen, n_segments = encoded(part.column("text"), bpe)
                # What each different segment decodes to and its decimals are made once, too.
                runs = []
                for strings in (bytes_of, decimals_of):
                    made, ends = joined(strings, ids_of)
                    runs.append(binaries(made, ends[offsets]))
                counts = np.add.reduceat(np.append(np.diff(offsets)[chosen], 0), np.minimum(np.cumsum(n_segments) - n_segments, len(chosen))) * (n_segments > 0)
                ends = np.cumsum(n_segments).tolist()
                digests, decoded, trips = [], [], []
                at, begin, held = 0, 0, 0  # bytes and decimals are made for a bounded run of segments at a time, from begin to held
                for text, end in zip(part.column("text"), ends, strict=True):
                    by_digits, by_bytes = hashlib.sha256(), hashlib.sha256()
                    same, read, whole = True, 0, np.frombuffer(text.as_buffer() or b"", np.uint8) if keep_ids else None
                    while at < end:
                        if at == held:
                            begin, held = at, min(at + RUN_SEGMENTS, len(chosen))
                            (run_bytes, byte_ends), (digits, digit_ends) = (joined(strings, chosen[begin:held]) for strings in runs)
                        to = min(end, held)
                        data = run_bytes[byte_ends[at - begin] : byte_ends[to - begin]]
                        by_digits.update(digits[digit_ends[at - begin] : digit_ends[to - begin] - (to == end)])
                        by_bytes.update(data)
                        if keep_ids:
                            same = same and np.array_equal(whole[read : read + len(data)], data)
                            read += len(data)
                        at = to
                    digests.append(by_digits.hexdigest())
                    decoded.append(by_bytes.hexdigest())
                    if keep_ids:
                        trips.append(same and read == len(whole))
                columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    kept = np.frombuffer(joined(binaries(ids_of.view(np.uint8), 4 * offsets), chosen)[0], np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(kept, pa.int32())), pa.array(trips, pa.bool_())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded bytes of arrays of ids; null ids give empty bytes, an unknown id raises."""
    prepare(encoded.sparkSession)
    source = picked(encoded, **{"id": id_col, "ids": ids_col})
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("decoded", T.BinaryType())])
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in ranks_of(vocabulary).items()}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([b"".join(map(bytes_of.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()], pa.binary())], schema=out_schema)

    return source.mapInArrow(run, schema)
