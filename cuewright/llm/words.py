"""Encoding by public vocabularies, word by word, with a memory bound.

A tokenizer that drops white space and never joins characters across it gives, for a whole text,
the ids of the words between its ASCII white space, one after another. Those words repeat: of a packet of
texts, the different words are found in one pass, and those that the worker has not met lately go to the library in
batches. What a worker remembers is bounded in bytes; results never depend on it.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuewright.llm.common import binaries, run_sums

#: Bytes that a worker's memo of words may hold, about; longer words than LONGEST_KEPT are never kept.
MEMO_BYTES, LONGEST_KEPT = 96 << 20, 64
#: What an entry takes besides its word and value: their headers, and its place in the memo.
ENTRY_BYTES = 180
#: Bytes of new words handed to the library in one call.
CALL_BYTES = 1 << 18


def drops_white_space(vocabulary: str) -> bool:
    """True if the tokenizer of a .json file keeps only pieces that hold no white space."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    stripped = any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
    return bool(apart and not stripped and " " not in pattern and r"[^\s\p{L}\p{N}]" in pattern)


@cache
def library(vocabulary: str) -> Callable[[list[str]], list[list[int]]]:
    """Whole texts to ids, as the library of the file gives them, with nothing added or cut."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: processor.encode(texts, num_threads=1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@cache
def letters_only(vocabulary: str) -> Callable[[str], list[int]] | None:
    """For a lower-casing byte-level BPE: ids of a word of small LETTERS, from the model of the tokenizer alone.

    Such a word passes the normaliser and the splitter unchanged, so they need not run. None for other tokenizers.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers") or [normalizer]
    splitter = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if not ({"Lowercase"} <= {s.get("type") for s in steps} <= {"NFC", "NFKC", "Replace", "Lowercase"} and [s.get("type") for s in splitter] == ["Split", "ByteLevel"] and spec["model"].get("type") == "BPE"):
        return None
    if any(s["type"] == "Replace" and s.get("pattern") != {"Regex": "\\s+"} for s in steps) or splitter[1].get("add_prefix_space"):
        return None
    from tokenizers import Tokenizer

    tokenize, characters = Tokenizer.from_file(vocabulary).model.tokenize, byte_characters()
    return lambda word: [t.id for t in tokenize(word if word.isascii() else "".join(map(characters.__getitem__, word.encode())))]


#: Marks that may stand behind a word: a run of them is a piece of its own.
MARKS = string.punctuation
#: Words of letters that lower-casing and composing leave as they are, or change letter by letter: A to Z and U+00C0 to U+00FF.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class WordMemo(dict):
    """word -> what `keep` makes of its ids. keep(a + b) must be keep(a) + keep(b).

    Where the tokenizer lower-cases and takes runs of letters and marks apart, the letters and the marks behind them are
    remembered apart, so a word is one entry however it is written. `in_batches` gives new words to the library in batches;
    without it, new words of letters go straight to the model behind the tokenizer, which has nothing else to do for them.
    """

    def __init__(self, vocabulary: str, keep: Callable[[list[int]], object], in_batches: bool = True, most_bytes: int = MEMO_BYTES):
        super().__init__()
        self.encode, self.keep, self.most_bytes = library(vocabulary), keep, most_bytes
        self.plain, self.in_batches, self.held = letters_only(vocabulary), in_batches, 0

    def encoded(self, words: list[str]) -> list[object]:
        """keep(ids) of words, by the library, CALL_BYTES at a time."""
        out, start, held = [], 0, 0
        for i, word in enumerate(words):
            held += len(word) + 8
            if held >= CALL_BYTES or i + 1 == len(words):
                out += map(self.keep, self.encode(words[start : i + 1]))
                start, held = i + 1, 0
        return out

    def remember(self, words: list[str], values: list[object]) -> dict[str, object]:
        """All of the words with their values; those that may be kept stay for later."""
        new = dict(zip(words, values, strict=True))
        kept = {word: value for word, value in new.items() if len(word) <= LONGEST_KEPT}
        self.update(kept)
        self.held += ENTRY_BYTES * len(kept) + sum(map(len, kept)) + sum(len(value) for value in kept.values() if isinstance(value, bytes))
        return new

    def trim(self) -> None:
        """Forget everything if more is held than may be."""
        if self.held > self.most_bytes:
            self.clear()
            self.held = 0

    def of_units(self, units: list[str]) -> list[object]:
        """The values of different units of `units_of`, in their order."""
        self.trim()
        found = list(map(self.get, units))
        new = [unit for unit, value in zip(units, found, strict=True) if value is None]
        if not new:
            return found
        known: dict[str, object] = {}
        if self.plain is not None and not self.in_batches:
            letters = [x for x in new if LETTERS(x)]
            known = self.remember(letters, [self.keep(self.plain(x)) for x in letters])
            new = [x for x in new if x not in known]
        known |= self.remember(new, self.encoded(new))
        return [known[unit] if value is None else value for unit, value in zip(units, found, strict=True)]

    def of(self, words: list[str]) -> list[object]:
        """The values of different words, in their order."""
        self.trim()
        found = list(map(self.get, words))
        missing = [i for i, value in enumerate(found) if value is None]
        if not missing:
            return found
        parts: list[tuple[str, str]] = []  # of each missing word: what is looked up, and the marks behind it
        for i in missing:
            word = words[i]
            letters = word.rstrip(MARKS) if self.plain is not None else ""
            parts.append((letters.lower(), word[len(letters) :]) if letters and LETTERS(letters) else (word, ""))
        wanted = {x for part in parts for x in part if x}
        known = {x: value for x in wanted if (value := self.get(x)) is not None}
        new = list(wanted.difference(known))
        if self.plain is not None and not self.in_batches:
            letters = [x for x in new if LETTERS(x)]
            known |= self.remember(letters, [self.keep(self.plain(x)) for x in letters])
            new = [x for x in new if x not in known]
        known |= self.remember(new, self.encoded(new))
        known[""] = self.keep([])
        for i, (first, second) in zip(missing, parts, strict=True):
            found[i] = known[first] + known[second] if second else known[first]
        return found


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts, the words of all texts as places among them, and how many each text has."""
    words, chosen, counts = coded_words(texts)
    return words.to_pylist(), chosen, counts


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As words_of, with the different words as large_string."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


#: Kinds of bytes for `units_of`: letter of ASCII, mark, first byte of U+00C0 to U+00FF, others.
LETTER, MARK, LATIN, OTHER = 0, 1, 2, 3
UNIT_KINDS = np.array([MARK if chr(b) in MARKS else LETTER if chr(b) in string.ascii_letters else LATIN if b == 0xC3 else OTHER for b in range(256)], np.int8)


def units_of(words: pa.Array, apart: bool) -> tuple[list[str], np.ndarray]:
    """Different words (large_string) as units: the different units, and the places of two of them for each word.

    With `apart`, a word of LETTERS with marks behind it is its letters in small and its marks, as in `WordMemo`; any other is itself and nothing.
    """
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, stops = ends[:-1] - ends[0], ends[1:] - ends[0]
    if not len(words):
        return [], np.empty((0, 2), np.int64)
    kinds = UNIT_KINDS[data]
    first = np.flatnonzero(kinds == LATIN)  # always followed by a second byte
    second = data[first + 1]
    latin = first[(second != 0x97) & (second != 0xB7)]
    kinds[latin] = kinds[latin + 1] = LETTER
    runs = np.append(starts, len(data))  # with one more, so that none is the last: an empty word may stand at the end
    places = np.append(np.where(kinds == MARK, 0, np.arange(1, len(data) + 1)), 0)
    heads = np.maximum(np.maximum.reduceat(places, runs)[:-1], starts)  # where the marks at the end begin
    others = run_sums(kinds != LETTER, runs)
    split = apart & (heads > starts) & (stops > starts) & (others == stops - heads)
    lowered = data.copy()
    capital = (data >= 65) & (data <= 90)
    capital[latin + 1] = data[latin + 1] <= 0x9E
    lowered[capital & np.repeat(split, stops - starts)] += 32
    cut = np.empty(2 * len(words) + 1, np.int64)
    cut[0], cut[1::2], cut[2::2] = 0, np.where(split, heads, stops), stops
    coded = binaries(lowered, cut).cast(pa.large_string()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64).reshape(-1, 2)


def pieces(data: bytes, size: int) -> list[bytes]:
    """Cut UTF-8 bytes into runs of about `size`, each cut just before ASCII white space; nothing is lost."""
    if len(data) <= size:
        return [data]
    out, start = [], 0
    while len(data) - start > size:
        cut = next((i for i in range(start + size, len(data)) if data[i] in b" \t\n\r\x0b\x0c"), len(data))
        out.append(data[start:cut])
        start = cut
    return [*out, data[start:]] if start < len(data) else out
