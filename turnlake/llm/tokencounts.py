"""Token counts of every prefix of a text by dynamic programming over prefixes.

The byte-pair encoding of a prefix is the encoding of a shorter prefix and one
more token: the only token that ends there and stands stably behind the last
token of the shorter one. So one pass from left to right gives the count at
every place, and the counts answer how long a text is, what a cut at any place
costs, and where a budget of tokens runs out, without encoding anything again.

A vocabulary splits texts into words first, and a text that is cut may be split
otherwise near the cut: in front of white space, inside contractions such as
'll, and inside a special string. Those places are counted as they would be in
the cut text, so ``prefix_tokens[p - 1]`` is the number of tokens of the first p
code points taken as a text of their own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import appended, bounded_batches, extended, without

#: What a Python worker remembers, from one task to the next; all of it can be worked out again.
KNOWN_WORDS, KNOWN_PAIRS, KNOWN_STARTS = 600_000, 500_000, 60_000
ENDING = 5  # bytes at the end of a token by which its possible lengths are known
SHORT = tuple(range(ENDING - 1, 0, -1))
SHARED = 7  # bytes at the start of a word that are likely to start other words
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNKNOWN = "\uFFFF"  # no character, so neither letter nor number
CONTRACTIONS = ("'ll", "'ve", "'re")  # cut after two characters they are two words
RUN = regex.compile(r"\s\s+")
TYPES = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "prefix_tokens": pa.list_(pa.int32())}


@dataclass
class Vocabulary:
    """Tokens, merges and special strings of a byte-level tokenizer file."""

    tokens: dict[bytes, int]  # bytes of each token and the rank of the merge that makes it; bytes have -1
    parts: dict[bytes, tuple[bytes, bytes]]  # what the last merge of a token joins
    specials: tuple[str, ...]
    unknown: str  # ranges of characters that count as neither letter nor number whatever the pattern library says
    spines: tuple[dict, dict] = field(default_factory=lambda: ({}, {}), repr=False)
    counter: Counter | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "spines": ({}, {}), "counter": None}  # what was remembered stays where it is

    def shared_counter(self) -> Counter:
        """One counter for all tasks of a worker, as words come back from task to task."""
        if self.counter is None:
            self.counter = Counter(self)
        return self.counter


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level files write the 256 bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _newer_characters(path: str) -> str:
    """Ranges of characters this interpreter's pattern library calls letters or numbers and the tokenizer's older tables do not.

    Only code points that are unassigned in an older Unicode version can differ.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    known = regex.compile(r"[\p{L}\p{N}]")
    unassigned = (c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    # A letter or number never joins a full stop in one word; an unknown character does.
    newer = {ord(c) for c in unassigned if known.match(c) and len(split.pre_tokenize_str(f"{c}.")) == 1}
    first, last = ([c for c in sorted(newer) if c + step not in newer] for step in (-1, 1))
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True))


def read_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a tokenizer file (JSON) of the byte-level kind: no normaliser, no prefix space, no added ids."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    before, model = content["pre_tokenizer"] or {}, content["model"]
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = not content.get("normalizer") and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not (usual and plain and model["type"] == "BPE"):
        raise ValueError("not a byte-level BPE tokenizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in content["added_tokens"]):
        raise ValueError("special strings with conditions on their surroundings are not supported")
    letters = _byte_letters()

    def raw(written: str) -> bytes:
        return bytes(map(letters.__getitem__, written))

    tokens, parts = {bytes([b]): -1 for b in range(256)}, {}
    for rank, merge in enumerate(model["merges"]):
        left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
        tokens[left + right] = rank
        parts[left + right] = (left, right)
    specials = tuple(sorted((t["content"] for t in content["added_tokens"]), key=len, reverse=True))
    return Vocabulary(tokens, parts, specials, _newer_characters(path))


def _spine(token: bytes, vocabulary: Vocabulary, side: int) -> list[tuple[bytes, float]]:
    """Pieces at one end of a token from its outermost byte up, each with the rank of the merge that ends it."""
    known = vocabulary.spines[side]
    if token not in known:
        pieces = [token]
        while pieces[-1] in vocabulary.parts:
            pieces.append(vocabulary.parts[pieces[-1]][side])
        pieces.reverse()
        ends = [vocabulary.tokens[p] for p in pieces[1:]] + [float("inf")]
        known[token] = list(zip(pieces, ends, strict=True))
    return known[token]


def stable(left: bytes, right: bytes, vocabulary: Vocabulary) -> bool:
    """Does the text of two tokens encode to just these two?

    Merges happen by rank, of equal ranks the left one first. The pieces beside
    the seam grow until one merge would cross it before either grows further.
    """
    left_spine, right_spine = _spine(left, vocabulary, 1), _spine(right, vocabulary, 0)
    ranks, i, j = vocabulary.tokens, 0, 0
    while True:
        (a, a_ends), (b, b_ends) = left_spine[i], right_spine[j]
        across = ranks.get(a + b)
        if across is not None and across < a_ends and across <= b_ends:
            return False
        if a_ends <= b_ends:
            if a_ends == float("inf"):
                return True
            i += 1
        else:
            j += 1


class _Steps(dict):
    """Steps of words. When half of KNOWN_WORDS are known they become the older half, of which only words asked for again stay."""

    def __init__(self, work_out: Callable[[str], bytes]):
        super().__init__()
        self.work_out, self.older = work_out, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.work_out(word)
        if len(self) >= KNOWN_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Counter:
    """Counts at the prefixes of words and texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: Lengths of the tokens that end in given ENDING bytes, longest first; shorter tokens behind.
        ends: dict[bytes, set[int]] = {}
        for token in vocabulary.tokens:
            if len(token) >= ENDING:
                ends.setdefault(token[-ENDING:], set(range(1, ENDING))).add(len(token))
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in ends.items()}
        self.unknown = re.compile(f"[{vocabulary.unknown}]") if vocabulary.unknown else None
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None
        self.words = _Steps(self._steps)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        #: Counts and last tokens at all prefixes of the first SHARED bytes of words.
        self.begun: dict[bytes, tuple[list[int], list[bytes]]] = {}

    def split(self, text: str) -> list[str]:
        """Words of a text, as the vocabulary's own pattern library cuts them."""
        if text.isascii() or not self.unknown or not self.unknown.search(text):
            return SPLIT.findall(text)
        return [text[slice(*m.span())] for m in SPLIT.finditer(self.unknown.sub(UNKNOWN, text))]

    def byte_counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of one word, the empty one first."""
        tokens, pairs, begun, lengths = self.vocabulary.tokens, self.pairs, self.begun, self.lengths
        known = begun.get(word[:SHARED]) if len(word) >= SHARED else None
        counts, last = (known[0].copy(), known[1].copy()) if known else ([0], [b""])
        for end in range(len(counts), len(word) + 1):
            for length in lengths.get(word[end - ENDING : end], SHORT) if end >= ENDING else SHORT:
                start = end - length
                if start < 0:
                    continue
                token = word[start:end]
                if token not in tokens:
                    continue
                if start:
                    pair = (last[start], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= KNOWN_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = stable(*pair, self.vocabulary)
                    if not fits:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
            if end == SHARED:
                if len(begun) >= KNOWN_STARTS:
                    begun.clear()
                begun[word[:end]] = counts.copy(), last.copy()
        return counts

    def steps(self, word: str) -> bytes:
        """Differences of the counts from one code point of a word to the next, as packed 32-bit numbers."""
        return self.words[word]

    def _steps(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.byte_counts(raw)
        if len(raw) > len(word):  # places between code points only
            counts = [n for n, byte in zip(counts, raw, strict=False) if byte & 0xC0 != 0x80] + counts[-1:]
        if word in CONTRACTIONS:
            counts[2] = 2
        return array("i", map(sub, counts[1:], counts)).tobytes()

    def word_tokens(self, word: str) -> int:
        return int(np.frombuffer(self.steps(word), dtype=np.int32).sum())

    def _plain(self, text: str, words: Sequence[str]) -> np.ndarray:
        """Counts at the code points of a text without special strings."""
        counts = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32).cumsum(dtype=np.int32)
        # White space at the end of a text is one word; in front of more text it may be two.
        for run in RUN.finditer(text):
            start, end = run.span()
            counts[end - 1] = (counts[start - 1] if start else 0) + self.word_tokens(run[0])
        return counts

    def counts(self, text: str | None) -> np.ndarray:
        """Tokens of the first 1, 2, ... code points of a text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        marks = list(self.special.finditer(text)) if self.special else []
        if not marks:
            return self._plain(text, self.split(text))
        parts, total, at = [], 0, 0
        for mark in marks:
            start, end = mark.span()
            words = self.split(text[at:start])
            own = self._plain(text[at:start], words) + total
            before = int(own[-1]) if len(own) else total
            # Cut inside, the string is plain text and may join the word in front of it.
            tail = words[-1] if words else ""
            fixed = before - (self.word_tokens(tail) if tail else 0)
            inside = [
                fixed + sum(map(self.word_tokens, self.split(tail + mark[0][:k]))) for k in range(1, end - start)
            ]
            total, at = before + 1, end
            parts += [own, np.array([*inside, total], dtype=np.int32)]
        parts.append(self._plain(text[at:], self.split(text[at:])) + total)
        return np.concatenate(parts).astype(np.int32)


def count_tokens(
    docs: DataFrame,
    vocabulary: Vocabulary,
    outputs: Sequence[str] = ("n_bytes", "n_tokens", "prefix_tokens"),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with n_bytes (UTF-8), n_tokens and prefix_tokens, or those of them that ``outputs`` names.

    ``prefix_tokens[p - 1]`` is the count of tokens of the first p code points;
    ``tokens_before`` and ``longest_within`` read it. Special strings in a text
    count as one token, none is added. ``keep`` names the columns to carry
    along, all unless given.

    Only ``text`` is read, whole at any length; null and empty text have no
    token and an empty array. Equal texts get equal counts, repeated rows stay.
    An empty table gives an empty one. Columns of the added names are replaced,
    others kept.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, outputs)
    names = docs.columns if keep is None else [n for n in docs.columns if n in keep]
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary file
    final = pa.schema([pa.field(name, TYPES[name]) for name in outputs])

    def run(batches):
        counter = shipped.value.shared_counter()
        for batch in batches:
            column = batch.column("text")
            found = [counter.counts(text) for text in column.to_pylist()]
            made: dict[str, Callable[[], pa.Array]] = {
                "n_bytes": lambda column=column: pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()),
                "n_tokens": lambda found=found: pa.array([int(c[-1]) if len(c) else 0 for c in found], pa.int64()),
                "prefix_tokens": lambda found=found: pa.ListArray.from_arrays(
                    np.cumsum([0, *map(len, found)]).astype(np.int32),
                    np.concatenate([np.zeros(0, dtype=np.int32), *found]),
                ),
            }
            yield appended([batch.column(n) for n in names], names, [made[n]() for n in outputs], final)

    return docs.mapInArrow(run, extended(docs.select(*names).schema, final))


def tokens_before(prefix_tokens: Column, place: Column) -> Column:
    """Tokens of the first ``place`` code points; places beyond the end count as the end, below 1 as nothing."""
    size = F.size(prefix_tokens)
    return F.when((place < 1) | (size < 1), 0).otherwise(F.get(prefix_tokens, (F.least(place, size) - 1).cast("int")))


def longest_within(prefix_tokens: Column, budget: Column) -> Column:
    """Most code points from the start whose tokens fit the budget; one more may need fewer tokens than one less."""
    fitting = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1))
    return F.coalesce(F.array_max(fitting), F.lit(0))
