"""Byte-level BPE: encoding by ranked merges folded over the bytes of distinct words, and decoding.

Texts are cut into words by the vocabulary's pattern. The distinct words of all
texts are counted; the most frequent are encoded once, by a fold of
higher-order functions over their bytes that looks ranks up in a literal map,
and shipped as a table of fixed size. A word outside the table is folded where
it stands, so no word is ever joined back to its text and no result depends on
the table. Decoding concatenates the bytes of the ids.

The fold gets the bytes of a word as a string with a character for each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import appended, bounded_batches, extended, stored, without
from turnlake.llm.spans import bound

TABLE_WORDS = 1_000_000  # words shipped to every task, most frequent first
QUICK_WORDS = 100_000  # of them in a dictionary of Python; the others lie in flat arrays
TABLE_BYTES = 64  # longest word of the table, so its size is bounded
FOLD_BYTES = 128  # longer words take the same merges from a heap, which needs n log n steps
BATCH_WORDS = 50_000  # words of the table that are Python strings at a time
PART_WORDS = 400_000  # distinct pieces counted before their words are handed on
BUCKETS = 1 << 13  # pairs are looked up by comparing keys one by one, so they are spread over small lists
#: An entry of a word's state is one number: the rank of the pair that begins at a piece, where the piece starts, its id.
ID_BITS, START_BITS = 24, 15
PAIR_BITS = ID_BITS + START_BITS
NEVER = (1 << ID_BITS) - 1  # above every rank
NOTHING = NEVER - 1  # id in front of a word
GONE = (1 << 63) - 1
#: Of this pattern no match but the one that begins with it holds a blank before a visible character, so texts can be cut there.
CUT_AT_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_BLANK = r" ([\s\x0b\x1c-\x1f\x85\p{Z}]|\z)"  # a blank that may belong to white space before or behind it
#: Words for counting only. It cuts nearly as vocabularies do, in less time; the counts merely choose the table.
COUNTED = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\w\s]+|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_pieces(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token before its own rank comes: two pieces, unless no merge makes the token."""
    pieces = [token[i : i + 1] for i in range(len(token))]
    while len(pieces) > 2:
        rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairwise(pieces)))
        if rank >= ranks[token]:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


@dataclass
class Merges:
    """Merges of a vocabulary by the ids of two pieces.

    Whatever stands around a token, its bytes are merged in the same order, so
    the last merge joins the same two pieces everywhere.
    """

    pairs: list[tuple[int, int, int]]  # ids of two pieces and the rank, which is the id, of both together
    letters: list[int]  # ids of the 256 bytes
    whole: dict[bytes, int]  # tokens that no merge makes; they count only as whole words


def read_merges(ranks: dict[bytes, int]) -> Merges:
    if max(ranks.values(), default=0) >= NOTHING:
        raise ValueError(f"ranks from {NOTHING} on are not supported")
    pairs, whole = [], {}
    for token, rank in ranks.items():
        pieces = _last_pieces(token, ranks)
        if len(pieces) == 2:
            pairs.append((ranks[pieces[0]], ranks[pieces[1]], rank))
        elif len(pieces) > 2:
            whole[token] = rank
    return Merges(pairs, [ranks[bytes([i])] for i in range(256)], whole)


def rank_map(merges: Merges) -> tuple[Column, Column]:
    """Literals: lists of keys of pairs, each followed by its rank, chosen by a checksum of the ids; ids of the bytes."""
    lists: list[list[int]] = [[NEVER] for _ in range(BUCKETS)]
    for left, right, rank in merges.pairs:
        lists[(left * 31 + right) % BUCKETS] += [((left + 1) << ID_BITS) + right, rank]
    kinds = ((lists, "array<array<bigint>>"), (merges.letters, "array<bigint>"))
    return tuple(F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), kind) for x, kind in kinds)


def _number(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _rank(lists: Column, left: Column, right: Column) -> Column:
    """Rank of two neighbouring ids. A key is above all ranks; a missing one has place 0, where NEVER stands."""
    own = F.get(lists, (left * 31 + right).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    place = F.array_position(own, F.shiftleft(left + 1, ID_BITS) + right)
    return F.coalesce(F.get(own, place.cast("int")), _number(NEVER))


def fold(lists: Column, letters: Column, word: Column) -> Column:
    """Ids of one word, a string with a character for each byte: again and again the leftmost pair of lowest rank is merged.

    The state has a number for each piece, the rank of the pair that begins
    there in front, then where the piece starts, so the least is the leftmost
    pair of lowest rank. A merge looks up the two pairs it makes and leaves the
    other numbers as they are. In front stands a piece that joins nothing.
    """
    below = (1 << PAIR_BITS) - 1

    def id_of(entry: Column) -> Column:
        return entry.bitwiseAND(_number(NEVER))

    def pair(left: Column, right: Column) -> Column:
        return F.shiftleft(_rank(lists, left, right), PAIR_BITS)

    def merge(state: Column, _: Column) -> Column:
        def merged(best: Column, at: Column) -> Column:
            # at is counted from 1, F.get and the places of transform from 0.
            made, before = F.shiftright(best, PAIR_BITS), F.get(state, at - 2)
            left = pair(id_of(before), made) + before.bitwiseAND(_number(below))
            own = pair(made, id_of(F.get(state, at + 1))) + best.bitwiseAND(_number(below - NEVER)) + made

            def changed(entry: Column, i: Column) -> Column:
                kept = F.when((i < at - 2) | (i > at), entry).when(i == at, _number(GONE))
                return kept.when(i == at - 1, own).otherwise(left)

            return F.array_remove(F.transform(state, changed), _number(GONE))

        def step(best: Column) -> Column:
            found = bound(F.array_position(state, best).cast("int"), lambda at: merged(best, at))
            return F.when(best < _number(NEVER << PAIR_BITS), found).otherwise(state)

        return bound(F.array_min(state), step)

    def folded(ids: Column) -> Column:
        def entry(own: Column, i: Column) -> Column:
            return pair(own, F.get(ids, i + 1)) + F.shiftleft(i.cast("bigint"), ID_BITS) + own

        front = F.array(_number((NEVER << PAIR_BITS) + NOTHING))
        start, steps = F.concat(front, F.transform(ids, entry)), F.slice(ids, F.lit(2), F.size(ids))
        return F.aggregate(steps, start, merge, lambda state: F.transform(F.slice(state, F.lit(2), F.size(state)), lambda e: id_of(e).cast("int")))

    places = F.sequence(F.lit(1), F.length(word))
    return bound(F.transform(places, lambda i: F.get(letters, F.ascii(F.substr(word, i, F.lit(1))))), folded)


def fold_all(merges: Merges, words: Column) -> Column:
    """Ids of each word of an array of words, strings with a character for each byte."""
    lists, letters = rank_map(merges)
    return bound(lists, lambda a: bound(letters, lambda b: F.transform(words, lambda w: fold(a, b, w))))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: a heap of pairs over a linked list of pieces."""
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(word):
            pair = pieces[i] + pieces[after[i]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if pieces[i] is None or after[i] >= len(word) or pieces[i] + pieces[after[i]] != pair:
            continue
        gone = after[i]
        pieces[i], pieces[gone] = pair, None
        after[i] = after[gone]
        if after[i] < len(word):
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for p in pieces if p is not None]


def _id_type(ranks: dict[bytes, int]) -> np.dtype:
    """Type of packed ids; its largest value marks a word that waits for the fold."""
    return np.dtype(np.uint16 if max(ranks.values(), default=0) < 65535 else np.uint32)


class WordTable:
    """Packed ids of words, the most frequent first. It travels as two columns and becomes a lookup once in each Python worker.

    Few words make up nearly all of a text: they are in a dictionary. The others
    are found by their hash in flat arrays, which take a fifth of its memory.
    """

    def __init__(self, words: pa.Array, ids: pa.Array, packed: np.dtype):
        self.words, self.ids, self.packed = words, ids, packed
        self._quick: dict[str, bytes] | None = None
        self.pieces: Pieces | None = None

    def __getstate__(self):
        return self.words, self.ids, self.packed

    def __setstate__(self, state):
        self.__init__(*state)

    def __len__(self) -> int:
        return len(self.words)

    def _packed(self, row: int) -> bytes:
        return self._numbers[self._ends[row] : self._ends[row + 1]].tobytes()

    def quick(self) -> dict[str, bytes]:
        """The most frequent words and their ids."""
        if self._quick is None:
            self._ends = self.ids.offsets.to_numpy()
            self._numbers = self.ids.values.to_numpy().view(self.packed)
            hashes = [np.zeros(0, dtype=np.int64)]
            for at in range(0, len(self), BATCH_WORDS):
                words = self.words.slice(at, BATCH_WORDS)
                hashes.append(np.fromiter(map(hash, words.to_pylist()), np.int64, len(words)))
            hashes = np.concatenate(hashes)
            self._rows = np.argsort(hashes, kind="stable").astype(np.int32)
            self._hashes = hashes[self._rows]
            self._quick = {w: self._packed(i) for i, w in enumerate(self.words.slice(0, QUICK_WORDS).to_pylist())}
        return self._quick

    def find(self, words: Sequence[str]) -> list[bytes | None]:
        """The ids of words, None for words outside the table."""
        self.quick()
        if not len(self) or not words:
            return [None] * len(words)
        places = np.searchsorted(self._hashes, np.fromiter(map(hash, words), np.int64, len(words)))
        rows = self._rows[np.minimum(places, len(self) - 1)]
        same = pc.equal(self.words.take(pa.array(rows)), pa.array(words, pa.string())).to_pylist()
        return [self._packed(row) if found else None for row, found in zip(rows.tolist(), same, strict=True)]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def word_table(docs: DataFrame, ranks: dict[bytes, int], merges: Merges, most: int) -> WordTable:
    """The most frequent distinct words of all texts, ``most`` at most."""

    def count(batches):
        cut = COUNTED.findall
        seen: Counter[str] = Counter()  # pieces between blanks; only different ones are cut into words

        def rows():
            counts: dict[str, int] = {}
            get = counts.get
            for piece, n in seen.items():
                for w in cut(" " + piece):
                    counts[w] = get(w, 0) + n
            words = pa.array(counts.keys(), pa.string())
            every = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
            return every.filter(pc.less_equal(pc.binary_length(words), TABLE_BYTES))

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(text.split(" "))
                    if len(seen) > PART_WORDS:  # hand on what was counted so far; the sums come later
                        yield rows()
                        seen.clear()
        yield rows()

    counted = docs.select("text").mapInArrow(count, "word string, n bigint")
    level = F.floor(F.log2(F.sum("n")) * 8).cast("int")
    words = stored(counted.groupBy("word").agg(level.alias("level")), "words")
    room, least = most, None
    for row in words.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few hundred levels at most
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    chosen = words.filter(F.lit(False) if least is None else F.col("level") >= least)
    spelt = F.array(F.decode(F.col("word").cast("binary"), "ISO-8859-1"))
    small = "smallint" if _id_type(ranks) == np.uint16 else "int"
    ids = F.get(fold_all(merges, spelt), F.lit(0))
    if small == "smallint":  # the bits of an unsigned number of two bytes
        ids = F.transform(ids, lambda i: F.when(i > 32767, i - 65536).otherwise(i).cast(small))
    found = chosen.select("word", ids.alias("ids"), "level").toArrow().sort_by([("level", "descending")])
    if merges.whole:  # known as they are, whatever the fold makes of them
        found = found.filter(pc.invert(pc.is_in(pc.cast(found.column("word"), pa.binary()), pa.array(merges.whole, pa.binary()))))
    return WordTable(_whole(found.column("word")), _whole(found.column("ids")), _id_type(ranks))


def _joined(ids: np.ndarray, ends: np.ndarray, written: pa.Array, between: bytes) -> list[bytes]:
    """For each text, what is written for its ids, joined."""
    texts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), written.take(pa.array(ids)))
    return pc.binary_join(texts, pa.scalar(between, pa.large_binary())).to_pylist()


def _outputs(ids: np.ndarray, ends: np.ndarray, tokens: pa.Array, digits: pa.Array, names: Sequence[str]) -> list[pa.Array]:
    """The wanted columns of a batch; the ids of a text lie from one of ``ends`` to the next."""

    def hashes(written: pa.Array, between: bytes) -> pa.Array:
        return pa.array([hashlib.sha256(text).hexdigest() for text in _joined(ids, ends, written, between)], pa.string())

    made: dict[str, Callable[[], pa.Array]] = {
        "n_tokens": lambda: pa.array(np.diff(ends), pa.int64()),
        "ids": lambda: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))),
        "ids_sha256": lambda: hashes(digits, b" "),
        "decoded_sha256": lambda: hashes(tokens, b""),
    }
    return [made[name]() for name in names]


TYPES = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}


def _put_in(known: pa.Array, folded: pa.Array, packed: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a batch one behind the other, with folded words in their places, and where each text ends."""
    buffer = b"".join(known.to_pylist())
    ids = np.frombuffer(buffer, dtype=packed)
    ends = np.cumsum([0, *(pc.binary_length(known).to_numpy(zero_copy_only=False) // packed.itemsize)], dtype=np.int64)
    words = folded.flatten()
    if not len(words):
        return ids, ends
    waits = ids == np.iinfo(packed).max
    lengths = np.ones(len(ids), dtype=np.int64)
    lengths[waits] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    places = np.concatenate([[0], np.cumsum(lengths)])
    whole = np.repeat(ids, lengths)
    whole[np.repeat(waits, lengths)] = words.flatten().to_numpy(zero_copy_only=False).astype(packed)
    return whole, places[ends]


def _grouped(ends: np.ndarray, groups: np.ndarray) -> pa.Buffer:
    """Ends of groups of values, given the ends of the values and where groups begin, the end of the last one behind."""
    return pa.py_buffer(ends[groups].astype(np.int32))


def _ends(lengths: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)])


class Pieces:
    """Ids of texts by their different pieces.

    Where the pattern allows it texts are cut at blanks, which is quick, and only
    the different pieces of a batch are cut into words. Else a piece is a word.
    """

    def __init__(self, pattern: str, table: WordTable, ranks: dict[bytes, int], whole: dict[bytes, int]):
        self.table, self.ranks, self.whole = table, ranks, whole
        self.words = regex.compile(pattern).findall
        self.mark = table.packed.type(np.iinfo(table.packed).max).tobytes()
        self.at_blanks = pattern == CUT_AT_BLANKS
        self.blank = regex.compile(r" (?=\S)")

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of each text, without the blank in front, and the places of the texts in this list."""
        if not self.at_blanks:
            return pa.array(map(self.words, texts.to_pylist()), pa.list_(pa.string())), np.arange(len(texts))
        odd = pc.match_substring_regex(texts, ODD_BLANK)
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        others = pa.array(map(self.blank.split, texts.filter(odd).to_pylist()), pa.list_(pa.string()))
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        return pa.concat_arrays([plain, others]), np.argsort(order)

    def _split(self, pieces: list[str], firsts: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of pieces behind a blank and of those that begin a text; where the words of each begin."""
        if not self.at_blanks:
            return pieces, np.arange(len(pieces) + 1)
        # A piece with blanks of its own, or found at the beginning of a text only, must not touch its neighbours.
        alone = [i for i, p in enumerate(pieces) if not p or p[0].isspace() or " " in p]
        joined = pieces
        if alone:
            joined = pieces.copy()
            for i in alone:
                joined[i] = "x"
        words = self.words(" " + " ".join(joined)) if pieces else []
        begins = [i for i, w in enumerate(words) if w[0] == " "]
        for text in [*(" " + pieces[i] for i in alone), *firsts]:
            begins.append(len(words))
            words += self.words(text)
        for i, place in enumerate(alone):  # their words stand behind those of the others
            pieces[place] = len(joined) + i
        return words, np.array([*begins, len(words)], dtype=np.int64)

    def _unknown(self, word: str, rest: list[str]) -> bytes:
        """Ids of a word outside the table, or the mark of one that waits in ``rest`` for the fold."""
        packed, raw = self.table.packed, word.encode("utf-8", "surrogatepass")
        if raw in self.whole:
            return packed.type(self.whole[raw]).tobytes()
        if len(raw) > FOLD_BYTES:
            return np.array(merge_long(raw, self.ranks), dtype=packed).tobytes()
        rest.append(raw.decode("iso-8859-1"))
        return self.mark

    def _found(self, words: list[str]) -> tuple[pa.Array, list[str], np.ndarray]:
        """Packed ids of words; the words that wait for the fold, and how many of these stand before each word."""
        parts = list(map(self.table.quick().get, words))
        lacking = [i for i, part in enumerate(parts) if part is None]
        others = list(dict.fromkeys([words[i] for i in lacking]))
        others = dict(zip(others, self.table.find(others), strict=True))
        rest: list[str] = []
        waits = np.zeros(len(words) + 1, dtype=np.int64)
        for i in lacking:
            part = others[words[i]]
            if part is None:
                before = len(rest)
                part = self._unknown(words[i], rest)
                waits[i + 1] = len(rest) - before
            parts[i] = part
        return pa.array(parts, pa.binary()), rest, np.cumsum(waits)

    def look_up(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Packed ids of each text, and its words that wait for the fold, in order."""
        cut, order = self._cut(pc.fill_null(texts.cast(pa.string()), ""))
        starts, flat = _ends(pc.list_value_length(cut)), cut.flatten().dictionary_encode()
        pieces, places = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        firsts: list[str] = []
        if self.at_blanks:
            firsts = flat.take(pa.array(starts[:-1])).to_pylist()
        words, begins = self._split(pieces, firsts)
        if self.at_blanks:
            moved = np.array([p if isinstance(p, int) else i for i, p in enumerate(pieces)], dtype=np.int64)
            places = moved[places]
            places[starts[:-1]] = np.arange(len(firsts)) + (len(begins) - 1 - len(firsts))
        ids, rest, waits = self._found(words)
        n = len(begins) - 1
        data = ids.buffers()[2] or pa.py_buffer(b"")
        blobs = pa.Array.from_buffers(pa.binary(), n, [None, _grouped(_ends(pc.binary_length(ids)), begins), data])
        rests = pa.ListArray.from_arrays(pa.array(waits[begins], pa.int32()), pa.array(rest, pa.string()))
        picked, waiting = blobs.take(pa.array(places)), rests.take(pa.array(places))
        data, rows = picked.buffers()[2] or pa.py_buffer(b""), len(cut)
        known = pa.Array.from_buffers(pa.binary(), rows, [None, _grouped(_ends(pc.binary_length(picked)), starts), data])
        lists = pa.ListArray.from_arrays(pa.array(_ends(pc.list_value_length(waiting))[starts], pa.int32()), waiting.flatten())
        return known.take(pa.array(order)), lists.take(pa.array(order))


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    outputs: Sequence[str] = ("n_tokens", "ids"),
    keep: Sequence[str] | None = None,
    apart: bool = False,
    table_words: int | None = None,
) -> DataFrame:
    """Documents with the wanted outputs: n_tokens, ids, ids_sha256 and decoded_sha256.

    ``keep`` names the columns to carry along, all unless given. ``apart`` writes
    the packed ids to the shared folder halfway: it takes about the room of the
    texts, and a task then has one Python worker at a time instead of two.
    ``table_words`` is the size of the table of words, TABLE_WORDS unless given;
    a smaller one takes less memory and more time, for the same rows.

    Only ``text`` is read, whole at any length; null counts as empty and has no
    id. Every single byte must have a rank. Equal texts get equal ids. An empty
    table gives an empty one. Columns of the added names are replaced, others kept.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, outputs)
    context = docs.sparkSession.sparkContext
    merges = read_merges(ranks)
    table = context.broadcast(word_table(docs, ranks, merges, TABLE_WORDS if table_words is None else table_words))
    pa.default_memory_pool().release_unused()  # the driver needs its copy of the table no more
    shipped = context.broadcast(ranks)
    names = docs.columns if keep is None else [n for n in docs.columns if n in keep]
    kept = docs.select(*names).schema
    looked_up = pa.schema([pa.field("_known", pa.binary()), pa.field("_rest", pa.list_(pa.string()))])
    packed, whole = _id_type(ranks), merges.whole

    def look_up(batches):
        own = table.value
        if own.pieces is None:
            own.pieces = Pieces(pattern, own, shipped.value, whole)
        for batch in batches:
            more = own.pieces.look_up(batch.column("text"))
            yield appended([batch.column(n) for n in names], names, more, looked_up)

    final = pa.schema([pa.field(name, TYPES[name]) for name in outputs])

    def put_in(batches):
        _ = table  # a worker forgets what its next task does not name, and would build the table again
        tokens: list[bytes] = [b""] * (max(shipped.value.values(), default=-1) + 1)
        for token, rank in shipped.value.items():
            tokens[rank] = token
        digits = pa.array([str(i).encode() for i in range(len(tokens))], pa.large_binary())
        tokens = pa.array(tokens, pa.large_binary())
        for batch in batches:
            ids, ends = _put_in(batch.column("_known"), batch.column("_folded"), packed)
            made = _outputs(ids, ends, tokens, digits, outputs)
            yield appended([batch.column(n) for n in names], names, made, final)

    found = docs.mapInArrow(look_up, extended(kept, looked_up))
    if apart:
        found = stored(found, "looked_up")
    folded = found.select(*names, "_known", fold_all(merges, F.col("_rest")).alias("_folded"))
    return folded.mapInArrow(put_in, extended(kept, final))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Rows with ``decoded``, the concatenated bytes of an array of ids; null ids give null, no id empty bytes."""
    hexes = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        hexes[rank] = token.hex()
    pieces = F.from_json(F.lit(json.dumps(hexes)), "array<string>")
    text = bound(pieces, lambda table: F.array_join(F.transform(F.col(ids), lambda i: F.get(table, i)), ""))
    return without(rows, ["decoded"]).withColumn("decoded", F.unhex(text))
