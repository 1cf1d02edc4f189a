"""Token counts by finite-state transducers.

Two deterministic machines count the tokens of a byte-level BPE vocabulary
without building them.

The splitter reads characters by class and marks where words start.  It has
eight states, so a chunk of text is a map from state to state.  All chunks of a
batch are read side by side, one character of each at a time; their maps are
composed by a parallel prefix scan, which tells the state that each chunk
starts in.  A second reading emits the marks.

The merger reads the bytes of words.  Its states are what the rest of a word
can still depend on: the longest suffix that begins some token, and for each
place in it where a token may start, the last token before that place and the
number of tokens up to it.  A transition is annotated with the change of the
number of tokens, so the annotations of a word sum to its token count.  States
are compiled when text first asks for them.  A word start leads out of every
state to the same place, so a chunk that begins with a word is a constant map
and chunks again run side by side.

That a sequence of tokens is the encoding of its bytes if and only if each
adjacent pair is the encoding of the pair's bytes makes the last token of each
prefix unique, hence the machine deterministic; pairs are checked by merging.

States and transitions have a bound.  Where junk, words of megabytes that share no
states, has filled it, the machine starts afresh with the states that are in use just
then, in the midst of a word: counts do not change, memory stays, and the time is that of
compiling transitions: measured, 5 s a MB of base64 and 80 s a MB of random letters.

Defined results: null texts count as empty; an empty text has no tokens.  Repeated rows
are counted each.  A very long text is one slice, counted whole.  An empty table gives an
empty result.  A column named like the result is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.llm.bpe import ID_BITS, byte_letters, major_classes, merge_parts
from gridtally.llm.common import text_slices

#: Bytes of text read side by side at once, and the length of a chunk.
SLICE_BYTES = 8 << 20
CHUNK = 256
#: States of the merger before it is compiled afresh, some 60 MB of memory, and
#: the places in its hashed table of transitions.
MOST_STATES = 250_000
TABLE_BITS = 21
NO_TOKEN = (1 << 17) - 1
#: A place of a state: token << TOKEN | length << LENGTH | ORIGIN + number of tokens.
TOKEN, LENGTH, FIELD, ORIGIN = 32, 16, (1 << 16) - 1, 1 << 15
HASH, HASH_BITS, HASH_MASK = 0x9E3779B1, 40, (1 << 40) - 1
END = 0xFF  # between texts; UTF-8 has no such byte

# Symbols of the splitter: letter, number, other, apostrophe that may begin a
# contraction of two or three characters, white space inside a run, the last
# white space before something else if it is a blank, or if not, and an end.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, LONE, STOP = range(9)
# States: between words, in letters, numbers, other, white space, after the
# blank that begins a word, one and two characters before a contraction's end.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and word-start mark, by state and symbol."""
    begin = {
        LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_LEFT,
        LONG: TWO_LEFT, SPACE: IN_SPACE, BLANK: AFTER_BLANK, LONE: FREE, STOP: FREE,
    }
    goes_on = {
        (IN_LETTERS, LETTER): IN_LETTERS, (IN_NUMBERS, NUMBER): IN_NUMBERS,
        (IN_SPACE, SPACE): IN_SPACE, (AFTER_BLANK, LETTER): IN_LETTERS,
        (AFTER_BLANK, NUMBER): IN_NUMBERS, (ONE_LEFT, LETTER): FREE,
        (TWO_LEFT, LETTER): ONE_LEFT,
    }
    for state in (IN_OTHER, AFTER_BLANK):
        goes_on |= {(state, symbol): IN_OTHER for symbol in (OTHER, SHORT, LONG)}
    step, mark = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for state in range(8):
        for symbol, start in begin.items():
            step[state, symbol] = goes_on.get((state, symbol), start)
            mark[state, symbol] = (state, symbol) not in goes_on
    return step, mark


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[major_classes() == "L"] = LETTER
    kinds[major_classes() == "N"] = NUMBER
    spaces = "\t\n\x0b\x0c\r \x85\xa0     　"
    kinds[[*map(ord, spaces), *range(0x2000, 0x200B)]] = SPACE
    return kinds


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where characters start, and their code points; END is -1."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at].astype(np.int32)
    points = first.copy()
    for lead, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero((first >= lead) & (first < (lead | mask) + 1 - (lead == 0xF0) * 1))
        found = first[wide] & mask
        for k in range(1, more + 1):
            found = found << 6 | (data[np.minimum(at[wide] + k, len(data) - 1)] & 0x3F)
        points[wide] = found
    points[first == END] = -1
    return at, points


def symbols(points: np.ndarray) -> np.ndarray:
    """The splitter's symbols; white space and apostrophes look ahead."""
    kinds = letter_classes()[np.maximum(points, 0)]
    found = kinds.copy()
    found[points < 0] = STOP
    ahead = np.append(points[1:], [-1, -1])
    spaces = np.flatnonzero(kinds == SPACE)
    follows = ahead[spaces]
    last = spaces[(follows >= 0) & (kinds[np.minimum(spaces + 1, len(kinds) - 1)] != SPACE)]
    found[last] = np.where(points[last] == ord(" "), BLANK, LONE)
    quotes = np.flatnonzero(points == ord("'"))
    one, two = ahead[quotes], ahead[quotes + 1]
    found[quotes[np.isin(one, [*map(ord, "stmd")])]] = SHORT
    pair = np.isin(one * 0x200000 + two, [ord(a) * 0x200000 + ord(b) for a, b in ("re", "ve", "ll")])
    found[quotes[pair]] = LONG
    return found


def word_starts(found: np.ndarray) -> np.ndarray:
    """Marks of the symbols that start a word, by composed chunk maps."""
    step, mark = splitter_tables()
    step, mark = step.ravel(), mark.ravel()
    rows = -(-len(found) // CHUNK)
    grid = np.full(rows * CHUNK, STOP, np.uint8)
    grid[: len(found)] = found
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = step[maps * np.uint8(9) + column[:, None]]
    reach = 1
    while reach < rows:  # after this, maps[i] leads over chunks 0..i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.append(np.uint8(FREE), maps[:-1, FREE])
    marks = np.empty(grid.shape, bool)
    for i, column in enumerate(grid):
        at = state * np.uint8(9) + column
        marks[i], state = mark[at], step[at]
    return marks.T.ravel()[: len(found)]


class Merger:
    """The byte transducer of one vocabulary, compiled as far as texts have asked."""

    def __init__(self, path: str, table_bits: int = TABLE_BITS):
        self.room, self.shift = 1 << table_bits, HASH_BITS - table_bits
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {
            vocab[a] << ID_BITS | vocab[b]: i << ID_BITS | vocab[a + b]
            for i, (a, b) in enumerate(pairs)
        }
        self.byte_id = [vocab[c] for c in byte_letters()]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        names = {t["content"] for t in spec["added_tokens"]}
        self.id = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in names}
        self.bytes = {i: t for t, i in self.id.items()}
        if max(map(len, self.id)) > FIELD:
            raise ValueError(f"a token has more than {FIELD} bytes")
        self.starts = {t[:k] for t in self.id for k in range(1, len(t))}  # a byte must follow
        self.allowed: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states and transitions but keep what is known of pairs."""
        first = array("Q", [NO_TOKEN << TOKEN | ORIGIN]).tobytes()
        self.states = [first]
        self.number = {first: 0}
        self.transitions = 0
        #: Open addressing: (state * 256 + byte) << 32 | next state << 8 | 128 + change
        self.table = np.full(self.room, -1, np.int64)

    def full(self) -> bool:
        return len(self.states) > MOST_STATES or self.transitions > self.room // 2

    def renew(self, live: np.ndarray) -> np.ndarray:
        """Start afresh with the states in use, and give their new numbers."""
        used, where = np.unique(live, return_inverse=True)
        held = [self.states[i] for i in used]
        self.reset()
        for state in held:
            if state not in self.number:
                self.number[state] = len(self.states)
                self.states.append(state)
        return np.array([self.number[state] for state in held])[where]

    def encode(self, word: bytes) -> list[int]:
        return merge_parts([self.byte_id[b] for b in word], self.merges)

    def follows(self, before: int, token: int) -> bool:
        """Whether token may stand after before, or first in a word and by itself."""
        key = before << 17 | token
        found = self.allowed.get(key)
        if found is None:
            if len(self.allowed) > 300_000:
                self.allowed.clear()
            if before == NO_TOKEN:
                found = self.encode(self.bytes[token]) == [token]
            else:
                found = self.encode(self.bytes[before] + self.bytes[token]) == [before, token]
            self.allowed[key] = found
        return found

    def compile(self, state: int, byte: int) -> None:
        """Add the transition of state on byte.

        A state is its suffix, after packed places: for each length of the
        suffix's suffixes that begin a token, and for 0, the last token before
        the place and the number of tokens up to it, relative to now.
        """
        packed = self.states[state]
        size = array("Q", packed[:8])[0] >> LENGTH & FIELD  # the longest place's length
        text = packed[len(packed) - size :] + bytes((byte,))
        places = array("Q", packed[: len(packed) - size])
        n, ids = len(text), self.id
        for place in places:  # longest first
            token = ids.get(text[n - (place >> LENGTH & FIELD) - 1 :])
            if token is not None and self.follows(place >> TOKEN, token):
                change = (place & FIELD) - ORIGIN + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        if not -128 <= change < 128:
            raise ValueError("a byte changes the number of tokens by more than the table holds")
        starts = self.starts
        kept = [
            place + (1 << LENGTH) - change
            for place in places
            if text[n - (place >> LENGTH & FIELD) - 1 :] in starts
        ]
        size = kept[0] >> LENGTH & FIELD if kept else 0
        kept.append(token << TOKEN | ORIGIN)
        follower = array("Q", kept).tobytes() + text[n - size :]
        found = self.number.get(follower)
        if found is None:
            found = self.number[follower] = len(self.states)
            self.states.append(follower)
        key = state << 8 | byte
        at = (key * HASH & HASH_MASK) >> self.shift
        while self.table[at] >= 0:
            at = (at + 1) & (len(self.table) - 1)
        self.table[at] = key << 32 | found << 8 | change + 128
        self.transitions += 1

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """Next state << 8 | 128 + change for each state * 256 + byte."""
        while True:
            at = (key * HASH & HASH_MASK) >> self.shift
            found = self.table[at]
            other = np.flatnonzero(found >> 32 != key)
            lost = []
            while len(other):
                absent = found[other] < 0
                lost.append(other[absent])
                other = other[~absent]
                at[other] = (at[other] + 1) & (len(self.table) - 1)
                found[other] = self.table[at[other]]
                other = other[found[other] >> 32 != key[other]]
            lost = np.concatenate(lost) if lost else other
            if not len(lost):
                return found & 0xFFFFFFFF
            for k in np.unique(key[lost]).tolist():
                self.compile(k >> 8, k & 255)

    def run(self, data: np.ndarray, starts: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """The number of tokens of each chunk; chunks begin with a word.

        They are run side by side, so many at once that what a step adds always finds
        room; between two steps the machine starts afresh where it has grown too large.
        """
        packed = data | np.where(starts, 0, -256).astype(np.int32)
        order = np.argsort(-length, kind="stable")
        counted = np.empty(len(begin), np.int64)
        side_by_side = self.room >> 6
        for a in range(0, len(order), side_by_side):
            group = order[a : a + side_by_side]
            counted[group] = self.run_group(packed, begin[group], length[group])
        return counted

    def run_group(self, packed: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of tokens of each chunk, the longest chunk first."""
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        state = np.zeros(len(begin), np.int64)
        total = np.zeros(len(begin), np.int64)
        for t in range(int(length[0])):
            n = active[t]
            if self.full():
                state[:n] = self.renew(state[:n])
            symbol = packed[begin[:n] + t]  # negative inside a word
            found = self.look_up((state[:n] & (symbol >> 8)) << 8 | symbol & 255)
            state[:n] = found >> 8
            total[:n] += (found & 255) - 128
        return total

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text; special tokens are text here."""
        data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        firsts = ends - [len(t) + 1 for t in texts]
        at, points = code_points(data)
        starts = np.zeros(len(data), bool)
        starts[at[word_starts(symbols(points))]] = True
        starts[data == END] = False
        words = np.flatnonzero(starts)
        found = np.zeros(len(texts), np.int64)
        if len(words):
            marks = np.arange(0, words[-1] + 1, CHUNK)
            begin = np.unique(
                np.append(words[np.searchsorted(words, marks)], firsts[firsts < ends - 1])
            )
            owner = np.searchsorted(ends, begin, side="right")
            length = np.minimum(np.append(begin[1:], len(data)), ends[owner] - 1) - begin
            np.add.at(found, owner, self.run(data, starts, begin, length))
        return found


@lru_cache(2)
def merger(path: str) -> Merger:
    """One machine per worker process and file."""
    return Merger(path)


def counts(texts: list[bytes], machine: Merger) -> np.ndarray:
    """Token counts of whole texts: special tokens are cut out and count one each."""
    cut = re.compile(b"|".join(map(re.escape, machine.special))) if machine.special else None
    pieces, owner = [], []
    total = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = cut.split(text) if cut and any(s in text for s in machine.special) else [text]
        total[i] = len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    a = 0
    while a < len(pieces):
        b, size = a, 0
        while b < len(pieces) and (b == a or size + len(pieces[b]) < SLICE_BYTES):
            size, b = size + len(pieces[b]), b + 1
        np.add.at(total, owner[a:b], machine.count(pieces[a:b]))
        a = b
    return total


def token_counts(
    df: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "n_tokens"
) -> DataFrame:
    """df with out_col (long): the tokens of the whole text; a clashing column is replaced."""
    kept = [c for c in df.columns if c.lower() != out_col.lower()]

    def run(batches):
        for batch in text_slices(batches, text_col, SLICE_BYTES):
            column = batch.column(text_col).cast(pa.large_binary())
            texts = [x.as_py() or b"" for x in column]
            found = pa.array(counts(texts, merger(tokenizer)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), found],
                names=[*kept, out_col],
            )

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out_col, T.LongType())])
    return df.mapInArrow(run, schema)


def length_report(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    sized = docs.select(
        "doc_id",
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return token_counts(sized, tokenizer).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
