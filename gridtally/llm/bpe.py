"""Byte-pair encoding and decoding of whole texts.

A word's parts are held as one contiguous array of boundaries with a second
array of adjacent ranks: the rank at place i is that of the merge of part i with
part i+1.  Encoding scans the ranks for the minimum, deletes the boundary there
and refreshes the two neighbouring ranks, until no merge is left.  Words are
short, so the scan beats a heap; a word longer than LONG_WORD symbols (junk
without white space) takes a heap over the same merges, which gives the same
tokens in n log n steps.

Null texts count as empty; an empty text has no tokens and decodes to ''.
Repeated rows are encoded each, a very long text is encoded whole in its row, and an
empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.llm.common import text_slices

NONE = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
LONG_WORD = 256
#: Entries in each of a worker's two word tables: when the young one is full it
#: becomes the old one, and what is still in use moves back on its next sight.
WORD_TABLE = 100_000
#: Characters of the longest piece that a table keeps, so that junk cannot fill memory.
KEPT_PIECE = 64


#: White space as Unicode defines it; str.split() also cuts at SEPARATORS, which are not.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"


# How the library's Unicode tables differ from Python's (15.1), as hexadecimal
# code points and ranges of them.  Letters and numbers that it knows and Python does not:
NEWER_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389"
    " 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C"
    " 18CFF 1E5D0-1E5ED 1E5F0"
)
NEWER_NUMBERS = (
    "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
)
# Capitals, each run with the first of their small letters:
NEWER_CAPITALS = (
    "1C89=1C8A A7CB=264 A7CC=A7CD A7CE=A7CF A7D2=A7D3 A7D4=A7D5 A7DA=A7DB A7DC=19B"
    " 10D50-10D65=10D70 16EA0-16EB8=16EBB"
)
# Combining marks that it takes for characters of their own when it orders marks:
OWN_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27"
    " 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E"
    " 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F"
    " 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def listed(ranges: str) -> list[int]:
    """The code points of hexadecimal ranges."""
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [c for r in ends for c in range(r[0], r[-1] + 1)]


def small_letters() -> dict[int, int]:
    """Capitals whose small letters Python does not know."""
    found = {}
    for run in NEWER_CAPITALS.split():
        capitals, first = run.split("=")
        found |= {c: int(first, 16) + i for i, c in enumerate(listed(capitals))}
    return found


@lru_cache(1)
def major_classes() -> np.ndarray:
    """The first letter of each code point's category, as the library has it."""
    majors = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    majors[listed(NEWER_LETTERS)] = "L"
    majors[listed(NEWER_NUMBERS)] = "N"
    return majors


def code_ranges(major: str) -> str:
    """The inside of a character class: all code points whose category starts with major."""
    inside = major_classes() == major
    edges = np.flatnonzero(np.diff(np.array([False, *inside, False], np.int8)))
    return "".join(
        f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())
    )


#: Small letters one by one, so that a final sigma stays an ordinary one.
SMALL = {ord("Σ"): "σ", **small_letters()}
OWN_MARK = re.compile("([" + "".join(map(chr, listed(OWN_MARKS))) + "])")
CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")


def composed(text: str) -> str:
    """The text in normal form C; at marks that are characters of their own it starts anew."""
    if OWN_MARK.search(text):
        return "".join(unicodedata.normalize("NFC", x) for x in OWN_MARK.split(text))
    return unicodedata.normalize("NFC", text)


@lru_cache(1)
def class_table() -> dict[str, str]:
    return {r"\p{L}": code_ranges("L"), r"\p{N}": code_ranges("N"), r"\s": SPACES}


def compiled(pattern: str) -> re.Pattern:
    """A split pattern of a tokenizer file, its Unicode classes written out."""
    for name, inside in class_table().items():
        pattern = re.sub(rf"\[{re.escape(name)}\]", lambda m: f"[{inside}]", pattern)  # noqa: B023
        pattern = pattern.replace(name, inside)
    return re.compile(pattern)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def merge_parts(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the symbols of one word; ties go to the leftmost pair.

    merges takes a pair of ids, packed into one number, to its rank and the id
    of the merged token, packed so that the least value is the least rank.
    """
    if len(parts) > LONG_WORD:
        return merge_long(parts, merges)
    rank = merges.get
    ranks = [rank(a << ID_BITS | b, NONE) for a, b in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        parts[i] = least & ID_MASK
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank(parts[i] << ID_BITS | parts[i + 1], NONE)
        if i:
            ranks[i - 1] = rank(parts[i - 1] << ID_BITS | parts[i], NONE)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same merges by a heap of (rank, place) over linked parts."""
    end = len(parts)
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < end:
            pair = parts[i] << ID_BITS | parts[after[i]]
            if pair in merges:
                heapq.heappush(heap, (merges[pair], i, pair))

    for i in range(end):
        offer(i)
    while heap:
        merged, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= end or parts[i] << ID_BITS | parts[j] != pair:
            continue
        parts[i], parts[j] = merged & ID_MASK, -1
        after[i] = after[j]
        if after[i] < end:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [p for p in parts if p >= 0]


class WordCodec(dict):
    """Encoder and decoder of one tokenizer file with word ends.

    As a mapping it takes a piece of a text that holds no white space to its
    ids (int32 bytes); unknown pieces are encoded on first sight, word by word.
    """

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {
            self.vocab[a] << ID_BITS | self.vocab[b]: i << ID_BITS | self.vocab[a + b]
            for i, (a, b) in enumerate(pairs)
        }
        self.first = [self.vocab[c] for c in byte_letters()]
        self.last = [self.vocab[c + self.suffix] for c in byte_letters()]
        split = next(
            p["pattern"]["Regex"]
            for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        self.words = compiled(split).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        any_special = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.specials = re.compile(f"({any_special})") if self.special else None

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            words = self.words(piece)
            if words == [piece]:
                found = array("i", self.word_ids(piece)).tobytes()
            else:
                found = b"".join([self[word] for word in words])
        if len(piece) > KEPT_PIECE:
            return found
        if len(self) >= WORD_TABLE:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def word_ids(self, word: str) -> list[int]:
        *front, end = word.encode("utf-8")
        return merge_parts([*map(self.first.__getitem__, front), self.last[end]], self.merges)

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = composed(text)
            text = text.translate(SMALL) if CAPITAL.search(text) else text
        text = text.lower()
        if any(c in text for c in SEPARATORS):
            pieces = filter(None, re.split(f"[{SPACES}]+", text))
        else:
            pieces = text.split()
        return b"".join(map(self.__getitem__, pieces))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if not any(s in text for s in self.special):
            return np.frombuffer(self.plain(text), np.int32)
        found = [
            array("i", [self.special[x]]).tobytes() if x in self.special else self.plain(x)
            for x in self.specials.split(text)
        ]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> WordCodec:
    """One codec per worker process and file."""
    return WordCodec(path)


def _mapped(df: DataFrame, made: dict[str, T.DataType], step, text_col: str | None) -> DataFrame:
    """df with the columns that step makes from each Arrow batch; clashing ones are replaced."""
    kept = [c for c in df.columns if c.lower() not in {m.lower() for m in made}]

    def run(batches):
        for batch in text_slices(batches, text_col) if text_col else batches:
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *step(batch)], names=[*kept, *made])

    fields = [df.schema[c] for c in kept] + [T.StructField(n, kind) for n, kind in made.items()]
    return df.mapInArrow(run, T.StructType(fields))


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(
    df: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "token_ids"
) -> DataFrame:
    """df with out_col, the token ids (array of int) of the whole text."""

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(tokenizer)
        return [id_lists([own.encode(x.as_py()) for x in batch.column(text_col)])]

    return _mapped(df, {out_col: T.ArrayType(T.IntegerType())}, step, text_col)


def decode(
    df: DataFrame, tokenizer: str, ids_col: str = "token_ids", out_col: str = "decoded"
) -> DataFrame:
    """df with out_col, the text that the ids stand for; null ids decode to ''."""

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(tokenizer)
        texts = (own.decode(x.as_py() or []) for x in batch.column(ids_col))
        return [pa.array(texts, pa.string())]

    return _mapped(df, {out_col: T.StringType()}, step, None)


def round_trip(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """df with token_ids and what they decode to, in one pass and one worker per task."""

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        own = codec(tokenizer)
        ids = [own.encode(x.as_py()) for x in batch.column(text_col)]
        return [id_lists(ids), pa.array((own.decode(x.tolist()) for x in ids), pa.string())]

    made = {"token_ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return _mapped(df, made, step, text_col)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return df.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
