"""Packing documents into fixed windows by minimum bin slack.

1. Each text becomes ids and an end id. A document is cut at every ``capacity`` ids, so a
   piece has 1 to ``capacity`` ids. Ids stay where they are made; what is shuffled is a
   narrow row for each piece.
2. The plan needs only how many pieces there are of each length, at most ``capacity``
   numbers. A window takes the longest length left; a bitset subset-sum over the lengths left
   (counts in binary parts) finds the multiset that fills the rest closest to capacity, and
   backtracking tells how many of each length. A filling is used as often as the counts
   allow, so the plan has at most a few thousand fillings however many pieces there are.
3. Pieces are numbered within their length, and the number tells window and place.

Defined cases: a null or empty text is its end id alone; a very long text gives many whole
windows; equal rows are packed as often as they occur, null ids like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import cut, numbered, ship

CAPACITY = 4096
END = 2
CHUNKS, WORDS, LATE = 200_000, 100_000, 20

#: Characters for which a chunk's lower case and pieces are the same alone as within its text.
_PLAIN = regex.compile(r"[\x21-\x7eÀ-įı-ɏ]+")
#: One word and marks after it, the usual chunk: letters are a piece and so are the marks.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
#: Separators of str.split that the tokenizer doesn't take for white space.
_ODD = regex.compile(r"[\x1c-\x1f]")


class Encoder:
    """Ids of texts by a tokenizer file that drops white space, as little-endian 32-bit bytes.

    White space never lies within a token there, so the ids of a text are those of its
    chunks. Chunks and words met before come from two bounded tables. ``split`` is the
    tokenizer's own pattern of words, read from its file.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        first, second = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
        self.by_chunk = steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and bool(first.get("invert")) and second.get("type") == "ByteLevel"
        self.split = regex.compile(first["pattern"]["Regex"]) if self.by_chunk else None
        self.special = [x["content"] for x in told["added_tokens"]]
        # how the byte-level step writes each character for which a word may skip it
        from tokenizers.pre_tokenizers import ByteLevel

        step = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: step.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x250)}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.late = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            text = word if word.isascii() else word.translate(self.written)
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
            self._remember(self.words, word, got, WORDS)
        return got

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk; words reach the model only in characters of ``_PLAIN``."""
        if plain := _LETTERS.fullmatch(chunk):
            got = self._word(plain[1].lower()) + (self._word(plain[2]) if plain[2] else b"")
        elif _PLAIN.fullmatch(chunk) and not any(x in chunk for x in self.special):
            got = b"".join([self._word(w) for w in self.split.findall(chunk.lower())])
        else:
            got = self.whole(chunk)
        if len(chunk) <= 64:
            self._remember(self.chunks, chunk, got, CHUNKS)
        return got

    def _remember(self, table: dict[str, bytes], text: str, ids: bytes, most: int) -> None:
        """Frequent texts come early, so a full table stays as it is until many more were met than it holds."""
        if len(table) >= most:
            self.late += 1
            if self.late < LATE * most:
                return
            table.clear()
            self.late = 0
        table[text] = ids

    def forget(self) -> None:
        """Empty the tables: worker processes outlive their tasks, and what they hold counts against later steps."""
        self.chunks.clear()
        self.words.clear()
        self.late = 0

    def ids(self, text: str) -> bytes:
        if not self.by_chunk or _ODD.search(text):
            return self.whole(text)
        known, out = self.chunks, []
        for chunk in text.split():
            got = known.get(chunk)
            out.append(self._chunk(chunk) if got is None else got)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process; its tables serve one task at a time and are emptied after it."""
    return Encoder(path)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each row's ids and, if asked for, the ids themselves."""
    ship(docs.sparkSession)
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        try:
            for batch in batches:
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = own.ids(text.as_py() or "") + last
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, *([np.frombuffer(part, dtype="<u4")] if with_ids else [])))
                cols = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[*"dslcn", "ids"][: 5 + with_ids])
        finally:
            own.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """Column lists, one entry for each length in each filling: of the pieces of ``length``, those numbered ``first`` and on
    go ``each`` to a window, from window ``window``, there from ``offset``."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    window: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    windows: int = 0


def fill(left: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most left[n] of each n, whose sum is closest to room from below."""
    parts: list[tuple[int, int, int]] = []  # (length, how many, bits of the sums reached before)
    reached, mask = 1, (1 << (room + 1)) - 1
    for n in sorted((n for n in left if n <= room and left[n]), reverse=True):
        most, k = min(left[n], room // n), 1
        while most > 0:
            k = min(k, most)
            parts.append((n, k, reached))
            reached |= (reached << n * k) & mask
            most, k = most - k, 2 * k
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, {}
    for n, k, before in reversed(parts):
        if not before >> at & 1:
            at -= n * k
            chosen[n] = chosen.get(n, 0) + k
    return chosen


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fillings until no piece is left; at least one length runs out with each, so there are at most ``capacity`` of them."""
    left, used, plan = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), Plan()
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for n in sorted(chosen, reverse=True):
            k = chosen[n]
            for column, value in zip((plan.length, plan.first, plan.each, plan.window, plan.offset), (n, used[n], k, plan.windows, offset), strict=True):
                column.append(value)
            offset, used[n], left[n] = offset + n * k, used[n] + k * times, left[n] - k * times
            if not left[n]:
                del left[n]
        plan.windows += times
    return plan


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces (with ``length``, at most capacity) and sequence_id, offset."""
    spark = cut_pieces.sparkSession
    ship(spark)
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = plan_windows(counts, capacity)
    table = np.array([plan.length, plan.first, plan.each, plan.window, plan.offset], dtype=np.int64).reshape(5, -1)
    table = table[:, np.lexsort((table[1], table[0]))]
    shared = spark.sparkContext.broadcast(table)  # at most capacity fillings of at most sqrt(2 capacity) lengths each

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, first, each, window, offset = shared.value
        n, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        wide = np.int64(1) << 40  # over any rank
        at = np.searchsorted(size * wide + first, n * wide + r, side="right") - 1
        q, k = np.divmod(r - first[at], each[at])
        return pa.StructArray.from_arrays([pa.array(window[at] + q), pa.array(offset[at] + k * n)], names=["sequence_id", "offset"])

    columns = [c for c in cut_pieces.columns if c != "ids"]
    ranked = numbered(cut_pieces, ["length"], columns, columns, "__rank", "ranks")
    return ranked.withColumn("__at", place(F.col("length"), F.col("__rank"))).select(*cut_pieces.columns, "__at.*")


def packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row."""
    return pack(cut(pieces(docs, tokenizer, id_col, text_col, capacity, end), "pieces"), capacity)
