"""Line dedup: range-partitioned line hashes, sorted by document and position, give a keep bitmap for each document.

Each line's key (the line stripped of ASCII white space, A-Z lower-cased) becomes a 128-bit hash. Rows (hash, document,
position) are range-partitioned by all three, so a line that a third of the documents hold is cut
into as many ranges as its rows need, and sorted within partitions. A partition streams its runs of
equal hashes. Of the first and the last run, which may go on in a neighbour, it also reports the hash and what it
counted, and leaves open what depends on the neighbours; those reports (two a partition) close the open
rows in a second, narrow step.

Two rules: ``keep="first"`` drops every occurrence but the first one in the order of document and position; ``keep="none"``
drops all occurrences of keys that at least ``min_docs`` documents hold. No text is shuffled: the
result has one row for each different document that loses a line, with n_dropped and ``keep``, a
zlib-compressed array of bits: bit i % 8 (from the lowest) of byte i // 8 tells whether line i stays; lines
beyond its end stay. ``apply`` joins the bitmaps to the texts.

Defined cases: a null or empty text is one empty line; lines end at \\n only; keys shorter than ``min_chars`` code points always
stay; every row is a document of its own, so repeated rows count as often as they occur and get
equal bitmaps (for ``keep="first"`` the first occurrence is that of all equal rows together, so they all keep the
line); null ids are ids like any other and sort first; order among ids is theirs, among rows of one id that of
their text's hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import cut, ship

BLANK = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(_LOWER)


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t1, t2): rows with equal values here are copies with equal results."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def lines(own: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, t1, t2, pos, head) of every line that can be dropped; ``head`` marks a key's first place in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            place: list[int] = []
            head: list[bool] = []
            digests = bytearray()

            def told(batch=batch):
                nonlocal row, place, head, digests
                own, h = pa.array(row), np.frombuffer(bytes(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
                out = pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *[batch.column(c).take(own) for c in (0, 2, 3)], pa.array(place, pa.int32()), pa.array(head)], names=["h1", "h2", "doc_id", "t1", "t2", "pos", "head"])
                row, place, head, digests = [], [], [], bytearray()
                return out

            for i, text in enumerate(batch.column(1)):
                seen: set[str] = set()
                for pos, line in enumerate(text.as_py().split("\n")):
                    key = line_key(line)
                    if len(key) < min_chars:
                        continue
                    digests += xxhash.xxh3_128_digest(key.encode())
                    row.append(i)
                    place.append(pos)
                    head.append(key not in seen)
                    seen.add(key)
                    if len(row) == 65536:
                        yield told()
            if row:
                yield told()

    return own.select("doc_id", "text", "t1", "t2").mapInArrow(run, f"h1 long, h2 long, doc_id {own.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, pos int, head boolean")


#: What a streamed row says: the line goes; it goes if the reports of its key say so; a report.
GOES, OPEN, REPORT = 0, 1, 2


def _told(rows: pa.RecordBatch, kind: int, heads: int | None = None) -> pa.RecordBatch:
    n = rows.num_rows
    head = pa.nulls(n, pa.int64()) if heads is None else pa.array([heads] * n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), rows.column(7), *rows.columns[:6], head], names=["kind", "part", "h1", "h2", "doc_id", "t1", "t2", "pos", "heads"])


def _differs(rows: pa.RecordBatch, columns: tuple[int, ...]) -> np.ndarray:
    """For each row but the first: whether it differs from the row before it."""
    out = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for c in columns:
        a, b = rows.column(c).slice(1), rows.column(c).slice(0, max(rows.num_rows - 1, 0))
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        out |= ~equal.to_numpy(zero_copy_only=False)
    return out


class _Common:
    """keep="none": a run's rows go once min_docs documents are counted; until then they are held (those of fewer documents)."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs

    def begin(self, at_start: bool) -> None:
        self.heads, self.held, self.edge = 0, [], at_start

    def feed(self, rows: pa.RecordBatch, heads: int) -> Iterator[pa.RecordBatch]:
        self.heads += heads
        self.held.append(rows)
        if self.heads >= self.min_docs:
            yield from (_told(r, GOES) for r in self.held)
            self.held = []

    def end(self, last: pa.RecordBatch, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.edge or at_end:
            yield from (_told(r, OPEN) for r in self.held)
            yield _told(last, REPORT, self.heads)

    def inner(self, rows: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return np.repeat(heads >= self.min_docs, sizes)


class _First:
    """keep="first": all rows of a run go but the first occurrence (as often as its row is repeated)."""

    def __init__(self, min_docs: int):
        pass

    def begin(self, at_start: bool) -> None:
        self.edge, self.before = at_start, None

    def feed(self, rows: pa.RecordBatch, heads: int) -> Iterator[pa.RecordBatch]:
        if self.before is None:
            self.place = rows.slice(0, 1)
            self.before = True
        whole = pa.Table.from_batches([self.place, rows]).combine_chunks().to_batches()[0]
        stays = np.cumsum(_differs(whole, (2, 3, 4, 5))) == 0
        if stays.any() and self.edge:
            yield _told(rows.filter(pa.array(stays)), OPEN)
        if not stays.all():
            yield _told(rows.filter(pa.array(~stays)), GOES)
            self.place = rows.slice(rows.num_rows - 1).set_column(5, "pos", pa.array([-1], pa.int32()))  # no row is at -1: none stays any more

    def end(self, last: pa.RecordBatch, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.edge or at_end:
            yield _told(last, REPORT, 0)

    def inner(self, rows: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        steps = np.cumsum(np.r_[True, _differs(rows, (0, 1, 2, 3, 4, 5))])
        return steps > np.repeat(steps[starts], sizes)


RULES = {"none": _Common, "first": _First}


def _stream(keep: str, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, key, last = RULES[keep](min_docs), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(np.r_[True, _differs(batch, (0, 1))])
            stops = np.r_[starts[1:], batch.num_rows]
            heads = np.add.reduceat(batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64), starts)
            here = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            if here != key:
                if key is not None:
                    yield from rule.end(last, False)
                rule.begin(key is None)
            yield from rule.feed(batch.slice(0, stops[0]), int(heads[0]))
            if len(starts) > 1:
                yield from rule.end(batch.slice(0, 1), False)
                inner = batch.slice(starts[1], starts[-1] - starts[1])
                if inner.num_rows:  # runs that begin and end within the batch are settled together
                    goes = rule.inner(inner, starts[1:-1] - starts[1], (stops - starts)[1:-1], heads[1:-1])
                    if goes.any():
                        yield _told(inner.filter(pa.array(goes)), GOES)
                rule.begin(False)
                yield from rule.feed(batch.slice(starts[-1]), int(heads[-1]))
            last = batch.slice(batch.num_rows - 1)
            key = (last.column(0)[0].as_py(), last.column(1)[0].as_py())
        if key is not None:
            yield from rule.end(last, True)

    return run


def dropped(rows: DataFrame, keep: str = "none", min_docs: int = 10) -> DataFrame:
    """(doc_id, t1, t2, pos) of the lines that go; ``rows`` as ``lines`` gives them."""
    order = ["h1", "h2", "doc_id", "t1", "t2", "pos"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    said = cut(ranged.mapInArrow(_stream(keep, min_docs), f"kind int, part int, h1 long, h2 long, doc_id {kind}, t1 long, t2 long, pos int, heads long"), "line-runs")
    reports = said.where(F.col("kind") == REPORT).groupBy("h1", "h2").agg(F.sum("heads").alias("all"), F.min("part").alias("least"))
    reports = reports.withColumnsRenamed({"h1": "r1", "h2": "r2"})
    left = said.where(F.col("kind") == OPEN).join(reports, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))  # both sides: about two runs a partition
    left = left.where(F.col("all") >= min_docs) if keep == "none" else left.where(F.col("part") > F.col("least"))
    place = ["doc_id", "t1", "t2", "pos"]
    return said.where(F.col("kind") == GOES).select(place).unionByName(left.select(place))


def keep_bits(gone: list[int]) -> bytes:
    """Bits up to the last line that goes, compressed."""
    bits = np.ones(-(-(max(gone) + 1) // 8) * 8, dtype=bool)
    bits[gone] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, t1, t2, n_dropped, keep), one row for each different document that loses a line.

    t1 and t2 are xxhash64 of the text (null as empty) with and without a leading 1: with the id they name the document.
    """
    ship(docs.sparkSession)
    own = _identity(docs, id_col, text_col)
    rows = cut(lines(own, min_chars), "lines")
    gone = dropped(rows, keep, min_docs).groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))  # bounded by the lines of one text
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [g.as_py() for g in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(g) for g in gone], pa.int64()), pa.array([keep_bits(g) for g in gone], pa.binary())], names=["doc_id", "t1", "t2", "n_dropped", "keep"])

    return gone.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, n_dropped long, keep binary")


def kept_text(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    every = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little").tolist()
    return "\n".join(line for i, line in enumerate(every) if i >= len(bits) or bits[i])


def apply(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of docs, the text without the lines that go (null: empty)."""
    own = _identity(docs, id_col, text_col)
    maps = maps.select(F.col("doc_id").alias("m_id"), F.col("t1").alias("m1"), F.col("t2").alias("m2"), "n_dropped", "keep")
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2"))
    met = own.join(maps.hint("shuffle_hash"), same, "left")  # bitmaps are the small side: texts aren't sorted
    met = met.select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([kept_text(t.as_py(), k.as_py()) for t, k in zip(batch.column(1), batch.column(4), strict=True)], batch.column(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(2), batch.column(3)], names=["doc_id", "text", "n_lines", "n_dropped"])

    return met.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs."""
    kept = apply(docs, bitmaps(docs, id_col, text_col, keep, min_docs, min_chars), id_col, text_col)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
