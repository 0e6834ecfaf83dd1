"""Quality rules with an n-gram perplexity band for each language.

Model: for each language a modified Kneser-Ney model of character 5-grams, counted by Spark over
every text (three discounts for each order, continuation counts below the highest order,
interpolated). Code points below 2048 are characters of their own, those above share 2048
classes; a run of digits is one. So the model grows with the languages and texts of the corpus.

* ``blocks`` has the distinct 5-grams of each block of about ``BLOCK`` characters and their counts,
  dealt to ``PARTS`` by the top bits of their hash; ``count_grams`` merges them.
* ``probabilities`` makes the model by grouping and joining n-grams; ``arrays`` keeps it as sorted
  hash arrays, one for each language and part.
* A model of at most ``SHARED`` 5-grams (counted first) is broadcast, and ``measured`` scores texts
  where they are read. A larger one stays in its parts: ``looked_up`` answers the 5-grams of every
  block, part by part (about ``GROUP`` blocks meet one copy of a part, so neither side of a
  task grows with the corpus), and the answers of a block are brought to its texts. Both give the same.

The texts scored are those counted, so each 5-gram asked for has been seen, all lower orders are
mixed into its probability, and there is no backing off. A text's perplexity is exp of the mean negative log probability
of its characters.

Bands: over the distinct texts that pass the base rules, each language has the median and the median
absolute deviation of log perplexity (copies count once, so they don't set the band); a text outside ``width`` deviations, above or below, is
rejected. As a mean over few characters scatters more, a text of n has its band widened by
sqrt(1 + SHORT / n). Both medians come from counts on a grid of ``GRID``, so they are exact there, need
little memory and don't depend on the order of tasks.

Defined cases: null and empty texts have no words and fail the base rules; a null language is
a language of its own, and so is an empty one; where a language has a single value of perplexity, the deviation is
``LEAST``; equal rows get equal verdicts; null ids are ids like others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postline.llm.common import cut, ship

ORDER = 5
BITS = 12
WIDTH = 5.0
SHORT = 500
GRID = 1e-4
COARSE = 100  # steps of the grid in a coarse one
LEAST = 0.01
PIECE = 1 << 20
BLOCK = 1 << 26
PARTS = 64
GROUP = 512
SHARED = 1 << 22  # a model of at most so many 5-grams (12 bytes each) is broadcast
OWN = 2048  # code points below have a class of their own


def grams(text: str) -> Iterator[np.ndarray]:
    """The packed 5-grams that end at each character, some 2^20 at a time; four line ends stand before the text."""
    before = np.full(ORDER - 1, ord("\n"), dtype=np.int64)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        c = np.where(c < OWN, c, OWN + c % OWN)
        digit = (c >= ord("0")) & (c <= ord("9"))
        c[digit] = ord("0")
        again = digit[1:] & digit[:-1]
        if again.any():  # a run of digits is one of them
            c = c[np.append(True, ~again)]
        c = np.append(before, c)
        before = c[-(ORDER - 1) :]
        packed = c[: len(c) - ORDER + 1]
        for k in range(1, ORDER):
            packed = (packed << BITS) + c[k : len(c) - ORDER + 1 + k]
        yield packed


def hashed(packed: np.ndarray) -> np.ndarray:
    """A 64-bit mix of packed n-grams; it is one to one."""
    with np.errstate(over="ignore"):
        x = packed.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def base_columns(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = Counter(raw.split(b"\n"))
    duplicates = sum(n - 1 for line, n in lines.items() if n > 1 and line.split())
    repeated = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts, reach = Counter(windows), 0
            for at, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += at + 3 - max(at, reach)
                    reach = at + 3
    return len(words), len(text) - spaces, symbols, duplicates, repeated


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


BASE_NAMES = [c.split()[0] for c in BASE.split(", ")]
_DOCS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])
_BLOCKS = pa.schema([("block", pa.string()), ("docs", pa.binary()), ("lang", pa.string()), ("part", pa.int32()), ("asked", pa.binary()), ("counts", pa.binary())])


def _squeeze(kinds: np.ndarray) -> bytes:
    """Sorted n-grams (or any longs) as differences, their bytes by place, compressed; the length stands before them."""
    steps = np.diff(kinds, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(kinds).to_bytes(8, "little") + pa.Codec("zstd").compress(steps, asbytes=True)


def _expand(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    steps = pa.Codec("zstd").decompress(raw[8:], 8 * n, asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(8, n).T).view(np.int64).ravel())


def _language(lang: str | None) -> str:
    """A name of the language that is never null."""
    return "" if lang is None else "=" + lang


class _Counts:
    """Counts of packed n-grams; what is added is merged as soon as it is as long as what is counted."""

    def __init__(self):
        self.grams, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, packed: np.ndarray) -> None:
        self.waiting.append(packed)
        self.size += len(packed)
        if self.size > max(PIECE, len(self.grams)):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        kinds, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.size = [], 0
        both, at = np.unique(np.concatenate([self.grams, kinds]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, n]), len(both)).astype(np.int64)
        self.grams = both


def _block_texts(name: str, docs: list[tuple]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(pa.table([list(x) for x in zip(*docs, strict=True)], schema=_DOCS))
    return pa.RecordBatch.from_pylist([{"block": name, "docs": sink.getvalue().to_pybytes()}], schema=_BLOCKS)


def _block_rows(docs: list[tuple], counts: dict[str, _Counts], texts: bool) -> Iterator[pa.RecordBatch]:
    name = uuid.uuid4().hex
    if texts:
        yield _block_texts(name, docs)
    for lang, own in counts.items():
        own.merge()
        part = (hashed(own.grams) >> np.uint64(58)).astype(np.int64) * PARTS // 64
        by = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[by], np.arange(PARTS + 1))
        kinds, n = own.grams[by], own.counts[by]
        there = [p for p in range(PARTS) if ends[p] < ends[p + 1]]
        cuts = [slice(ends[p], ends[p + 1]) for p in there]
        cols = [pa.array([name] * len(there), pa.string()), pa.nulls(len(there), pa.binary()), pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array([_squeeze(kinds[c]) for c in cuts], pa.binary()), pa.array([_squeeze(n[c]) for c in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, schema=_BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch], texts: bool, most: int) -> Iterator[pa.RecordBatch]:
    docs, size, counts = [], 0, defaultdict(_Counts)
    for batch in batches:
        for doc_id, lang, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            text = text.as_py() or ""
            lang = lang.as_py()
            if texts:
                docs.append((doc_id.as_py(), lang, text))
            size += len(text) + 64
            for packed in grams(text):
                counts[_language(lang)].add(packed)
            if size >= most:
                yield from _block_rows(docs, counts, texts)
                docs, size, counts = [], 0, defaultdict(_Counts)
    if size:
        yield from _block_rows(docs, counts, texts)


def blocks(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Rows (block, lang, part, asked, counts) of the distinct 5-grams of blocks of docs (doc_id, lang, text), compressed; with ``texts`` also a row with the texts of each block. Written."""
    most = BLOCK
    return cut(docs.mapInArrow(lambda batches: _blocks(batches, texts, most), "block string, docs binary, lang string, part int, asked binary, counts binary"), "blocks")


def _copy(held: DataFrame) -> tuple[Column, int]:
    """Which of so many copies of a part a block belongs to: about GROUP blocks to each."""
    copies = -(-max(1, held.select("block").distinct().count()) // GROUP)
    return F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"), copies


def _merge(table: pa.Table) -> pa.Table:
    kinds, n = np.empty(0, np.int64), np.empty(0, np.int64)
    rows = list(zip(table["asked"], table["counts"], strict=True))
    for at in range(0, len(rows), 32):
        some = [(kinds, n), *((_expand(a.as_py()), _expand(b.as_py())) for a, b in rows[at : at + 32])]
        both, where = np.unique(np.concatenate([a for a, _ in some]), return_inverse=True)
        n = np.bincount(where, np.concatenate([b for _, b in some]), len(both)).astype(np.int64)
        kinds = both
    return pa.table([pa.array([table["lang"][0].as_py()] * len(n), pa.string()), pa.array([table["part"][0].as_py()] * len(n), pa.int32()), kinds, n], names=["lang", "part", "gram", "n"])


def count_grams(held: DataFrame) -> DataFrame:
    """(lang, part, gram, n) over all blocks: those of a part and copy are merged compressed, then the copies are summed."""
    rows = held.where("docs is null").select("lang", "part", _copy(held)[0], "asked", "counts")
    merged = rows.groupBy("lang", "part", "copy").applyInArrow(_merge, "lang string, part int, gram long, n long")
    return cut(merged.groupBy("lang", "part", "gram").agg(F.sum("n").alias("n")), "grams")


def _step(n: Column) -> Column:
    return F.when(n >= 3, F.col("d3")).when(n >= 2, F.col("d2")).otherwise(F.col("d1"))


def discounts(level: DataFrame) -> DataFrame:
    """(_lang, d1, d2, d3) for counts 1, 2 and 3 or more, from how many n-grams of the language have counts 1 to 4."""
    few = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = F.least("n1", "n2", "n3") > 0
    own = [F.when(enough, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(plain).alias(f"d{k}") for k, plain in ((1, 0.5), (2, 0.75), (3, 0.9))]  # too regular to estimate: plain
    return cut(few.select(F.col("lang").alias("_lang"), *own), "discounts")


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, part, gram, p) of the 5-grams counted: interpolated modified Kneser-Ney."""
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # how many different characters stand before
        levels[order] = cut(levels[order + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    lower = None
    for order in range(1, ORDER + 1):
        level = levels[order]
        d = discounts(level)
        rows = level.join(d, F.col("lang") == F.col("_lang")).withColumns({"step": _step(F.col("n")), "context": F.shiftright("gram", BITS)}).drop("_lang", "d1", "d2", "d3")
        total = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("step").alias("lost"))
        rows = rows.join(total, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / (1 << BITS)))
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(below, ["lang", "suffix"])
        p = (F.col("n") - F.col("step") + F.col("lost") * F.col("below")) / F.col("total")
        lower = cut(rows.select("lang", *(["part"] if order == ORDER else []), "gram", p.alias("p")), "probabilities")
    return lower


def _array(table: pa.Table) -> pa.Table:
    keys = hashed(table["gram"].to_numpy())
    by = np.argsort(keys)
    whole = pa.array([0, len(by)], pa.int32())
    return pa.table([table["lang"][:1], table["part"][:1], pa.ListArray.from_arrays(whole, pa.array(keys[by].view(np.int64))), pa.ListArray.from_arrays(whole, pa.array(np.log(table["p"].to_numpy()[by])))], names=["lang", "part", "keys", "log_p"])


def arrays(model: DataFrame) -> DataFrame:
    """(lang, part, keys, log_p): for each language and part the sorted hashes of its 5-grams, and their log probabilities."""
    return cut(model.groupBy("lang", "part").applyInArrow(_array, "lang string, part int, keys array<long>, log_p array<double>"), "arrays")


class Lookup:
    """The values of packed n-grams, all of which are in the sorted hash array ``keys``.

    Hashes are spread evenly over their range, so their top bits tell the place but for a few steps; a binary
    search would read some twenty places of a large array for each n-gram.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(max(0, int(keys[-1] - keys[0]).bit_length() - len(keys).bit_length()))
        slots = (keys - keys[0]) >> self.shift
        self.first = np.searchsorted(slots, np.arange(int(slots[-1]) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, packed: np.ndarray) -> np.ndarray:
        asked = hashed(packed)
        at = self.first[(asked - self.keys[0]) >> self.shift]
        left = np.flatnonzero(self.keys[at] != asked)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != asked[left]]
        return self.values[at]


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    keys, values = model["keys"][0].values.to_numpy().view(np.uint64), model["log_p"][0].values.to_numpy()
    find = Lookup(keys, values)
    found = [find(_expand(g.as_py())).astype(np.float32).tobytes() for g in asked["asked"]]
    return pa.table([asked["block"], asked["lang"], asked["asked"], pa.array(found, pa.binary())], names=["block", "lang", "asked", "log_p"])


def looked_up(held: DataFrame, model: DataFrame) -> DataFrame:
    """(block, lang, asked, log_p): every block's 5-grams, compressed, and the bytes of their log probabilities."""
    copy, copies = _copy(held)
    asked = held.where("docs is null").select("block", "lang", "part", "asked", copy)
    model = model.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    by = ["lang", "part", "copy"]
    model = model.join(asked.select(*by).distinct(), by, "left_semi")
    return asked.groupBy(*by).cogroup(model.groupBy(*by)).applyInArrow(_answer, "block string, lang string, asked binary, log_p binary")


def _measure(texts: pa.Table, answers: pa.Table) -> pa.Table:
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    parts = defaultdict(list)
    for lang, kinds, found in zip(*(answers[c].to_pylist() for c in ("lang", "asked", "log_p")), strict=True):
        parts[lang].append((_expand(kinds), np.frombuffer(found, np.float32)))
    for lang, own in parts.items():
        kinds, found = (np.concatenate(x) for x in zip(*own, strict=True))
        by = np.argsort(kinds)
        known[lang] = kinds[by], found[by]
    docs = (batch for held in texts["docs"] for batch in pa.ipc.open_stream(held.as_py()).read_all().to_batches())
    return pa.Table.from_batches(_score(docs, lambda lang, packed: (found := known[lang])[1][np.searchsorted(found[0], packed)]), schema=_MEASURED)


_MEASURED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in BASE_NAMES], ("loss", pa.float64()), ("n_chars", pa.int64()), ("content", pa.binary())])


def _score(batches: Iterator[pa.RecordBatch], log_p: Callable[[str, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, lang, text in zip(*batch.columns, strict=True):
            lang, text = lang.as_py(), text.as_py() or ""
            loss, n = 0.0, 0
            for packed in grams(text):
                loss, n = loss - float(log_p(_language(lang), packed).sum(dtype=np.float64)), n + len(packed)
            rows.append((doc_id.as_py(), lang, *base_columns(text), loss / n if n else None, n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEASURED, strict=True)], schema=_MEASURED)


def _whole(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """lang -> sorted hashes and log probabilities of a model of at most ``SHARED`` 5-grams; parts are ranges of the hash."""
    out = defaultdict(list)
    for batch in model.toArrow().sort_by([("lang", "ascending"), ("part", "ascending")]).to_batches():
        for lang, keys, log_p in zip(*(batch[c] for c in ("lang", "keys", "log_p")), strict=True):
            out[lang.as_py()].append((keys.values.to_numpy().view(np.uint64), log_p.values.to_numpy().astype(np.float32)))
    return {lang: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for lang, parts in out.items()}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base columns, the mean log loss (null without characters), the characters and the text's SHA-256 of each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    model = arrays(probabilities(count_grams(blocks(docs, texts=False))))
    schema = f"doc_id long, lang string, {BASE}, loss double, n_chars long, content binary"
    if model.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first().n <= SHARED:
        shared = spark.sparkContext.broadcast(_whole(model))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, Lookup] = {}
            return _score(batches, lambda lang, packed: (found.get(lang) or found.setdefault(lang, Lookup(*shared.value[lang])))(packed))

        return docs.mapInArrow(score, schema)
    held = blocks(docs)
    texts = held.where("docs is not null").select("block", "docs")
    return texts.groupBy("block").cogroup(looked_up(held, model).groupBy("block")).applyInArrow(_measure, schema)


def _median(bins: DataFrame, value: str) -> DataFrame:
    """(lang, middle) of bins (lang, value, n): the smallest value that half of the rows don't exceed.

    Counts on a coarse grid give the step that holds the middle, so no task sees all values of a language.
    """
    steps = bins.groupBy("lang", F.floor(F.col(value) / COARSE).alias("_step")).agg(F.sum("n").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("lang").orderBy("_step"))
    steps = steps.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(W.partitionBy("lang")))
    steps = steps.where((F.col("_upto") * 2 >= F.col("_all")) & ((F.col("_upto") - F.col("_n")) * 2 < F.col("_all")))
    steps = steps.select(F.col("lang").alias("_lang"), F.col("_step").alias("_held"), (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    inside = bins.join(steps, bins.lang.eqNullSafe(F.col("_lang")) & (F.floor(F.col(value) / COARSE) == F.col("_held")))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy(value)) + F.col("_before")
    return inside.withColumn("_at", upto).where(F.col("_at") * 2 >= F.col("_all")).groupBy("lang").agg(F.min(value).alias("middle"))


def bands(losses: DataFrame, width: float = WIDTH) -> DataFrame:
    """(lang, lower, upper) of log perplexity from (lang, loss)."""
    bins = cut(losses.where("loss is not null").groupBy("lang", F.round(F.col("loss") / GRID).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n")), "losses")
    middle = _median(bins, "at").select(F.col("lang").alias("_l"), "middle")
    off = bins.join(middle, bins.lang.eqNullSafe(F.col("_l"))).groupBy("lang", "middle", F.abs(F.col("at") - F.col("middle")).alias("off")).agg(F.sum("n").alias("n"))
    spread = _median(off, "off").select(F.col("lang").alias("_o"), F.col("middle").alias("mad"))
    both = middle.join(spread, F.col("_l").eqNullSafe(F.col("_o")))
    reach = width * F.greatest(F.lit(LEAST), 1.4826 * F.col("mad") * GRID)
    return both.select(F.col("_l").alias("lang"), (F.col("middle") * GRID - reach).alias("lower"), (F.col("middle") * GRID + reach).alias("upper"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, perplexity, lower, upper for every row of docs."""
    rows = cut(measured(docs, id_col, text_col, lang_col), "measured")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    distinct = rows.where("not base_failed").groupBy("lang", "content").agg(F.min("loss").alias("loss"))
    limits = cut(bands(distinct.select("lang", "loss"), width).withColumnRenamed("lang", "_lang"), "bands")
    rows = rows.join(limits, rows.lang.eqNullSafe(F.col("_lang")), "left")
    middle, reach = (F.col("lower") + F.col("upper")) / 2, (F.col("upper") - F.col("lower")) / 2 * F.sqrt(1 + SHORT / F.greatest(F.col("n_chars"), F.lit(1)))
    rows = rows.withColumns({"lower": middle - reach, "upper": middle + reach})
    within = F.coalesce((F.col("loss") >= F.col("lower")) & (F.col("loss") <= F.col("upper")), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"), F.exp("loss").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"))
