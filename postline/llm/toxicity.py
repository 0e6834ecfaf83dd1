"""Toxicity by noisy-channel deobfuscation: restore each text, then score the restored words.

Channel. A written token may come from a word by leetspeak (a digit or symbol for a
letter), by spacing or separators between single letters, or by repeated letters. Each
token that shows such marks spans a character lattice: a symbol may stand for its letters or
for nothing, a repeated letter may be dropped, a separator may be dropped or end a word. Viterbi decoding
finds the path with the best sum of channel costs and character language model scores
(order 4, counted by Spark over every document). A token without marks has one path, itself.

Scores. A logistic regression over whole words and word beginnings of the restored text,
fitted on at most ``sample_rows`` labelled rows (the bound is a parameter; rows are taken by
a hash of their id). A token of any length is decoded twice, as one word and with word ends at
its symbols, and the reading with most features counts. Only the marked tokens of which some path
may have a word that begins like some feature (letters folded over what leet symbols may mean, repetitions
collapsed, symbols there or left out) are decoded; no other token could restore to a feature.

Defined cases: null and empty texts score like a text without any feature; null labels and
labels of unknown documents are not learned from; without labels of both kinds every
score is the share of toxic labels (0 without labels); a doc_id with several labels is toxic
if any says so; equal rows score equally; a null doc_id is held out (it has no remainder);
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm.common import cut, ship

SAMPLE_ROWS = 20_000
N_FEATURES = 512
MIN_ROWS = 3
MEMO = 400_000

#: What a symbol may stand for. Fixed values of the channel.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "¡": "i", "€": "e", "£": "l"}
SEPARATORS = " \t.-_*,'`~·/"
COST_LEET, COST_DROP, COST_REPEAT, COST_SPACE = 1.0, 2.5, 0.7, 0.2
#: Letters that the skeleton does not tell apart, as some symbol may mean either.
_SAME = {"l": "i"}
_ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
SYMBOLS = 28  # a-z, any other letter, the edge of a word
_OTHER, _EDGE = 26, 27


def _alphabet() -> np.ndarray:
    """Code point -> symbol of the character model."""
    table = np.full(0x110000, _EDGE, dtype=np.uint8)
    for c in range(0x250):
        if chr(c).isalpha():
            low = chr(c).lower().translate(_ACCENTS)[0]
            table[c] = ord(low) - 97 if "a" <= low <= "z" else _OTHER
    for c in range(0x250, 0x3000):
        if chr(c).isalpha():
            table[c] = _OTHER
    return table


_TABLE: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _alphabet()
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**4, dtype=np.int64)
    seen = False
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if not text:
                continue
            for at in range(0, len(text), 1 << 20):  # pieces overlap by three characters
                c = _codes(("   " if at == 0 else text[at - 3 : at]) + text[at : at + (1 << 20)]).astype(np.int32)
                gram = ((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:]
                if len(gram) > 100_000:
                    total += np.bincount(gram, minlength=len(total))
                else:
                    np.add.at(total, gram, 1)
                seen = True
    if seen:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(symbol | three symbols before), interpolated over orders 1 to 4.

    Counted over every row. What reaches the driver is bounded by the alphabet: 28^4 counts.
    """
    ship(docs.sparkSession)
    counted = docs.select(F.col(text_col)).mapInArrow(_count_characters, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**4)
    table = counted.toArrow()
    n[table["gram"].to_numpy()] = table["n"].to_numpy()
    n = n.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        c = n.sum(axis=tuple(range(4 - order))) if order < 4 else n
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        p = (c + kinds * p + 1e-3 * p) / (c.sum(axis=-1, keepdims=True) + kinds + 1e-3)  # Witten-Bell
    return np.log(p).astype(np.float32)


def skeleton(token: str) -> str:
    """Letters folded over leet meanings and accents; separators and repetitions are left out."""
    out = []
    for c in token.lower().translate(_ACCENTS):
        c = LEET[c][0] if c in LEET else c
        c = _SAME.get(c, c)
        if c.isalpha() and (not out or out[-1] != c):
            out.append(c)
    return "".join(out)


def _ways(c: str, last: str) -> list[tuple[str, float]]:
    if c in LEET:
        return [(x, COST_LEET) for x in LEET[c]] + [("", COST_DROP)] + ([("", COST_REPEAT)] if c == last else [])
    if c.isalpha():
        return [(c, 0.0)] + ([("", COST_REPEAT)] if c == last else [])
    return [("", COST_SPACE if c in SEPARATORS else COST_DROP)]


def _best_path(token: str, model: np.ndarray, split: bool) -> str:
    """The best path through the lattice of a token; with ``split``, a symbol may end a word, which gives a space.

    Steps are given out as soon as all paths share them, so a token of any length needs little memory.
    """
    start = (_EDGE, _EDGE, _EDGE)
    best: dict[tuple[int, int, int], float] = {start: 0.0}
    steps: list[dict] = []  # state -> (state before, what is written)
    out: list[str] = []
    last = ""

    def trace(upto: int, state: tuple[int, int, int]) -> None:
        path = []
        for step in reversed(steps[:upto]):
            state, written = step[state]
            path.append(written)
        out.extend(reversed(path))
        del steps[:upto]

    for c in token.lower().translate(_ACCENTS):
        ways = [(x, cost, int(_codes(x)[0]) if x else -1) for x, cost in _ways(c, last)]
        if split and not c.isalnum():
            ways.append((" ", 0.0, _EDGE))
        last = c
        after, back = {}, {}
        for state, score in best.items():
            for written, cost, s in ways:
                if written == " ":
                    at, value = start, score + (float(model[state][s]) if state != start else 0.0)
                elif written:
                    at, value = (state[1], state[2], s), score + float(model[state][s]) - cost
                else:
                    at, value = state, score - cost
                if at not in after or value > after[at]:
                    after[at], back[at] = value, (state, written)
        best = after
        steps.append(back)
        if len(best) == 1 or len(steps) % 1024 == 0:
            heads, upto = set(best), len(steps)
            while len(heads) > 1 and upto:
                upto -= 1
                heads = {steps[upto][s][0] for s in heads}
            if len(heads) == 1:
                trace(upto, heads.pop())
    end = max(best, key=lambda s: best[s] + (0.0 if split and s == start else float(model[s][_EDGE])))
    trace(len(steps), end)
    return "".join(out)


def decode(token: str, model: np.ndarray) -> str:
    """The best path that makes one word of a token, letters only."""
    return _best_path(token, model, False)


def restore(token: str, model: np.ndarray) -> list[str]:
    """The words of the best path on which each symbol may be a word's end."""
    return _best_path(token, model, True).split()


_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_REPEATED = re.compile(r"(.)\1\1|(.)\2(?=.*(.)\3\3)")
LONGEST = 64  # longer tokens are decoded as well, but not remembered


@dataclass
class Reader:
    """From texts to features; ``names`` maps a feature (a word, or ^ and the beginning of words) to its number."""

    model: np.ndarray
    names: dict[str, int] | None = None
    memo: dict[str, tuple[int, ...] | tuple[str, ...]] = field(default_factory=dict)
    starts: set[str] = field(default_factory=set)
    begins: set[str] | None = None

    def __post_init__(self):
        if self.names is not None:
            self.starts = {skeleton(n.lstrip("^"))[:3] for n in self.names}

    def may_restore(self, low: str) -> bool:
        """Whether some path of a lower-case token has a word that begins like a feature: each leet symbol may be
        its letter or nothing, and a word may begin first or after any symbol."""
        if "" in self.starts:
            return True
        if self.begins is None:
            self.begins = {s[:k] for s in self.starts for k in range(len(s))}
        states = {""}
        for c in low.translate(_ACCENTS):
            x = LEET[c][0] if c in LEET else c
            x = _SAME.get(x, x)
            if x.isalpha():
                after = {s if s[-1:] == x else s + x for s in states}
                if not after.isdisjoint(self.starts):
                    return True
                after &= self.begins
                states = after | states if c in LEET else after
            if not c.isalnum():
                states = states | {""}
        return False

    def evidence(self, words: list[str]) -> tuple[int, int]:
        """How many words are features, and how many features they have."""
        return sum(w in self.names for w in words), sum(f in self.names for w in words for f in self.features(w))

    def words(self, token: str) -> list[str]:
        """The restored words of one token: of its readings the one with most features, as it stands where none has more."""
        low = token.lower()
        core = _CORE.sub("", low)
        if core.isalpha() and not re.search(r"(.)\1\1", core):
            if core == low or not any(c in LEET for c in low):
                return [core]
            plain = [core]  # symbols at its edges may be letters as well
        else:
            plain = [w for w in re.split(r"[\W\d_]+", core) if w]
        if not any(c.isalpha() for c in low):
            return plain
        if self.names is not None and not self.may_restore(low):
            return plain
        written = sorted({core, low})
        readings = [[w] for w in sorted({decode(t, self.model) for t in written} - {""})]
        if re.search(r"[\W_]", core):
            readings += [restore(t, self.model) for t in written]
        if self.names is None:
            return sorted({*plain, *(w for r in readings for w in r)})
        return max([plain, *readings], key=self.evidence)

    @staticmethod
    def features(word: str) -> list[str]:
        return [word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]

    def tokens(self, text: str) -> Iterator[str]:
        """White-space tokens; three or more single characters in a row are one token, spaces between."""
        run: list[str] = []
        for token in text.split():
            if len(token) == 1:
                run.append(token)
                continue
            if run:
                yield from [" ".join(run)] if len(run) >= 3 else run
                run = []
            yield token
        if run:
            yield from [" ".join(run)] if len(run) >= 3 else run

    def numbers(self, text: str) -> list[int]:
        """The numbers of the features in a text, repeats included."""
        assert self.names is not None
        memo, out, singles = self.memo, [], False
        tokens = text.split()
        for token in tokens:
            got = memo.get(token)
            if got is None:
                got = self._look(token)
            if got:
                out += got
            if len(token) == 1:
                singles = True
        if singles:
            for token in self.tokens(text):
                if len(token) > 1 and token[1] == " ":
                    out += self._look(token)
        return out

    def _look(self, token: str) -> tuple[int, ...]:
        names = self.names
        found = tuple(names[f] for w in self.words(token) for f in self.features(w) if f in names)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(token) <= LONGEST:
            self.memo[token] = found
        return found


def _sample_features(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(model), {}

        def look(token: str) -> tuple[str, ...]:
            if (got := known.get(token)) is None:
                got = tuple({f for w in reader.words(token) for f in reader.features(w)})
                if len(known) >= MEMO:
                    known.clear()
                if len(token) <= LONGEST:
                    known[token] = got
            return got

        for batch in batches:
            pos, every = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for t in reader.tokens(text or "") for f in look(t)}
                every.update(found)
                if toxic:
                    pos.update(found)
            names = list(every)  # what can't be chosen is known only from the sums over all batches
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[n] for n in names], pa.int64()), pa.array([every[n] for n in names], pa.int64())], names=["name", "pos", "n"])

    return run


@dataclass
class Scorer:
    model: np.ndarray
    names: dict[str, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            if text and (found := reader.numbers(text)):
                for f, n in Counter(found).items():
                    out[i] += self.weights[f] * np.log1p(n)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _fit(x: list[tuple[list[int], list[int]]], y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression on log counts, L2 with a free bias, by Newton steps with conjugate gradients' dense solve."""
    m = np.zeros((len(x), n + 1), dtype=np.float64)
    m[:, n] = 1
    for i, (features, counts) in enumerate(x):
        m[i, features] = np.log1p(counts)
    w, ridge = np.zeros(n + 1), np.append(np.full(n, 0.3), 1e-6)
    w[n] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((m * s[:, None]).T @ m + np.diag(ridge), m.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES) -> Scorer:
    """The scorer of ``docs`` learned from labels (doc_id, toxic) whose rows aren't held out."""
    spark = docs.sparkSession
    model = character_model(docs, text_col)
    told = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("toxic")).where(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id")))
    told = told.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    ids = told.collect()  # bounded by sample_rows
    if not ids:
        return Scorer(model, {}, np.zeros(0), -40.0)
    told = spark.createDataFrame(ids, told.schema)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(told), F.col("_doc") == F.col("_id"))
    # an id that several rows have is learned from one of them, so that there are at most sample_rows
    rows = rows.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max(F.col("toxic") > 0).alias("toxic"))
    rows = cut(rows.select("text", "toxic"), "labelled")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("p")).first()
    if not 0 < stats.p < stats.n:
        return Scorer(model, {}, np.zeros(0), -40.0 if not stats.p else 40.0)
    n, p = float(stats.n), float(stats.p)
    counted = rows.mapInArrow(_sample_features(model), "name string, pos long, n long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # G2 of a feature that toxic rows have more often than the others
    a, b = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    lift = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = F.col("n") / n
    g2 = lift(a, share * p) + lift(b, share * (n - p)) + lift(p - a, (1 - share) * p) + lift((n - p) - b, (1 - share) * (n - p))
    best = counted.where((F.col("pos") >= MIN_ROWS) & (a / p > 2 * b / (n - p))).withColumn("g2", g2).where("g2 > 8").orderBy(F.desc("g2"), "name").limit(n_features)
    names = {r.name: i for i, r in enumerate(best.collect())}
    if not names:
        return Scorer(model, {}, np.zeros(0), float(np.log(p / (n - p))))
    shared = spark.sparkContext.broadcast((model, names))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            found = [sorted(Counter(reader.numbers(t or "")).items()) for t in batch.column(0).to_pylist()]
            parts = [pa.array([[p[i] for p in pairs] for pairs in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*parts, batch.column(1)], names=["x", "k", "y"])

    # sorted, so that the sums of the fit don't depend on the order in which tasks end
    # at most sample_rows rows of at most n_features pairs
    got = sorted((r.x, r.k, r.y) for r in rows.mapInArrow(vectors, "x array<int>, k array<int>, y boolean").collect())
    weights, bias = _fit([(x, k) for x, k, _ in got], np.array([float(y) for *_, y in got]), len(names))
    return Scorer(model, names, weights, bias)


def with_score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score column; nothing is shuffled."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        reader = Reader(own.model, own.names)
        for texts in parts:
            yield pa.array(own.scores(texts.to_pylist(), reader))

    return docs.withColumn(out, score(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scorer = train(docs, labels, id_col, text_col)
    scored = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scorer)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
