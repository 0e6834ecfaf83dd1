"""Token counts by unigram segmentation, with forward scores shared along a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. Its tokens are the best
segmentation under a unigram model: the largest sum of piece scores, of equal sums the one
with fewer tokens. The best score of a prefix doesn't depend on what follows, so distinct pre-tokens
are inserted in a trie whose nodes hold that score and its token count: a node is computed
once, whatever number of words begin with it. The counts at the ends of words are kept by
word. Each worker has a trie of its own and begins a new one at ``NODES`` nodes, so memory
is bounded, results are not affected, and nothing is shuffled.

Scores: the vocabulary file ranks its pieces; a piece of rank r has log probability
-log(r + 2) up to a constant (Zipf's law). A character without a piece falls back to its bytes.

Defined cases: null and empty texts have no pre-tokens; a word of over ``LONG`` characters is
scored outside the trie, in pieces of memory proportional to it; equal rows count alike; null
ids are ids like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline.llm.common import ship

NODES = 700_000
WORDS = 700_000
LONG = 200
MARK = "▁"


def read_pieces(path: str) -> dict[str, float]:
    """Piece -> log probability, from a sentencepiece model file; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    told = SentencePieceProcessor(model_file=path)
    ranked = [i for i in range(told.get_piece_size()) if not (told.is_control(i) or told.is_unknown(i) or told.is_byte(i) or told.is_unused(i))]
    ranked.sort(key=lambda i: (-told.get_score(i), i))
    total = math.log(sum(1 / (r + 2) for r in range(len(ranked) + 256)))
    return {told.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(ranked)}


class Unigram:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.byte = min(pieces.values(), default=0.0) - 1.0  # a byte is rarer than any piece
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = array("d", [0.0]), array("q", [0])
        self.known: dict[bytes, int] = {}

    def _forward(self, word: str, i: int, score, tokens) -> tuple[float, int]:
        """Best (score, tokens) of word[: i + 1], given those of the shorter prefixes (by length)."""
        n = len(word[i].encode("utf-8", "surrogatepass"))
        best, count = score(i) + n * self.byte, tokens(i) + n
        if word[i] in self.pieces:
            best, count = -math.inf, 0
        for j in range(i, -1, -1):
            end = word[j : i + 1]
            if end not in self.ends:
                break
            p = self.pieces.get(end)
            if p is not None:
                s, t = score(j) + p, tokens(j) + 1
                if s > best or s == best and t < count:
                    best, count = s, t
        return best, count

    def count(self, raw: bytes) -> int:
        """How many tokens the pre-token of a word has."""
        got = self.known.get(raw)
        if got is not None:
            return got
        word = MARK + raw.decode("utf-8", "replace")
        if len(word) > LONG:
            scores, counts = array("d", [0.0]), array("q", [0])
            for i in range(len(word)):
                s, t = self._forward(word, i, scores.__getitem__, counts.__getitem__)
                scores.append(s)
                counts.append(t)
            return counts[-1]
        if len(self.score) > NODES or len(self.known) > WORDS:
            self.clear()
        path, node, child = [0], 0, self.child
        for i, c in enumerate(word):
            after = child.get((node, c))
            if after is None:
                s, t = self._forward(word, i, lambda j: self.score[path[j]], lambda j: self.tokens[path[j]])
                after = child[node, c] = len(self.score)
                self.score.append(s)
                self.tokens.append(t)
            node = after
            path.append(node)
        self.known[raw] = self.tokens[node]
        return self.tokens[node]


@lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    """One for each worker process; its trie serves all tasks that run there."""
    return Unigram(read_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                tokens.append(sum(map(own.count, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["d", "w", "t"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
