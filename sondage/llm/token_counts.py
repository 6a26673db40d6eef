"""Token counts of texts by a unigram model whose forward scores are shared along a trie of pre-tokens.

A text's pre-tokens are its words (runs other than space and 0x09-0x0D), each with the word mark in front. The best
segmentation of a pre-token into pieces of the vocabulary has the greatest sum of log probabilities, and of equals
the fewest pieces. Distinct pre-tokens are inserted in a trie with a node for each character; a node holds the best score and
piece count of the prefix that it ends, computed once from its ancestors and shared by all pre-tokens that go on
from there. The counts of complete pre-tokens are stored by word. Each task has its own trie, which is emptied
beyond ``MOST_NODES`` nodes: what it holds is recomputed, never dropped. Documents aren't shuffled.

Piece probabilities follow Zipf's law by rank in the vocabulary file. A character that is no piece costs one token for each
byte.

Defined cases: null and blank texts have no tokens; a pre-token longer than ``LONGEST`` is scored without nodes of its own, by the same
recursion; repeated rows are each counted; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import small_batches

MODEL = "piece_bpe_32k.model"
WORD_MARK = "▁"
MOST_NODES = 600_000
LONGEST = 200


class Unigram:
    """Log probabilities of pieces, and the token counts of pre-tokens."""

    def __init__(self, pieces: list[str]) -> None:
        norm = math.log(math.fsum(1 / r for r in range(1, len(pieces) + 1)))
        self.score: dict[str, float] = {}
        for r, piece in enumerate(pieces, 1):
            self.score.setdefault(piece, -math.log(r) - norm)
        # All ends of pieces, those that are no piece with null: from a character back, the first string that is none ends the search.
        self.ends: dict[str, float | None] = dict.fromkeys(piece[i:] for piece in self.score for i in range(1, len(piece)))
        self.ends |= self.score
        self.byte = -math.log(2 * len(pieces) + 2) - norm
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[str, int] = {}

    def _next(self, text: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, pieces) of ``text[:end]`` from those of its prefixes; ``path[i]`` belongs to ``text[:i]``."""
        size = 1 if text[end - 1] < "\x80" else len(text[end - 1].encode("utf-8", "surrogatepass"))
        score, count = path[end - 1]
        top, fewest = score + size * self.byte, count + size
        ends = self.ends
        for start in range(end - 1, -1, -1):
            part = text[start:end]
            if part not in ends:
                break
            own = ends[part]
            if own is not None:
                score, count = path[start]
                score += own
                if score > top or (score == top and count + 1 < fewest):
                    top, fewest = score, count + 1
        return top, fewest

    def add(self, token: str) -> int:
        """The token count of a pre-token, which is inserted in the trie."""
        path = [(0.0, 0)]
        if len(token) > LONGEST:
            for end in range(1, len(token) + 1):
                path.append(self._next(token, end, path))
            return path[-1][1]
        if len(self.best) > MOST_NODES:
            self.clear()
        node, child, best, at = 0, self.child, self.best, 0
        for letter in token:
            key = node << 21 | ord(letter)
            if key not in child:
                break
            node = child[key]
            path.append(best[node])
            at += 1
        # What follows a new node is new.
        for end in range(at + 1, len(token) + 1):
            child[node << 21 | ord(token[end - 1])] = node = len(best)
            best.append(self._next(token, end, path))
            path.append(best[node])
        self.terminal[token[len(WORD_MARK) :]] = path[-1][1]
        return path[-1][1]

    def count(self, words: list[str]) -> int:
        found = list(map(self.terminal.get, words))
        if None in found:
            # A word that occurs again has been added by then, unless the trie was emptied since.
            get = self.terminal.get
            for i, known in enumerate(found):
                if known is None and (known := get(words[i])) is None:
                    known = self.add(WORD_MARK + words[i])
                    get = self.terminal.get
                found[i] = known
        return sum(found)


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Unigram([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path or public_tokenizers.path(MODEL))
        for batch in batches:
            pre, tokens = [], []
            for x in batch.column("text"):
                words = [w.decode("utf-8", "replace") for w in x.as_buffer().to_pybytes().split()] if x.is_valid else []
                pre.append(len(words))
                tokens.append(model.count(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
