"""Token counts under a unigram model, with work shared between words that begin alike.

Distinct pre-tokens of a batch are walked as a trie (in sorted order, so the
current branch is all that is held): the best score of every prefix and the
number of pieces on its best path are worked out once per trie node, and a
pre-token's count is read at its end node.  Pre-tokens are the words between
white space with a word mark in front.

A null text counts as empty: no words, no tokens.  Equal rows give equal counts.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import slices
from .merges import Recent

CACHE_ENTRIES = 400_000
CACHED_CHARS = 64
WORD_MARK = "▁"


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces listed from the most to the least frequent, by Zipf's law."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class UnigramCounter:
    """Best path: the highest score, then the fewest pieces.  A character no piece has costs one piece per UTF-8 byte."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte_score = min(scores.values(), default=0.0) - 1.0
        self.lengths = sorted({len(p) for p in scores})
        self.counts = Recent(CACHE_ENTRIES, CACHED_CHARS)

    def count_words(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token (word mark included)."""
        out, scores, lengths = [0] * len(words), self.scores, self.lengths
        best, pieces, branch = [0.0], [0], ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            shared = 0
            limit = min(len(word), len(branch))
            while shared < limit and word[shared] == branch[shared]:
                shared += 1
            del best[shared + 1:], pieces[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, least = -math.inf, 0
                for n in lengths:
                    if n > end:
                        break
                    s = scores.get(word[end - n:end])
                    if s is not None:
                        s += best[end - n]
                        if s > top or s == top and pieces[end - n] + 1 < least:
                            top, least = s, pieces[end - n] + 1
                if word[end - 1] not in scores:
                    b = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    s = best[end - 1] + b * self.byte_score
                    if s > top or s == top and pieces[end - 1] + b < least:
                        top, least = s, pieces[end - 1] + b
                best.append(top), pieces.append(least)
            out[k], branch = pieces[len(word)], word
        return out

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        split = [t.split() for t in texts]
        known = self.counts.of({w for ws in split for w in ws}, lambda fresh: self.count_words([WORD_MARK + w for w in fresh]))
        return [len(ws) for ws in split], [sum(map(known.__getitem__, ws)) for ws in split]


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> UnigramCounter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter(zipf_scores([model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens of every row, by the pieces of a model file.  Narrow; other columns are dropped."""
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches):
        counter = piece_counter(model)
        for whole in batches:
            for part in slices(whole, text):
                words, tokens = counter.count([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
