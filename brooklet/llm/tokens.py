"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; a Viterbi pass keeps, per position, the best score and the number of
pieces on that path. Rules of the unigram tokenizer that are kept exactly:

* scores add up in double precision from the left;
* a later candidate replaces an earlier one only if its score is strictly
  higher, and candidates for an end come by start from left to right;
* a character that is no piece by itself may be unknown, at the lowest score of
  the vocabulary less 10; with byte fallback it counts as its UTF-8 bytes.

No public file here is a unigram model, so `zipf_vocab` scores the pieces of a
public SentencePiece vocabulary by their rank (a fixed rule; nothing is trained).

A text is cut at ASCII white space; each word gets the usual word-start mark.
Null and empty texts have no words and no tokens; repeated rows repeat; a word of
any length is scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import WORD_RE, kept_by_worker, text_or_empty

MARK = "▁"
#: Fixed value of the unigram tokenizer: what an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000
CACHED_LENGTH = 40


def zipf_vocab(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a SentencePiece file, score -log(rank + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    return [(p, -math.log(rank + 2.0)) for rank, p in enumerate(pieces)]


class UnigramCounter:
    """Counts pieces of one word at a time; `count` caches short words, within a bound."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def best(self, marked: str) -> tuple[float, int]:
        """(score, pieces) of the best path over a marked word."""
        n = len(marked)
        score: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(marked):
            found[end].append(match)
        for end in range(1, n + 1):
            matches = sorted(found[end - 1], reverse=True)  # the longest starts first
            top, pieces = -math.inf, 0
            single = False
            for length, s in matches:
                single |= length == 1
                if (candidate := s + score[end - length]) > top:
                    top, pieces = candidate, count[end - length] + 1
            if not single and (candidate := self.unknown + score[end - 1]) > top:
                top, pieces = candidate, count[end - 1] + len(marked[end - 1].encode("utf-8", "replace"))
            score[end], count[end] = top, pieces
        return score[n], count[n]

    def count(self, word: str) -> int:
        if (known := self.cache.get(word)) is not None:
            return known
        n = self.best(MARK + word)[1]
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = n
        return n


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_words, n_tokens for every row, in one pass without a shuffle."""
    vocab = zipf_vocab(model_path)
    id_type = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept_by_worker(f"pieces {model_path}")
        if not held:
            held["counter"] = UnigramCounter(vocab)
        counter = held["counter"]
        for batch in batches:
            chars, words, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                own = WORD_RE.findall(text)
                chars.append(len(text))
                words.append(len(own))
                tokens.append(sum(map(counter.count, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (chars, words, tokens))], ["doc_id", "n_chars", "n_words", "n_tokens"])

    return narrow.mapInArrow(run, f"doc_id {id_type.simpleString()}, n_chars long, n_words long, n_tokens long")
