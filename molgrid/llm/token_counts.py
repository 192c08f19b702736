"""Token counts under a unigram model, with one forward pass for each shared prefix.

The pieces of a public vocabulary get Zipf scores, -ln(rank), from their order in the file; nothing is trained. The
distinct pre-tokens of a batch are walked as a trie: in sorted order, which is the trie's own, with the nodes of the
present path kept. A node holds the best score of any segmentation of its prefix and that segmentation's number of
tokens, computed once from its ancestors when the walk first comes to it; words that share a prefix share the work,
and what a word's last node holds is stored. The pieces that end in a node come from an automaton over the
vocabulary. Texts then only add up their words' counts. Each worker keeps the counts of words up to a bound, and
starts afresh beyond it; there is no shuffle.

A pre-token is a maximal run without white space, led by the word mark. Characters that the vocabulary lacks are
spelled as their UTF-8 bytes. Of equal scores the fewer tokens count. Defined cases: a null or empty text has no
tokens; rows that repeat are counted alike; ids may be null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"


class Unigram:
    """Scores of pieces: piece -> (score, tokens)."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float]):
        self.pieces = {k: (v, 1) for k, v in scores.items()}
        self.byte_scores = byte_scores
        self.longest = max(map(len, scores), default=1)
        self.ends = ahocorasick.Automaton()
        for piece, score in scores.items():
            if len(piece) > 1:
                self.ends.add_word(piece, (len(piece), score))
        self.ends.make_automaton()

    def spelled(self, ch: str) -> tuple[float, int]:
        """A single character as bytes."""
        own = ch.encode("utf-8", "surrogatepass")
        return sum(self.byte_scores[b] for b in own), len(own)


@cache
def vocabulary(path: str) -> Unigram:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, byte_scores = {}, [0.0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_scores[int(sp.id_to_piece(i)[3:5], 16)] = -log(i + 1)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            scores[sp.id_to_piece(i)] = -log(i + 1)
    return Unigram(scores, byte_scores)


class Trie:
    """The walk over sorted words, and what their last nodes held: `tokens` and `scores` by word.

    nodes: how many were computed, the root with them. A path longer than most_nodes is not kept for the next word.
    """

    def __init__(self, model: Unigram, most_nodes: int = 250_000, most_words: int = 600_000):
        self.model, self.most_nodes, self.most_words = model, most_nodes, most_words
        self.tokens: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.nodes = 1
        self._word, self._score, self._count = "", [0.0], [0]

    @property
    def counts(self) -> dict[str, tuple[int, float]]:
        return {w: (n, self.scores[w]) for w, n in self.tokens.items()}

    def _walk(self, word: str) -> tuple[int, float]:
        """Go to the word's node; only nodes behind the prefix shared with the word before are computed."""
        before, score, count = self._word, self._score, self._count
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        pieces, size = self.model.pieces, len(word)
        found: list[list] = [[] for _ in range(size - shared)]
        if self.model.longest > 1 and size > 1:
            for end, piece in self.model.ends.iter(word, max(0, shared - self.model.longest + 1)):
                if end >= shared:
                    found[end - shared].append(piece)
        for at in range(shared, size):
            ch = word[at]
            own, n = pieces[ch] if ch in pieces else self.model.spelled(ch)
            best, tokens = score[at] + own, count[at] + n
            for length, piece in found[at - shared]:
                start = at + 1 - length
                own = score[start] + piece
                if own > best or (own == best and count[start] + 1 < tokens):
                    best, tokens = own, count[start] + 1
            score.append(best)
            count.append(tokens)
        self.nodes += size - shared
        self._word = word
        out = count[-1], score[-1]
        if size > self.most_nodes:
            self._word, self._score, self._count = "", [0.0], [0]
        return out

    def add(self, words: set[str]) -> None:
        """Count the new words, so that those with a common prefix follow each other."""
        if len(self.tokens) + len(words) > self.most_words:
            self.tokens, self.scores = {}, {}
        for word in sorted(w for w in words if w not in self.tokens):
            self.tokens[word], self.scores[word] = self._walk(MARK + word)


_TRIES: dict[str, Trie] = {}


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob (of the best segmentations) for each row of `docs`. model: vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _TRIES:
            _TRIES[model] = Trie(vocabulary(model))
        trie = _TRIES[model]
        for b in batches:
            n_words, n_tokens, log_prob = [], [], []
            texts = b.column(1).to_pylist()
            for first in range(0, len(texts), 2000):
                part = texts[first : first + 2000]
                distinct: set[str] = set()
                for text in part:
                    if text:
                        distinct.update(text.split())
                trie.add(distinct)
                tokens, scores = trie.tokens.__getitem__, trie.scores.__getitem__
                for text in part:
                    words = text.split() if text else []
                    n_words.append(len(words))
                    n_tokens.append(sum(map(tokens, words)))
                    log_prob.append(round(sum(map(scores, words)), 4))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(log_prob, pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "log_prob"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long, log_prob double")
