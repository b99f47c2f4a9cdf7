"""Token counts by unigram scores: the best segmentation of each word, found once per shared prefix.

The distinct words of a partition enter a trie. A node keeps the best score of its prefix and the number of
tokens of that best segmentation; both follow from the nodes above it, so words with a common prefix share them, and the node where a
word ends holds its count. Pieces and scores are those of a public vocabulary file; a word is "▁" and a
run of characters other than 0x20 and 0x09-0x0D. A character that no piece covers costs the least score less 10
and counts as its UTF-8 bytes. Among equal scores the longest last piece wins.

Defined results: null, empty and blank texts count 0; repeated rows are counted one by one; an empty table gives no rows;
other columns pass through; one named n_words or n_tokens is replaced. A trie that outgrows MAX_NODES starts anew, also within a
text, and a word of more than LONG_WORD characters keeps only the scores that its longest piece reaches back to,
so memory is bounded whatever the words of the corpus; the counts do not change.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_NODES = 1_500_000
LONG_WORD = 1000  # characters beyond which a word's prefixes do not join the trie
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search


def split_words(text: str) -> list[str]:
    return _WORDS(text) if _OTHER_SPACE(text) else text.split()


def load_pieces(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece file and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}


class PieceTrie:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a word; its prefixes join the trie."""
        text = "▁" + word
        path, node = [0], 0
        child, best, tokens = self.child, self.best, self.tokens
        for d, c in enumerate(text, 1):
            following = child.get((node, c))
            if following is None:
                following = child[node, c] = len(best)
                top, n = self._forward(text, d, path, best, tokens)
                best.append(top)
                tokens.append(n)
            node = following
            path.append(node)
        n = self.known[word] = tokens[node]
        return n

    def _forward(self, text: str, d: int, path: Sequence[int], best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and its tokens for text[:d], from the scores of its prefixes: that of text[:i] stands at path[i]."""
        get = self.pieces.get
        top, n = None, 0
        for start in range(max(0, d - self.longest), d):
            score = get(text[start:d])
            if score is not None:
                total = best[path[start]] + score
                if top is None or total > top:
                    top, n = total, tokens[path[start]] + 1
        if text[d - 1] not in self.pieces:
            total = best[path[d - 1]] + self.unknown
            if top is None or total > top:
                top, n = total, tokens[path[d - 1]] + len(text[d - 1].encode())
        return top, n

    def count_text(self, text: str) -> tuple[int, int]:
        """(words, tokens) of a text."""
        split = split_words(text)
        if len(self.best) > MAX_NODES:
            self.clear()
        known = self.known
        try:
            return len(split), sum([known[w] for w in split])
        except KeyError:
            total = 0
            for w in split:
                n = self.known.get(w)
                if n is None:
                    if len(self.best) > MAX_NODES:
                        self.clear()
                    n = self.count(w) if len(w) < LONG_WORD else self.count_long(w)
                total += n
            return len(split), total

    def count_long(self, word: str) -> int:
        """Tokens of a word, without a trace in the trie."""
        text, best, tokens, gone = "▁" + word, [0.0], [0], 0
        for d in range(1, len(text) + 1):
            top, n = self._forward(text, d, range(-gone, len(best)), best, tokens)
            best.append(top)
            tokens.append(n)
            if len(best) > 4 * self.longest + 1000:
                gone += len(best) - self.longest - 1
                del best[: -self.longest - 1], tokens[: -self.longest - 1]
        return tokens[-1]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_tries: dict[str, PieceTrie] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens. One pass, no shuffle."""
    vocabulary = vocabulary or default_path()
    kept = docs.drop("n_words", "n_tokens")

    def run(batches):
        if vocabulary not in _tries:
            _tries[vocabulary] = PieceTrie(load_pieces(vocabulary))
        trie = _tries[vocabulary]
        for batch in batches:
            made = np.array([trie.count_text(t.as_py() or "") for t in batch.column(text)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made[:, 0]), pa.array(made[:, 1])], [*batch.schema.names, "n_words", "n_tokens"])

    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(run, schema)
