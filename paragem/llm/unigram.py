"""Token counts under a unigram vocabulary, with prefixes of pre-tokens computed once.

Distinct pre-tokens are inserted in a trie. The node of a prefix keeps its forward
score, the best sum of log probabilities over all ways to cut the prefix into pieces,
and how many pieces that takes. A new node needs only the nodes above it, so pre-tokens
with a common beginning share the work, and the node that ends one holds its count.
A pre-token of over LONG characters hardly shares a beginning of that length with
another; from there on its forward scores are kept only as far back as a piece reaches,
so that memory does not grow with it.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the space in front of a pre-token.
SPACE = "▁"
#: Nodes of a task's trie, pre-tokens a task remembers and their characters; when there are more, they are started anew.
NODES, REMEMBERED, CHARACTERS = 300_000, 600_000, 1 << 24
#: Characters of a pre-token that go into the trie.
LONG = 1024
#: Texts looked at together, and their characters from which on fewer are.
TEXTS, AT_ONCE = 256, 1 << 22
#: Tells children of different nodes apart in one number.
SIGNS = 0x110000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Log probability of each piece, by Zipf's law from its place in the file, which is that of its merge."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [
        i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = sum(1 / (rank + 1) for rank in range(len(usual)))
    return {model.id_to_piece(i): -math.log((rank + 1) * total) for rank, i in enumerate(usual)}


class ForwardTrie:
    """Forward scores by prefix. A character of no piece counts as its UTF-8 bytes, each less likely than any piece."""

    def __init__(self, pieces: dict[str, float]):
        # the vocabulary as a trie too: the next node by sign, and the value of a node that ends a piece
        self.step: dict[int, int] = {}
        self.value: list[float | None] = [None]
        for piece, value in pieces.items():
            node = 0
            for sign in piece:
                key = node * SIGNS + ord(sign)
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.value)
                    self.value.append(None)
            self.value[node] = value
        self.byte = min(pieces.values(), default=0.0) - 1
        self.longest = max(map(len, pieces), default=0)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        # of each node: score, pieces, and the (vocabulary node, start) of the beginnings of pieces that end there
        self.score, self.tokens, self.open = array("d", [0.0]), array("l", [0]), [()]

    def __len__(self) -> int:
        return len(self.score)

    def insert(self, word: str) -> tuple[int, float]:
        """(pieces, log probability) of the best cut; of equal ones the one with fewest pieces."""
        path, node, child = [0], 0, self.child
        for sign in map(ord, word[:LONG]):
            key = node * SIGNS + sign
            node = child.get(key, 0)
            if not node:
                node = child[key] = self._add(path, sign)
            path.append(node)
        return self._slide(path, word) if len(word) > LONG else (self.tokens[node], self.score[node])

    def _slide(self, path: list[int], word: str) -> tuple[int, float]:
        """What ``insert`` gives for ``word`` whose first LONG characters lead along ``path``, without new nodes."""
        step, values, wide = self.step, self.value, self.longest + 1
        # score and pieces of the prefix of k characters stand at k % wide
        score, tokens = [0.0] * wide, [0] * wide
        for k in range(max(0, LONG - self.longest), LONG + 1):
            score[k % wide], tokens[k % wide] = self.score[path[k]], self.tokens[path[k]]
        still = list(self.open[path[-1]])
        for k in range(LONG, len(word)):
            sign = ord(word[k])
            size = 1 if sign < 0x80 else len(word[k].encode())
            best, fewest = score[k % wide] + self.byte * size, tokens[k % wide] + size
            still.append((0, k))
            going = []
            for piece, start in still:
                piece = step.get(piece * SIGNS + sign, 0)
                if piece:
                    going.append((piece, start))
                    value = values[piece]
                    if value is not None:
                        value += score[start % wide]
                        if value > best or value == best and tokens[start % wide] + 1 < fewest:
                            best, fewest = value, tokens[start % wide] + 1
            still = going
            score[(k + 1) % wide], tokens[(k + 1) % wide] = best, fewest
        return tokens[len(word) % wide], score[len(word) % wide]

    def _add(self, path: list[int], sign: int) -> int:
        above, score, tokens, step, values = path[-1], self.score, self.tokens, self.step, self.value
        size = 1 if sign < 0x80 else len(chr(sign).encode())
        best, fewest = score[above] + self.byte * size, tokens[above] + size
        still = []
        for piece, start in (*self.open[above], (0, len(path) - 1)):
            piece = step.get(piece * SIGNS + sign, 0)
            if piece:
                still.append((piece, start))
                value = values[piece]
                if value is not None:
                    before = path[start]
                    value += score[before]
                    if value > best or value == best and tokens[before] + 1 < fewest:
                        best, fewest = value, tokens[before] + 1
        score.append(best)
        tokens.append(fewest)
        self.open.append(tuple(still))
        return len(score) - 1


def together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows looked at together: TEXTS at most, ending with the row that brings them to AT_ONCE characters."""
    begin = size = 0
    for end, own in enumerate(sizes, 1):
        size += own
        if end - begin == TEXTS or size >= AT_ONCE or end == len(sizes):
            yield begin, end
            begin, size = end, 0


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, log_score.

    Words stand between white space; each is cut with a leading space into the pieces of the
    vocabulary file ``model``, and the best cuts are added up. A null or empty text has no
    words and score 0. Repeated rows come back once each, ids may be null; other columns
    are not read; an empty table gives an empty result. Each task keeps a trie of the words
    it has met, of bounded size; a word of any length needs no more than its own
    characters beside it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = ForwardTrie(vocabulary(model))
        tokens: dict[str, int] = {}
        score: dict[str, float] = {}
        held = 0
        for batch in batches:
            for begin, end in together([len(text or "") for text in batch["text"]]):
                part = batch.iloc[begin:end]
                texts = [(text or "").split() for text in part["text"]]
                if len(tokens) > REMEMBERED or held > CHARACTERS:
                    tokens.clear()
                    score.clear()
                    held = 0
                # in order, words with a common beginning find the nodes of one another
                for word in sorted(set().union(*texts).difference(tokens)):
                    if len(trie) > NODES:
                        trie.clear()
                    tokens[word], score[word] = trie.insert(SPACE + word)
                    held += len(word)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n_words": [len(words) for words in texts],
                        "n_tokens": [sum(map(tokens.__getitem__, words)) for words in texts],
                        "log_score": [math.fsum(map(score.__getitem__, words)) for words in texts],
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        count, "doc_id long, n_words long, n_tokens long, log_score double"
    )
