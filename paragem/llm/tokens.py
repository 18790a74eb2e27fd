"""Token ids of a public byte-level BPE, one pre-token at a time and each distinct one once per task.

Texts are cut where pre-tokens always part, mostly into single ones. Of the texts encoded
together each different chunk is looked up once; their ids are gathered from those of the chunks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pre-tokens of the vocabulary, in the letters, digits and signs of PLAIN texts.
PRE_TOKEN = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
#: Texts of these signs only are split here; in any other the tokenizer itself splits, as its tables of letters and
#: digits may differ. Left out are controls read differently as white space, and number signs that are not digits.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ſ]*")
#: Pre-tokens that stay apart when written one after the other: a space and letters. Number of them in a text.
SIDE_BY_SIDE, JOINED = re.compile(r" [A-Za-zÀ-ÖØ-öø-ſ]+"), 1000
#: How a token of a byte-level vocabulary begins that holds the space before a word.
SPACE = "Ġ"
SPECIAL = "<|endoftext|>"
#: Signs of PLAIN texts with the white space before them, up to white space if one is an apostrophe: pre-tokens part
#: before and behind. They also part before a space that no white space follows, and, in a text where no more than two
#: of white space stand together and one at the end, before any space.
SIGNS = r"(\s*[^A-Za-zÀ-ÖØ-öø-ſ\s']*'\S*|\s*[^A-Za-zÀ-ÖØ-öø-ſ\s']+)"
SPACED, WIDE = r" (\S)", r"\s\s\s|\s\s\z"
#: Stands between chunks; no PLAIN text has it.
MARK = "\0"
#: A place where two pre-tokens always part, so that what is before and behind it may be encoded apart.
APART = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: Characters from which on a text is cut at such a place, and characters split into pre-tokens at once.
PART, AT_ONCE = 1 << 18, 1 << 21
#: Bytes of pre-tokens and their ids remembered by a worker, with about 170 for each pair of objects.
REMEMBERED, OBJECTS = 96 << 20, 170


def parts(text: str) -> Iterator[str]:
    """``text`` in parts of about PART characters whose ids, one after the other, are those of the text."""
    at = 0
    while len(text) - at > PART:
        cut = APART.search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """``ids(texts)`` equals the tokenizer's own encoding without special tokens added, as 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token, by its id, holds the space before a word.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token.startswith(SPACE)]] = True
        #: The ids of a pre-token, as their bytes.
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, text: str) -> bytes:
        one = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]  # without places in the text
        return array("I", one.ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of pre-tokens; those that a text may hold side by side are encoded as texts of JOINED."""
        self.held += sum(map(len, new)) * 5 + len(new) * OBJECTS  # an id or less for a letter
        beside = []
        for word in new:
            if SIDE_BY_SIDE.fullmatch(word):
                beside.append(word)
            else:
                self.known[word] = self._encode(word)
        for at in range(0, len(beside), JOINED):
            words = beside[at : at + JOINED]
            ids = self._encode("".join(words))
            # the one space of a word is in its first token
            begins = np.flatnonzero(self.spaced[np.frombuffer(ids, np.uint32)]) * 4
            ends = np.append(begins[1:], len(ids))
            for word, begin, end in zip(words, begins.tolist(), ends.tolist(), strict=True):
                self.known[word] = ids[begin:end]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of ``chunks``, which may be several pre-tokens."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        found = list(map(self.known.get, chunks))
        rest = [k for k, ids in enumerate(found) if ids is None]
        # chunks differ, so what is a pre-token of its own is new
        new = [chunk for k in rest if SIDE_BY_SIDE.fullmatch(chunk := chunks[k])]
        alone = set(new)
        split = {k: PRE_TOKEN.findall(chunks[k]) for k in rest if chunks[k] not in alone}
        parted = dict.fromkeys(chain.from_iterable(split.values()))
        new += [word for word in parted if word not in self.known and word not in alone]
        self._learn(new)
        of = self.known.__getitem__
        for k in rest:
            found[k] = b"".join(map(of, split[k])) if k in split else of(chunks[k])
        return found

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of PLAIN texts."""
        whole = pa.array(texts, pa.large_string())
        apart = pc.replace_substring_regex(whole, SIGNS, f"{MARK}\\1{MARK}")
        marked = pc.replace_substring(apart, " ", f"{MARK} ")
        wide = pc.match_substring_regex(whole, WIDE)
        if pc.any(wide).as_py():
            some = pc.replace_substring_regex(apart.filter(wide), SPACED, f"{MARK} \\1")
            marked = pc.replace_with_mask(marked, wide, some)
        split = pc.split_pattern(marked, MARK)
        chunks = split.values.dictionary_encode()
        own = self._chunk_ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        bounds, data = pa.array(own, pa.large_binary()).take(chunks.indices).buffers()[1:]
        flat = np.frombuffer(data or b"", np.uint32)
        bounds = np.frombuffer(bounds, np.int64)[split.offsets.to_numpy()] // 4
        return [flat[begin:end] for begin, end in pairwise(bounds.tolist())]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [SPECIAL not in t and PLAIN.fullmatch(t) is not None for t in texts]
        known = iter(self._plain_ids([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        return [
            next(known) if p else np.frombuffer(self._encode(text), np.uint32)
            for text, p in zip(texts, plain, strict=True)
        ]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        owners, waiting, size = [], [], 0
        for owner, text in enumerate(texts):
            for part in parts(text):
                owners.append(owner)
                waiting.append(part)
                size += len(part)
                if size >= AT_ONCE:
                    for at, ids in zip(owners, self._ids(waiting), strict=True):
                        found[at].append(ids)
                    owners, waiting, size = [], [], 0
        for at, ids in zip(owners, self._ids(waiting), strict=True):
            found[at].append(ids)
        return [own[0] if len(own) == 1 else np.concatenate(own) for own in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
