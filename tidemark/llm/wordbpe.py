"""Token ids of a word-level BPE vocabulary, fast enough for whole corpora.

The tokenizer file's normaliser (NFC, lower case) and split pattern are applied to the whole text;
the pieces are then merged by rank in compiled code.  A vocabulary of this kind marks the last
byte of a piece: here the mark is a zero byte after the piece, and the 256 tokens "byte + mark" are
given the first ranks, so that they form before anything else.  Merging by the rank of the joined
bytes equals merging by listed pairs as long as every token is what its own bytes merge to; the
tests check that for the whole vocabulary.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words kept from one batch to the next; bounds a worker's memory to some 120 MB and one batch's words.
MEMO = 600_000

_SHARED: dict[str, WordBpe] = {}
_MARK = "\0"
#: Texts with these go to the library itself: the mark, characters that are white space to Python
#: but not to the split pattern, and what may be the string of a special token.
_ODD = re.compile("[\0\x1c-\x1f]|<\\|")
_RARE = re.compile("[\0\x1c-\x1f]")


def shared(path: str) -> WordBpe:
    """One instance a process and file: a reused Python worker loads the vocabulary once."""
    if path not in _SHARED:
        _SHARED[path] = WordBpe(path)
    return _SHARED[path]


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe:
    """Encodes texts as unsigned 32-bit ids; equal to the library's encode()."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or model["end_of_word_suffix"] != "</w>":
            raise ValueError("not a tokenizer of the word BPE kind")
        self.path = path
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            body = token.removesuffix("</w>")
            return bytes(letters[c] for c in body) + (b"\0" if body != token else b"")

        vocab: dict[str, int] = model["vocab"]
        # single bytes, then bytes with the mark, then one token for each listed merge in order
        order: dict[bytes, int] = {}
        for c in letters:
            order[raw(c)] = vocab[c]
        for c in letters:
            order[raw(c + "</w>")] = vocab[c + "</w>"]
        for merge in model["merges"]:
            pair = merge.split(" ") if isinstance(merge, str) else merge
            order.setdefault(raw("".join(pair)), vocab["".join(pair)])
        self.ids = np.fromiter(order.values(), "<u4", len(order))
        self.merger = tiktoken.Encoding(
            "pieces", pat_str=r"[^\x00]*\x00", mergeable_ranks={t: k for k, t in enumerate(order)}, special_tokens={}
        )
        self.parting = list(order).index(_MARK.encode())
        self.words: dict[str, bytes] = {}
        self._library: Tokenizer | None = None

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _learn(self, words: list[str]) -> None:
        """Merge new words in one go; an empty piece, which no text can make, parts one from the next."""
        low = "\n".join(words)
        if not low.isascii():
            # a final sigma is the one letter whose lower case depends on its neighbours
            low = unicodedata.normalize("NFC", low).replace("Σ", "σ")
        pieces: list[str] = []
        for word in low.lower().split("\n"):
            # the two usual shapes need no pattern: letters, and letters with one closing mark
            if word.isalpha():
                pieces += (word, "")
            elif word[:-1].isalpha() and word[-1] in ",.;:!?":
                pieces += (word[:-1], word[-1], "")
            else:
                pieces += self.pattern.findall(word)
                pieces.append("")
        pieces.append("")
        ranks = self.merger.encode_to_numpy(_MARK.join(pieces))
        ends = np.flatnonzero(ranks == self.parting).tolist()
        ids, start = self.ids[ranks].tobytes(), 0
        for word, end in zip(words, ends, strict=True):
            self.words[word] = ids[4 * start : 4 * end]
            start = end + 1

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        odd = [bool(_ODD.search(t)) and (bool(_RARE.search(t)) or any(s in t for s in self.specials)) for t in texts]
        parts = [[] if o else t.split() for t, o in zip(texts, odd)]
        new = {w for p in parts for w in p if w not in self.words}
        if new:
            if len(self.words) + len(new) > MEMO:
                self.words.clear()
                new = {w for p in parts for w in p}
            self._learn(list(new))
        take = self.words.__getitem__
        return [
            np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else b"".join(map(take, p))
            for t, o, p in zip(texts, odd, parts)
        ]
