"""Token ids of texts by a public vocabulary file, with a bounded cache of words.

The vocabulary's own splitter never joins characters across white space, so a
text's ids are the ids of its ASCII-space separated words in order. Words that
were met before come from the cache; new ones are encoded many at a time. Texts are
split, and words told apart, by Arrow on blocks of several MB; only different
lower-case words without their final punctuation are looked up one by one.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A private-use character between words that are encoded together; its ids mark the borders.
BORDER = "\ue000"
#: A run of these after a letter is a token of its own to the splitter.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of text that are split into words at once.
PIECE = 1 << 22
#: Words of characters that don't compose with their neighbours (those below U+0250) and have one as their lower case
#: (all but the dotted capital I), and words that end in a letter, or in one and a tail.
SIMPLE = r"^[\x00-\x{12f}\x{131}-\x{24f}]*$"
ENDING = r"\pL[" + re.escape(TAIL) + "]*$"
#: Bytes that the vocabulary's byte-level alphabet shows as other characters than their own.
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _one_token(word: str) -> str | None:
    """A lower-case word of letters, which the splitter leaves whole, in the byte-level alphabet."""
    if not word.isalpha() or len(word) > 4096 or not word.islower():
        return None
    if word.isascii():
        return word
    return word.encode().decode("latin-1").translate(_SHOWN) if max(word) < "\u0250" and "\u0130" not in word else None


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """``words`` bounds the cache: an old generation of at most twice that many words and a new one of that many."""

    def __init__(self, path: str, words: int = 100_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.size, self.longest = words, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.border = np.array(self._plain(BORDER), dtype=np.uint32)

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _encode_words(self, words: list[str]) -> list[bytes]:
        text = f" {BORDER} ".join(words)
        ids = np.array(self._plain(text), dtype=np.uint32)
        n, hit = len(self.border), None
        for i, x in enumerate(self.border):
            same = ids[i: len(ids) - n + 1 + i] == x
            hit = same if hit is None else hit & same
        at = np.flatnonzero(hit)
        if len(at) != len(words) - 1:
            return [np.array(self._plain(w), dtype="<u4").tobytes() for w in words]
        starts, ends = np.concatenate([[0], at + n]), np.concatenate([at, [len(ids)]])
        flat = ids.astype("<u4").tobytes()
        return [flat[4 * a: 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words; the cache keeps the short ones."""
        return [x for lo in range(0, len(words), self.size) for x in self._some_ids(words[lo: lo + self.size])]

    def _some_ids(self, words: list[str]) -> list[bytes]:
        new, old, tokenize = self.new, self.old, self.model.model.tokenize
        out, usual = list(map(new.get, words)), []
        for i, w in enumerate(words):
            if out[i] is not None:
                continue
            if (x := old.get(w)) is None:
                if plain := _one_token(w):
                    x = little([t.id for t in tokenize(plain)])
                elif BORDER in w or len(w) > 4096:
                    x = np.array(self._plain(w), dtype="<u4").tobytes()
                else:
                    usual.append(i)
                    continue
            out[i] = x
            if len(w) <= self.longest:
                new[w] = x
        for lo in range(0, len(usual), 2000):
            part = usual[lo: lo + 2000]
            for i, x in zip(part, self._encode_words([words[i] for i in part]), strict=True):
                out[i] = x
                if len(words[i]) <= self.longest:
                    new[words[i]] = x
        if len(new) > self.size:
            self.old, self.new = new, {}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        out, held, size = [[] for _ in texts], [], 0
        for i, text in enumerate(texts):
            raw, at = (text or "").encode(), 0
            while at < len(raw):
                cut = SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
                end = cut.start() if cut else len(raw)
                held.append((i, raw[at:end]))
                size, at = size + end - at, end
                if size >= PIECE:
                    self._flush(held, out)
                    held, size = [], 0
        if held:
            self._flush(held, out)
        return [b"".join(x) for x in out]

    def _flush(self, held: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        lists = pc.ascii_split_whitespace(pa.array([raw for _, raw in held], pa.large_binary()).cast(pa.large_string()))
        found = lists.flatten().dictionary_encode()
        words, which = found.dictionary, found.indices.to_numpy()
        plain = pc.and_(pc.match_substring_regex(words, SIMPLE), pc.match_substring_regex(words, ENDING))
        plain = pc.and_not(plain, pc.match_substring(words, "<|"))
        core = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, TAIL)), words).dictionary_encode()
        tail = pc.if_else(plain, pc.replace_substring_regex(words, r"^(?s:.*)\pL", ""), "").dictionary_encode()
        ids = self._ids(core.dictionary.to_pylist()) + self._ids(tail.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        parts = np.empty(2 * len(which), np.int64)
        parts[0::2] = core.indices.to_numpy()[which]
        parts[1::2] = tail.indices.to_numpy()[which] + len(core.dictionary)
        counts = length[parts]
        ends = np.concatenate([[0], np.cumsum(counts)])
        made = flat[np.repeat(start[parts] - ends[:-1], counts) + np.arange(ends[-1])]
        upto = ends[2 * np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        for (i, _), a, b in zip(held, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            out[i].append(made[a:b].tobytes())


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
