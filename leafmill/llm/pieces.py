"""Encoding of whole texts by their space-separated pieces.

The pre-tokenizers used here never let a token cross a plain space or a newline that has a
character other than white space on both sides, and what they make of a piece does not depend
on its neighbours. So a text is cut there, each different piece is encoded once and remembered,
and a document's ids are its pieces' ids in order. Texts in which white space touches white
space are encoded whole, which is the definition itself, and so are texts that hold an added token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

#: Pieces that a worker remembers in each of two generations.
REMEMBERED = 350_000

_SPACE = re.compile(r"\s")
#: One run of letters, then marks that every pre-tokenizer here puts in a token of their own.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)")


class Memory:
    """Values by key in two generations: when the young one is full it becomes the old one, and
    what is asked for again is carried over. So it stays bounded and keeps what is frequent."""

    def __init__(self, most: int = REMEMBERED):
        self.young: dict = {}
        self._old: dict = {}
        self._most = most

    def missing(self, keys: set) -> list:
        """Those of keys that nothing is known of; the others are young afterwards."""
        if len(self.young) > self._most:
            self.young, self._old = {}, self.young
        ask = keys.difference(self.young)
        found = ask & self._old.keys()
        self.young.update((x, self._old[x]) for x in found)
        return list(ask - found)


class PieceEncoder:
    """encode: the ids of each text of a list, as little-endian unsigned 32-bit bytes.

    keep_space: a piece after a space is encoded with that space before it (byte-level
    pre-tokenizers); otherwise spaces carry no token. encode_words gets strings that are one
    pre-token each, encode_many any strings. A text that contains one of added is not cut.
    """

    def __init__(
        self,
        encode_many: Callable[[Sequence[str]], Iterable[bytes]],
        keep_space: bool,
        encode_words: Callable[[Sequence[str]], Iterable[bytes]] | None = None,
        added: Iterable[str] = (),
    ):
        self._encode_many = encode_many
        self._encode_words = encode_words or encode_many
        self._keep_space = keep_space
        self._memory = Memory()
        self._added = tuple(added)

    def cut(self, text: str) -> list[str]:
        """A text's pieces. One after a newline keeps it; the first one has two, as no other has."""
        if not self._keep_space:
            return text.replace("\n", " ").split(" ")
        found = text.replace("\n", " \n").split(" ")
        found[0] = "\n\n" + found[0]
        return found

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        flat: list[str] = []
        ends: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if any(x in text for x in self._added):
                whole.append(i)
            elif text:
                flat += self.cut(text)
            ends.append(len(flat))
        self._learn(self._memory.missing(set(flat)))
        ids = list(map(self._memory.young.__getitem__, flat))
        out, start = [], 0
        for i, end in enumerate(ends):
            try:
                out.append(b"".join(ids[start:end]))
            except TypeError:  # a piece that depends on its neighbours
                whole.append(i)
                out.append(b"")
            start = end
        for i, x in zip(whole, self._encode_many([texts[i] for i in whole])):
            out[i] = x
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces; None for one in which white space touches white space."""
        known, before = self._memory.young, " " if self._keep_space else ""
        words, tails, odd, odd_text = [], [], [], []
        simple = []
        for x in pieces:
            if m := _SIMPLE.fullmatch(x):
                simple.append(x)
                words.append(before + m[1])
                tails.append(m[2])
            elif not self._keep_space:
                odd.append(x)
                odd_text.append(x)
            else:
                first = x.startswith("\n\n")
                rest = x[2:] if first else x.removeprefix("\n")
                if not rest or _SPACE.search(rest):
                    known[x] = None
                else:
                    odd.append(x)
                    odd_text.append(rest if first else x if x[0] == "\n" else " " + x)
        ids_of_tail = dict.fromkeys(tails, b"")
        marks = [t for t in ids_of_tail if t]
        ids_of_tail.update(zip(marks, self._encode_many(marks)))
        for x, ids, t in zip(simple, self._encode_words(words), tails):
            known[x] = ids + ids_of_tail[t] if t else ids
        known.update(zip(odd, self._encode_many(odd_text)))


def vocabulary_of(path: str) -> int:
    """The largest id of a tokenizers library file, and one."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


@lru_cache(maxsize=1)
def library_encoder(path: str, keep_space: bool) -> PieceEncoder:
    """By the tokenizers library, from one of its files; the strings of its added tokens are those tokens.

    A worker process keeps its encoder, and what that remembers, from task to task.
    """
    import os

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    # the tokens that begin (byte level) or end (word ends) a word
    edge = np.zeros(max(vocab.values()) + 1, bool)
    edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if keep_space else t.endswith("</w>"))]] = True

    def encode_many(texts: Sequence[str]) -> Iterable[bytes]:
        for at in range(0, len(texts), 1000):
            for x in tokenizer.encode_batch_fast(list(texts[at : at + 1000]), add_special_tokens=False):
                yield np.array(x.ids, dtype="<u4").tobytes()

    def encode_words(words: Sequence[str]) -> Iterable[bytes]:
        """Many words as one text, cut again where a word begins or ends."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            text = ("" if keep_space else " ").join(part)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(edge[ids])
            if len(cuts) != len(part):  # some word has several edges: one by one
                yield from encode_many(part)
                continue
            cuts = ((np.append(cuts, len(ids)) if keep_space else np.append(0, cuts + 1)) * 4).tolist()
            raw = ids.tobytes()
            yield from map(raw.__getitem__, map(slice, cuts, cuts[1:]))

    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    return PieceEncoder(encode_many, keep_space, encode_words, added)
