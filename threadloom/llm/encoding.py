"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

Both public vocabularies split a text into pieces before merging, and no piece reaches over a cut used here:
``words`` (white space is dropped): any ASCII white space;
``spaces`` (a space belongs to the word after it): before a run of ASCII white space, before the last of a run and, unless that is a space, after it;
both: between a letter and ASCII punctuation after it.
A text with other white space in ``spaces`` mode, or with something like a special token, is encoded as a whole. So the ids
equal those of the whole text. Each distinct piece of a batch is looked up once, and new words go to the library many at a
time. The cache is bounded by the number of entries, in two generations.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

from .shared import CACHES

#: White space outside of ASCII, or the beginning of its UTF-8 form.
ODD = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: UTF-8 forms from U+0300 on begin with this byte or a greater one; below, lower case first changes no composed character.
COMBINING = 0xCC

SPACE, LETTER, MARK = 1, 2, 4
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
for c in range(33, 127):
    KINDS[c] = LETTER if chr(c).isalpha() else 0 if chr(c).isdigit() else MARK


def shifted(x: np.ndarray, first) -> np.ndarray:
    """x moved one place to the right."""
    out = np.empty_like(x)
    out[:1] = first
    out[1:] = x[:-1]
    return out


class Encoder:
    """literal: a special token's string in a text is ordinary text, instead of that token as in the library's plain call."""

    def __init__(self, path: str, mode: str, literal: bool = False, limit: int = 400_000):
        if mode not in ("words", "spaces", "whole"):
            raise ValueError(f"mode must be words, spaces or whole, not {mode!r}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.special = [] if literal else [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mode, self.limit = mode, limit
        self.cache, self.older = {}, {}
        self.lowers = "Lowercase" in repr(self.tokenizer.normalizer)
        vocab = self.tokenizer.get_vocab()
        self.type = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        # tokens that end a word, or that begin one with its space
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.endswith("</w>") if mode == "words" else t.startswith("Ġ"))]] = True

    def _each(self, pieces: list[str]) -> list[bytes]:
        kind = "H" if self.type.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for i in range(0, len(pieces), 20_000) for e in self.tokenizer.encode_batch_fast(pieces[i : i + 20_000], add_special_tokens=False)]

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Words of letters alone go in one text with others: each then has exactly one token that ends (or begins) a word."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        out: list = [None] * len(texts)
        begin, size = int(self.mode == "spaces"), self.type.itemsize
        words = [i for i, t in enumerate(texts) if t[begin:].isalpha() and (not begin or t[0] == " ")] if self.mode != "whole" else []
        for a in range(0, len(words), 20_000):
            runs = [words[i : i + 1000] for i in range(a, min(a + 20_000, len(words)), 1000)]
            found = self.tokenizer.encode_batch_fast([("" if begin else " ").join([texts[i] for i in run]) for run in runs], add_special_tokens=False)
            for run, e in zip(runs, found, strict=True):
                ids = np.array(e.ids, self.type)
                edges = np.flatnonzero(self.edge[ids])
                if len(edges) == len(run):  # else these are encoded one by one
                    ends = (np.r_[edges[1:], len(ids)] if begin else edges + 1) * size
                    raw, at = ids.tobytes(), 0
                    for i, end in zip(run, ends.tolist(), strict=True):
                        out[i] = raw[at:end]
                        at = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._each([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _pieces(self, texts: list[bytes | None]):
        """All pieces of the texts as one Arrow array, and the number of pieces before each text and in all."""
        import pyarrow as pa

        texts = [t or b"" for t in texts]
        whole = set()
        if self.mode != "whole":
            whole = {i for i, t in enumerate(texts) if any(s in t.lower() for s in self.special)} if any(b"<" in t for t in texts) else set()
            if self.mode == "spaces":
                whole |= {i for i, t in enumerate(texts) if not t.isascii() and any(x in t for x in ODD)}
            elif self.lowers:  # one case means fewer distinct pieces
                texts = [t if i in whole or np.frombuffer(t or b"\0", np.uint8).max() >= COMBINING else t.lower() for i, t in enumerate(texts)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        if self.mode == "whole" or not len(data):
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.r_[begins, len(data)].tobytes()), pa.py_buffer(data)]), np.arange(len(texts) + 1)
        kind = KINDS[data]
        before = shifted(data, 0)
        # a byte after 0xC3 ends a Latin letter, but for the two signs there
        letter = (kind == LETTER) | ((before == 0xC3) & (data != 0x97) & (data != 0xB7))
        space = kind == SPACE
        after_space = shifted(space, True)
        first = begins[sizes > 0]
        after_space[first] = True
        cut = (kind == MARK) & shifted(letter, False)
        if self.mode == "words":
            cut |= after_space
            cut &= ~space
            cut[first] = ~space[first]
        else:
            inner = np.ones(len(data), bool)  # what follows is white space or the text's end
            inner[:-1] = space[1:]
            inner[ends[sizes > 0] - 1] = True
            cut |= space & (~after_space | ~inner)
            cut |= after_space & ~space & (before != 32)
            cut[first] = True
        kept = ~space if self.mode == "words" else np.ones(len(data), bool)
        for i in whole:
            if sizes[i]:
                cut[begins[i] : ends[i]], kept[begins[i] : ends[i]] = False, True
                cut[begins[i]] = True
        starts = np.flatnonzero(cut)
        counts = np.searchsorted(starts, np.r_[begins, len(data)])
        if self.mode == "words":
            places = np.cumsum(kept, dtype=np.int64)
            data, starts = data[kept], places[starts] - 1
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data))]), counts

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.cache) > self.limit:  # what is still in use comes back from the older generation
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, pieces))
        holes = [i for i, ids in enumerate(found) if ids is None]
        for i in holes:
            found[i] = self.older.get(pieces[i])
        new = [i for i in holes if found[i] is None]
        for i, ids in zip(new, self._encode([pieces[i] for i in new]), strict=True):
            found[i] = ids
        self.cache.update((pieces[i], found[i]) for i in holes if len(pieces[i]) <= 64)
        return found

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """One array of ids for each text (null counts as empty)."""
        if not texts:
            return []
        pieces, counts = self._pieces(texts)
        coded = pieces.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type.itemsize
        starts, number = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        lengths = sizes[number]
        ends = np.r_[0, np.cumsum(lengths)]
        at = np.repeat(starts[number] - ends[:-1], lengths)
        at += np.arange(len(at))
        return np.split(np.frombuffer(b"".join(ids), self.type)[at], ends[counts[1:-1]])


@lru_cache(maxsize=4)
def encoder(path: str, mode: str, literal: bool = False) -> Encoder:
    """The encoder of this process: Spark reuses Python workers, so later tasks find a filled cache."""
    return Encoder(path, mode, literal)


CACHES.append(encoder)
