"""Token ids of whole texts by a public tokenizer, a block of texts at a time.

The tokenizer splits at words and never merges across them, so a text's ids are those of its
words. In texts of ASCII and the letters of Latin-1, numpy finds the words by the tokenizer's
own pattern and only words that this worker hasn't met go through the tokenizer. Any other
text, and one with a contraction or what may be a special token's string, goes through the
tokenizer as it is, in pieces that end at a space or line end, which no token crosses.
"""

from __future__ import annotations

import numpy as np

from scholia.llm.textbytes import NONSPACE, pieces, span_ids

PIECE = 1 << 20
EOS = 2
#: Words that a worker keeps with their ids, at most.
MOST_WORDS = 1_000_000

_LETTER, _DIGIT, _SYMBOL, _ODD = 1, 2, 3, 4
_CLASS = np.array([0 if b in (9, 10, 13, 32) else _LETTER if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else _DIGIT if 48 <= b <= 57 else _SYMBOL if 33 <= b <= 126 else _ODD for b in range(256)], np.uint8)
_AFTER_APOSTROPHE = np.isin(np.arange(256), list(b"stmdrvl"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(bytes, offsets): the ids of each text, and where each text's begin."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.hash, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """Add sorted new words."""
        if len(self.hash) + len(h) > MOST_WORDS:
            self.hash, self.first, self.size, self.flat = self.hash[:0], self.first[:0], self.size[:0], self.flat[:0]
        ids = np.array(self.tok.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(h):
            raise ValueError("the tokenizer splits a word otherwise than its pattern says")
        size = np.diff(end, prepend=0)
        at = np.searchsorted(self.hash, h)
        self.hash, self.first, self.size = np.insert(self.hash, at, h), np.insert(self.first, at, len(self.flat) + end - size), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def _whole(self, raw: bytes) -> np.ndarray:
        """Ids of one text by the tokenizer alone."""
        text, out, a = raw.decode("utf-8", "replace"), [], 0
        while a < len(text):
            b = min(len(text), a + PIECE)
            if b < len(text):
                cut = max(text.rfind(" ", a, b), text.rfind("\n", a, b))
                if cut < a:
                    cut = min([x for x in (text.find(" ", b), text.find("\n", b)) if x >= 0], default=len(text))
                b = min(cut + 1, len(text))
            out.append(np.array(self.tok.encode(text[a:b], add_special_tokens=False).ids, np.uint32))
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end); each text's ids end with EOS."""
        n = len(offs) - 1
        hs, starts, ends_, slow = [], [], [], np.zeros(n, bool)
        for a, x, inner in pieces(data, offs, NONSPACE):
            x = x.copy()
            after = np.zeros(len(x), bool)
            after[1:] = x[:-1] == 0xC3
            x[after & (x >= 0x80) & (x <= 0x9E) & (x != 0x97)] += 32
            cls = _CLASS[x]
            odd = (cls == _ODD) | (after & ((x == 0x97) | (x == 0xB7))) | ((x >= 0x80) & (x <= 0xBF) & ~after)
            if len(x) > 1:
                odd[:-1] |= ((x[:-1] == 39) & _AFTER_APOSTROPHE[x[1:]]) | ((x[:-1] == 60) & (x[1:] == 124))
            bad = np.flatnonzero(odd)
            if len(bad):
                slow[np.searchsorted(offs, bad + a, "right") - 1] = True
            st = np.ones(len(x), bool)
            st[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
            st[inner] = True
            edge = np.flatnonzero(st)
            end = np.concatenate([edge[1:], [len(x)]])
            word = cls[edge] != 0
            s, e = edge[word], end[word]
            hs.append(span_ids(x, s, e))
            starts.append(s + a)
            ends_.append(e + a)
        if hs:
            h, s, e = np.concatenate(hs), np.concatenate(starts), np.concatenate(ends_)
        else:
            h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if slow.any():
            fine = ~slow[np.searchsorted(offs, s, "right") - 1]
            h, s, e = h[fine], s[fine], e[fine]
        seen, where, k = np.unique(h, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.hash, seen)
            new = at == len(self.hash)
            new[~new] = self.hash[at[~new]] != seen[~new]
            if not new.any():
                break
            if len(self.hash) + int(new.sum()) > MOST_WORDS:
                new[:] = True  # the table starts anew
            low = NONSPACE[0]
            self._learn(seen[new], [low[data[s[i] : e[i]]].tobytes() for i in where[new]])
        first, size = self.first[at][k], self.size[at][k]
        # where each word's ids go: texts' ids follow one another, each with EOS at its end
        doc = np.searchsorted(offs, s, "right") - 1
        per = np.bincount(doc, size, minlength=n).astype(np.int64) + 1
        whole = {i: self._whole(data[offs[i] : offs[i + 1]].tobytes()) for i in np.flatnonzero(slow).tolist()}
        for i, ids in whole.items():
            per[i] = len(ids) + 1
        ptr = np.concatenate([[0], np.cumsum(per)])
        out = np.full(ptr[-1], EOS, np.uint32)
        total = np.cumsum(size)
        if len(size):
            begin = total - size
            base = np.searchsorted(doc, np.arange(n), "left")
            word0 = np.concatenate([begin, [total[-1]]])[np.minimum(base, len(begin))]
            src = np.repeat(first - begin, size) + np.arange(total[-1])
            dst = np.repeat(ptr[doc] - word0[doc], size) + np.arange(total[-1])
            out[dst] = self.flat[src]
        for i, ids in whole.items():
            out[ptr[i] : ptr[i] + len(ids)] = ids
        return out, ptr


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
