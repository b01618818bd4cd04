"""Tokenising with the ``tokenizers`` library, chunk by chunk.

Byte-level BPE cuts a text into pre-tokens first and encodes each alone.  A
single space between two characters that are not white space always begins a
pre-token, so a text may be cut there and the chunks encoded apart: the ids are
the same and equal chunks need encoding once.  Texts with a space next to other
white space are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import accumulate, chain

import numpy as np

#: chunks remembered per worker; at the bound the memory starts afresh (ids do not depend on it)
CACHE_CHUNKS = 1_000_000
#: texts taken apart at once
SLICE = 256
#: how byte-level vocabularies write a space
_SPACE = "\u0120"


class Encoder:
    """Ids of texts as packed little-endian bytes (2 bytes each where the
    vocabulary allows, else 4)."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker and vocabulary, kept between tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        self.spaced = np.zeros(self.tok.get_vocab_size(), bool)   # ids of tokens that begin with a space
        self.spaced[[i for token, i in self.tok.get_vocab().items() if token.startswith(_SPACE)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of " chunk" for chunks without white space at their ends: joined
        by single spaces they are one text, encoded in one call, and each
        begins at a token that begins with a space."""
        if not chunks:
            return []
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(chunks):                    # not a byte-level vocabulary
            return self._encode([" " + x for x in chunks])
        at = (starts * self.width).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)])]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        for i in range(0, len(texts), SLICE):
            out += self._encode_slice(texts[i:i + SLICE])
        return out

    def _chunk_ids(self, chunks: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of each chunk, and the places of chunks that cannot stand alone."""
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        got = list(map(known.get, chunks))
        gaps = [i for i, ids in enumerate(got) if ids is None]
        new = dict.fromkeys(chunks[i] for i in gaps)
        fit = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        known.update(zip(fit, self._encode_chunks(fit)))
        for i in gaps:
            got[i] = known.get(chunks[i])
        return got, [i for i in gaps if got[i] is None] if len(fit) < len(new) else []

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        heads, bodies, tails, whole = [], [], [], set()
        for i, t in enumerate(texts):
            head, *body = t.split(" ")
            tail = " " + body.pop() if body and body[-1][-1:].isspace() else ""    # the text's last white space
            if head[-1:].isspace() and (body or tail) or tail[1:2].isspace():
                whole.add(i)
                body = []
            heads.append(head)
            bodies.append(body)
            tails.append(tail)
        got, unfit = self._chunk_ids(list(chain.from_iterable(bodies)))
        ends = list(accumulate(map(len, bodies), initial=0))
        if unfit:
            whole.update((np.searchsorted(ends, unfit, side="right") - 1).tolist())
        alone = iter(self._encode([x for i, t in enumerate(texts) for x in ((t,) if i in whole else (heads[i], tails[i]))]))

        def pieces(i: int) -> Iterable[bytes]:
            return (next(alone),) if i in whole else (next(alone), *got[ends[i]:ends[i + 1]], next(alone))
        return [b"".join(pieces(i)) for i in range(len(texts))]
