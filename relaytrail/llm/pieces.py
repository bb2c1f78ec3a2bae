"""Memoised encoding of a text's pieces.

A byte-level BPE encodes every match of its split pattern on its own. A text cut at single spaces
has the same matches as its chunks, each with its space in front, if no chunk but the first is empty
or starts with white space: the pattern then starts a match at that space. Other texts are matched
whole. So chunks repeat, and each distinct one is encoded once while the memo holds it.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A worker remembers between this many and twice as many chunks, and as many pieces.
MEMO = 250_000


class Memo:
    """Values by key in two generations: the older one is dropped when the newer one is full.

    What is asked for again moves to the newer one, so frequent keys stay.
    """

    def __init__(self) -> None:
        self.newer: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def turn(self) -> None:
        if len(self.newer) > MEMO:
            self.newer, self.older = {}, self.newer

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that are not remembered; all others are in the newer generation after this."""
        unseen = keys.difference(self.newer)
        again = [k for k in unseen if k in self.older]
        self.newer.update(zip(again, map(self.older.__getitem__, again)))
        return unseen.difference(again)


class PieceEncoder:
    """``encode_pieces`` gives the packed ids (little-endian uint32) of each of some distinct pieces."""

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], Sequence[bytes]]) -> None:
        self.find = regex.compile(pattern).findall
        self.encode_pieces = encode_pieces
        self.pieces, self.chunks = Memo(), Memo()

    def _learn(self, pieces: set[str]) -> None:
        new = list(self.pieces.missing(pieces))
        if new:
            self.pieces.newer.update(zip(new, self.encode_pieces(new)))

    def _cut(self, chunks: list[str]) -> dict[str, list[str]]:
        """Pieces of chunks that follow a space, matched in one go: a piece with a space starts a chunk."""
        if not chunks:
            return {}
        pieces = self.find(" " + " ".join(chunks))
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        return {c: pieces[a:b] for c, a, b in zip(chunks, starts, [*starts[1:], len(pieces)], strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # millions of short strings and no cycles
        try:
            return self._encode(texts) if texts else []
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        self.chunks.turn()
        self.pieces.turn()
        # chunks stay in Arrow arrays: only distinct ones become Python strings
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).copy()
        firsts = [self.find(t.partition(" ")[0]) for t in texts]
        new = self.chunks.missing(set(distinct))
        found = self._cut([c for c in new if c and not c[0].isspace()])
        self._learn(set(chain.from_iterable(found.values())).union(*firsts))
        known, remembered = self.pieces.newer.__getitem__, self.chunks.newer
        remembered.update(dict.fromkeys(new.difference(found)))
        remembered.update(zip(found, [b"".join(map(known, f)) for f in found.values()]))
        # the first chunk of a text has no space in front: its ids stand behind those of the others
        codes[bounds[:-1]] = len(distinct) + np.arange(len(texts))
        ids = pa.array([*map(remembered.__getitem__, distinct), *(b"".join(map(known, f)) for f in firsts)], pa.large_binary())
        unknown = np.logical_or.reduceat(ids.is_null().to_numpy(zero_copy_only=False)[codes], bounds[:-1])
        taken = ids.take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[bounds].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in pairwise(ends)]
        for i in np.flatnonzero(unknown).tolist():  # a chunk that starts with white space
            whole = self.find(texts[i])
            self._learn(set(whole))
            out[i] = b"".join(map(known, whole))
        return out
