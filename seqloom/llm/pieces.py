"""Ids of whole texts from ids of their distinct pieces.

Byte-level pre-tokens never reach over a space that follows anything but white space, and what they are depends on nothing
before such a space. So a text may be cut there, equal pieces be encoded once, and the pieces' ids be laid end to end: the same
ids as for the whole text. Cutting, finding equal pieces and laying out are Arrow and numpy calls; Python sees each distinct
piece of a batch at most once. Texts with white space in front of a space, or at their end, or with one of the ``added`` tokens
in them, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Runs = tuple[np.ndarray, np.ndarray]  # ids end to end, and how many each piece has
#: White space that no piece may hold, so that encoders can use it between pieces.
MARK = "\x0c"
#: White space before a space or at the end: there a piece would not start or end where a pre-token does.
SPACED = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}](?: |\z)|\x0C"
KNOWN = 500_000


def gathered(values: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + width]`` one after another."""
    shift = np.repeat(start - (np.cumsum(width) - width), width)
    return values[shift + np.arange(len(shift))]


class Pieces:
    """``whole`` encodes texts; ``after_space`` encodes pieces that follow a space (which they are given without).

    The first KNOWN pieces met are remembered: a table from text to number, and flat arrays of their ids end to end, where
    each starts and how many it has. The table grows with the pieces; nothing is rebuilt from batch to batch.
    """

    def __init__(self, whole: Callable[[list[str]], Runs], after_space: Callable[[list[str]], Runs], limit: int = KNOWN, added: Sequence[str] = ()):
        self.whole, self.after_space, self.limit, self.added = whole, after_space, limit, added
        self.known: dict[str, int] = {}
        self.pool, self.start, self.width = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _placed(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each piece's ids start in it and how many they are."""
        codes = np.fromiter((self.known.get(p, -1) for p in distinct), np.int64, len(distinct))
        new = np.flatnonzero(codes < 0)
        if not len(new):
            return self.pool, self.start[codes], self.width[codes]
        missing = [distinct[k] for k in new]
        ids, each = self.after_space(missing)
        pool = np.concatenate((self.pool, ids))
        start = np.concatenate((self.start, np.cumsum(each) - each + len(self.pool)))
        width = np.concatenate((self.width, each))
        codes[new] = len(self.known) + np.arange(len(new))
        if len(self.known) < self.limit:
            self.known.update(zip(missing, codes[new].tolist(), strict=True))
            self.pool, self.start, self.width = pool, start, width
        return pool, start[codes], width[codes]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        rest, plain = np.flatnonzero(odd), np.flatnonzero(~odd)
        if len(rest):
            ids, each = self.whole(texts.take(pa.array(rest)).to_pylist())
            for at, x in zip(rest, np.split(ids, np.cumsum(each)[:-1]), strict=True):
                out[at] = x
        if len(plain):
            cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
            pieces, offsets = cut.flatten(), np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py()
            first = np.zeros(len(pieces), bool)
            first[offsets[:-1]] = True
            start, width = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
            flat, width[first] = self.whole(pieces.filter(pa.array(first)).to_pylist())
            start[first] = np.cumsum(width[first]) - width[first]
            if not first.all():
                coded = pieces.filter(pa.array(~first)).dictionary_encode()
                pool, at, each = self._placed(coded.dictionary.to_pylist())
                codes = coded.indices.to_numpy()
                start[~first], width[~first] = at[codes] + len(flat), each[codes]
                flat = np.concatenate((flat, pool))
            ids = gathered(flat, start, width)
            bounds = np.concatenate(([0], np.cumsum(width)))[offsets]
            for k, at in enumerate(plain):
                out[at] = ids[bounds[k] : bounds[k + 1]]
        return out
