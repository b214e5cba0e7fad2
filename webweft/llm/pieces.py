"""A worker's memory of text pieces and their token ids, for the tokenising operators."""

from __future__ import annotations

import numpy as np

# Pieces that a worker keeps; further ones are learnt for one batch.
KEPT = 400_000


def gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[first : first + size]`` one after the other, and their sizes."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))], sizes


class PieceStore:
    """Pieces and their ids in two growing arrays.  ``learn`` of a subclass keeps new pieces."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.ids_of, self.first = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        raise NotImplementedError

    def keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append new pieces and their ids, which follow one another."""
        known, used = len(self.code), int(self.first[len(self.code)])
        while used + len(ids) > len(self.ids_of):
            self.ids_of = np.concatenate([self.ids_of, np.zeros_like(self.ids_of)])
        while known + len(pieces) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids_of[used:used + len(ids)] = ids
        self.first[known + 1:known + 1 + len(pieces)] = used + np.cumsum(sizes)
        self.code.update(zip(pieces, range(known, known + len(pieces))))

    def ids_at(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, one after the other, and their sizes."""
        return gathered(self.ids_of, self.first[codes], self.first[codes + 1] - self.first[codes])

    def codes_of(self, pieces: list[str]) -> np.ndarray:
        """Places of pieces, valid until the next call; unknown pieces are learnt."""
        while len(self.code) > KEPT:  # the pieces learnt last
            self.code.popitem()
        codes = list(map(self.code.get, pieces))
        if None in codes:
            missing = [i for i, c in enumerate(codes) if c is None]
            self.learn([pieces[i] for i in missing])
            for i in missing:
                codes[i] = self.code[pieces[i]]
        return np.array(codes, dtype=np.int64)
