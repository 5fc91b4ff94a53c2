"""A compressed full-text index over word symbols (FM-index) with vectorised backward search."""

from __future__ import annotations

import io

import numpy as np

SAMPLE = 4  # every fourth text position keeps its suffix-array value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the rotations of a text by prefix doubling. Equal rotations (a periodic text) keep text order."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n or step >= n:
            return order
        step *= 2


class WordIndex:
    """Index over word sequences. ``docs`` are int64 word hashes; ``keys`` name the sequences.

    The text is all sequences, each followed by symbol 0; word hashes become dense symbols from 1.
    Kept: the Burrows-Wheeler transform, every SAMPLE-th suffix-array value, sequence starts, the
    vocabulary and the keys. ``dumps`` packs them with deflate.
    """

    def __init__(self, vocab, bwt, marked, values, starts, keys):
        self.vocab, self.bwt, self.marked, self.values, self.starts, self.keys = vocab, bwt, marked, values, starts, keys
        self.size = len(bwt)
        at = np.argsort(bwt, kind="stable")
        self.occ = bwt[at].astype(np.int64) * self.size + at
        self.before = np.concatenate(([0], np.cumsum(marked)))

    @classmethod
    def build(cls, docs: list[np.ndarray], keys: list[bytes]) -> WordIndex:
        lens = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if len(docs) else np.zeros(0, np.int64)
        vocab = np.unique(flat)
        starts = np.concatenate(([0], np.cumsum(lens + 1)))
        text = np.zeros(starts[-1], np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(docs)), lens)] = np.searchsorted(vocab, flat) + 1
        sa = suffix_array(text)
        bwt = text[sa - 1].astype(np.int32)
        marked = sa % SAMPLE == 0
        return cls(vocab, bwt, marked, sa[marked].astype(np.int32), starts, np.array(keys, object))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(
            out, vocab=self.vocab, bwt=self.bwt, marked=np.packbits(self.marked), values=self.values,
            starts=self.starts, keys=np.frombuffer(b"".join(self.keys), np.uint8),
        )
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> WordIndex:
        z = np.load(io.BytesIO(blob))
        n = len(z["starts"]) - 1
        raw, width = z["keys"].tobytes(), len(z["keys"]) // max(n, 1)
        keys = np.array([raw[i * width : (i + 1) * width] for i in range(n)], object)
        bwt = z["bwt"]
        return cls(z["vocab"], bwt, np.unpackbits(z["marked"], count=len(bwt)).astype(bool), z["values"], z["starts"], keys)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Dense symbols of word hashes; -1 for words the index lacks."""
        if not len(self.vocab):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, -1)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step: the suffixes that have ``symbol`` before those in [lo, hi)."""
        base = symbol * self.size
        return np.searchsorted(self.occ, base + lo), np.searchsorted(self.occ, base + hi)

    def extend_rows(self, symbol: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step per occurrence: (which rows have ``symbol`` before them, their new rows)."""
        ok = self.bwt[rows] == symbol
        return ok, np.searchsorted(self.occ, symbol[ok] * self.size + rows[ok])

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a sampled one."""
        rows, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.marked[r]
            done = todo[hit]
            out[done] = self.values[self.before[rows[done]]] + walked[done]
            todo = todo[~hit]
            r = rows[todo]
            rows[todo] = np.searchsorted(self.occ, self.bwt[r].astype(np.int64) * self.size + r)
            walked[todo] += 1
        return out

    def text(self) -> np.ndarray:
        """The indexed text, restored from the transform by one walk per sampled row."""
        out = np.empty(self.size, np.int32)
        rows = np.flatnonzero(self.marked)
        at = self.values.astype(np.int64)
        live = np.arange(len(rows))
        for _ in range(SAMPLE):
            sym = self.bwt[rows[live]]
            at[live] -= 1
            at[live[at[live] < 0]] += self.size
            out[at[live]] = sym
            rows[live] = np.searchsorted(self.occ, sym.astype(np.int64) * self.size + rows[live])
            live = live[~self.marked[rows[live]]]
            if not len(live):
                break
        return out
