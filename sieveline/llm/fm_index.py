"""A compressed FM-index over word sequences: wavelet matrix, packed counts, and matching statistics by backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time: 64-bit words, 16-bit counts within blocks of 1,024 words, and a count a block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]
        self.blocks = before[::1024].copy()
        self.within = (before - np.repeat(self.blocks, 1024)[: len(before)]).astype(np.uint16)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[at >> 10] + self.within[at] + np.bitwise_count(self.words[at] & low)

    def nbytes(self) -> int:
        return self.words.nbytes + self.within.nbytes + self.blocks.nbytes


class Packed:
    """Numbers of a fixed number of bits each, in 64-bit words."""

    def __init__(self, numbers: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        n = len(numbers)
        planes = np.empty((n, self.bits), np.uint8)
        for b in range(self.bits):
            planes[:, b] = (numbers >> b) & 1
        packed = np.zeros((n * self.bits // 64 + 2) * 8, np.uint8)
        raw = np.packbits(planes.ravel(), bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] >> shift
        high = np.where(shift > 0, self.words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((low | high) & np.uint64((1 << self.bits) - 1)).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where each symbol's run of the last level stands, moved on by its occurrences before i."""
        for (shift, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Index of many sequences, for matches of up to `length` words.

    codes holds the sequences one after another (codes from 0), starts where each
    begins, and value a number per sequence. Suffixes end at their sequence's end
    and are sorted by `length` words or more. Kept are the wavelet matrix of the
    Burrows-Wheeler transform, for each row how many words (up to `length`) it
    shares with the one above it, and for each class of rows that agree in
    `length` words the least value, as packed numbers; the texts are not.
    """

    #: Rows of a block of the shared counts, for skipping.
    BLOCK = 32

    def __init__(self, codes: np.ndarray, starts: np.ndarray, value: np.ndarray, length: int):
        n_seq, sizes = len(value), np.diff(starts)
        self.length = length
        # Text: each sequence and a separator of its own; separators sort before all words.
        text = np.empty(len(codes) + n_seq, np.int64)
        ends = starts[1:] + np.arange(n_seq)
        word = np.ones(len(text), bool)
        word[ends] = False
        text[word] = codes + n_seq
        text[ends] = np.arange(n_seq)
        self.size = n = len(text)
        order, shared = self._sort(text, length)
        bwt = text[order - 1]
        # Separators are one symbol in the index: no pattern holds any.
        symbols = np.where(bwt >= n_seq, bwt - n_seq + 1, 0)
        self.top = int(symbols.max(initial=0))
        self.wavelet = WaveletMatrix(symbols, self.top)
        counts = np.bincount(symbols, minlength=1)
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        # Where a symbol's run stands in the last level, and where in the suffix order.
        every = np.arange(len(counts))
        self.shift = first - self.wavelet.rank(every, np.zeros(len(counts), np.int64))
        self.pyramid = self._pyramid(np.append(shared, 0).astype(np.uint8))
        # The rows that begin a class of `length` equal words, and each class's least value.
        new = shared < length
        self.begins = Bits(new)
        owner = np.repeat(np.arange(n_seq), sizes + 1)
        self.values, rank = np.unique(value, return_inverse=True)
        least = np.minimum.reduceat(rank[owner][order], np.flatnonzero(new)) if n else rank
        self.least = Packed(least, len(self.values))

    def nbytes(self) -> int:
        """Bytes that the index holds."""
        return sum(b.nbytes() for _, b in self.wavelet.levels) + self.shift.nbytes + sum(p.nbytes for p in self.pyramid) + self.begins.nbytes() + self.least.words.nbytes + self.values.nbytes

    @staticmethod
    def _sort(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes by `length` words or more, and how many (up to `length`) each row shares with the one above it.

        Doubles the sorted depth. The ranks of all depths, halved again from the
        last one, give what two neighbours share, one power of two after another.
        """
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
        ranks, h = [rank], 1
        order = np.argsort(rank, kind="stable")
        while h < length and n:
            ahead = np.zeros(n, np.int64)
            ahead[: n - h] = rank[h:].astype(np.int64) + 1 if h < n else 0
            key = rank.astype(np.int64) * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            step = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
            rank = np.empty(n, np.int32)
            rank[order] = step
            h *= 2
            ranks.append(rank)
        shared = np.zeros(n, np.int64)
        if n:
            a, b = order[1:], order[:-1]
            for k in range(len(ranks) - 1, -1, -1):
                at = shared[1:]
                i, j = np.minimum(a + at, n - 1), np.minimum(b + at, n - 1)
                # Ranks of one depth are equal only where that many words are.
                shared[1:] += np.where((ranks[k][i] == ranks[k][j]) & (a + at < n) & (b + at < n), 1 << k, 0)
        return order, np.minimum(shared, length)

    def _pyramid(self, shared: np.ndarray) -> list[np.ndarray]:
        """shared, and its least numbers by blocks of BLOCK, of those blocks, and so on."""
        out = [shared]
        while len(out[-1]) > self.BLOCK:
            now = out[-1]
            edge = -len(now) % self.BLOCK
            out.append(np.concatenate((now, np.full(edge, 255, np.uint8))).reshape(-1, self.BLOCK).min(axis=1))
        return out

    def _next(self, i: np.ndarray, below: np.ndarray, step: int) -> np.ndarray:
        """From each row on, in steps of 1 or -1, the nearest row that shares less than `below` with the one above it (there always is one)."""
        out = np.empty(len(i), np.int64)
        todo, at, level = np.arange(len(i)), i.copy(), np.zeros(len(i), np.int64)
        while len(todo):
            rest = []
            for k, now in enumerate(self.pyramid):
                own = np.flatnonzero(level == k)
                if not len(own):
                    continue
                t, p = todo[own], at[own]
                block = p // self.BLOCK
                lanes = block[:, None] * self.BLOCK + np.arange(self.BLOCK)[None, :]
                ok = (lanes >= p[:, None] if step > 0 else lanes <= p[:, None]) & (lanes < len(now)) & (now[np.minimum(lanes, len(now) - 1)] < below[t, None])
                hit = ok.any(axis=1)
                pick = ok.argmax(axis=1) if step > 0 else self.BLOCK - 1 - ok[:, ::-1].argmax(axis=1)
                found = block * self.BLOCK + pick
                if k == 0:
                    out[t[hit]] = found[hit]
                else:  # down into the block that holds one
                    rest.append((t[hit], found[hit] * self.BLOCK + (0 if step > 0 else self.BLOCK - 1), np.full(int(hit.sum()), k - 1)))
                rest.append((t[~hit], block[~hit] + step, np.full(int((~hit).sum()), k + 1)))
            todo, at, level = (np.concatenate(x) for x in zip(*rest, strict=True)) if rest else (todo[:0], at[:0], level[:0])
        return out

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of symbol + pattern from those of pattern."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        shift = self.shift[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def _shorter(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that agree with those of a pattern in its first `size` words."""
        return self._next(low, size, -1), self._next(high, size, 1)

    def match(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences, whether or not the index holds them.

        For every place (sequence by sequence, in order) how many words from it
        on, up to `length`, stand in one indexed sequence; and, where those are
        `length`, the least value of the sequences that have them (else -1).
        Codes that no indexed sequence has match nothing. All streams advance
        together from their right ends: a word is put before the pattern, which
        is cut at its end to the longest beginning for which that works.
        """
        size = np.diff(starts)
        many = np.zeros(len(codes), np.int64)
        least = np.full(len(codes), -1, np.int64)
        symbols = np.where((codes >= 0) & (codes < self.top), codes + 1, self.top + 1)
        live = np.flatnonzero(size)
        live = live[np.argsort(-size[live], kind="stable")]
        low, high, have = np.zeros(len(live), np.int64), np.full(len(live), self.size), np.zeros(len(live), np.int64)
        for k in range(1, int(size.max(initial=0)) + 1):
            on = int(np.searchsorted(-size[live], -k, side="right"))  # streams of at least k words
            live, low, high, have = live[:on], low[:on], high[:on], have[:on]
            at = starts[live + 1] - k
            own = symbols[at]
            full = np.flatnonzero(have == self.length)
            if len(full):
                have[full] = self.length - 1
                low[full], high[full] = self._shorter(low[full], high[full], have[full]) if self.length > 1 else (0, self.size)
            todo = np.flatnonzero(own <= self.top)
            gone = np.flatnonzero(own > self.top)
            low[gone], high[gone], have[gone] = 0, self.size, 0
            while len(todo):
                a, b = self.step(own[todo], low[todo], high[todo])
                fits = a < b
                done = todo[fits]
                low[done], high[done], have[done] = a[fits], b[fits], have[done] + 1
                todo = todo[~fits]
                # The parent: the longest beginning of the pattern that more rows have.
                dead = todo[have[todo] == 0]
                todo = todo[have[todo] > 0]
                low[dead], high[dead] = 0, self.size
                if len(todo):
                    shared = self.pyramid[0]
                    have[todo] = np.maximum(shared[low[todo]], shared[high[todo]])
                    root = todo[have[todo] == 0]
                    low[root], high[root] = 0, self.size
                    deep = todo[have[todo] > 0]
                    if len(deep):
                        low[deep], high[deep] = self._shorter(low[deep], high[deep], have[deep])
            many[at] = have
            hit = np.flatnonzero(have == self.length)
            if len(hit):
                least[at[hit]] = self.values[self.least[self.begins.rank(low[hit] + 1) - 1]]
        return many, least
