"""Exact byte-level BPE token counts of every prefix, by dynamic programming.

For each prefix of a piece the table holds the last token of that prefix's own
encoding. A token t may end prefix i if it is its own encoding and the pair
(last token of prefix i - len(t), t) encodes to itself; exactly one t does. So
count[i] = count[i - len(t)] + 1, and no prefix is ever encoded anew.
"""

from __future__ import annotations

import json

import regex

#: The pre-tokenizer's pattern of the public byte-level vocabulary (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of that pattern: Unicode White_Space, spelled out (fixed value).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts:
    """Token counts of a byte-level BPE file at every prefix of a text."""

    def __init__(self, path: str, keep: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = lambda token: bytes(back[c] for c in token)
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in special) + ")") if special else None
        self.special_strings = special
        #: Tokens, and whether each is its own encoding (None: not asked yet).
        self.vocab: dict[bytes, bool | None] = {raw(t): None for t in spec["model"]["vocab"] if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.spines: dict[bytes, tuple[list, list]] = {}
        self.split = {a + b: (a, b, r) for (a, b), r in reversed(self.merges.items())}
        self.keep, self.pairs, self.tables = keep, {}, {}
        self.pieces = regex.compile(PIECES.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.blank = regex.compile(f"[{SPACE}]+")

    def merge(self, word: bytes) -> list[bytes]:
        """The plain encoding: always join the best-ranked neighbours."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.merges.get((parts[i], parts[i + 1]))) is not None]
            if not ranked:
                break
            rank = min(ranked)[0]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.merges.get((parts[i], parts[i + 1])) == rank:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def edges(self, token: bytes) -> tuple[list, list]:
        """What stands at a token's right and at its left end as its merges go on: (part, rank of the merge that takes it in)."""
        found = self.spines.get(token)
        if found is None:
            found = ([], [])
            for side in (1, 0):
                part, taken = token, len(self.merges)
                while True:
                    found[1 - side].append((part, taken))
                    if part not in self.split:
                        break
                    taken = self.split[part][2]
                    part = self.split[part][side]
                found[1 - side].reverse()
            self.spines[token] = found
        return found

    def ends(self, before: bytes, token: bytes) -> bool:
        """Whether before, token stays as it is when the two are encoded together.

        A part of a token is older than what it is merged into, so the parts at
        the seam are known for every moment: the pair breaks if two that meet
        there merge before either is taken in by its own token (of equal ranks
        the left one goes first).
        """
        if len(self.pairs) > 4 * self.keep:
            self.pairs.clear()
        left, right = self.edges(before)[0], self.edges(token)[1]
        i, j, ok = 0, 0, True
        while ok and i < len(left) and j < len(right):
            (x, gone), (y, lost) = left[i], right[j]
            r = self.merges.get((x, y))
            ok = r is None or r >= gone or r > lost
            if gone <= lost:
                i += 1
            else:
                j += 1
        self.pairs[before, token] = ok
        return ok

    def table(self, piece: bytes) -> list[int]:
        """table[i] is the exact token count of piece[:i]."""
        got = self.tables.get(piece)
        if got is not None:
            return got
        n = len(piece)
        last: list[bytes] = [b""] * (n + 1)
        count = [0] * (n + 1)
        vocab, longest, pairs = self.vocab, self.longest, self.pairs
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = piece[j:i]
                whole = vocab.get(token, False)
                if whole is None:
                    whole = vocab[token] = self.merge(token) == [token]
                if not whole:
                    continue
                if j:
                    before = last[j]
                    ok = pairs.get((before, token))
                    if ok is None:
                        ok = self.ends(before, token)
                    if not ok:
                        continue
                last[i], count[i] = token, count[j] + 1
                break
            else:
                raise ValueError(f"no token of the vocabulary ends {piece[:i]!r}")
        if n <= 64:
            if len(self.tables) > self.keep:
                self.tables.clear()
            self.tables[piece] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; the special strings are one token each."""
        if self.special is not None and any(x in text for x in self.special_strings):
            return sum(1 if i % 2 else self.count(x) for i, x in enumerate(self.special.split(text)))
        return sum(self.table(p.encode())[-1] for p in self.pieces.findall(text))

    def prefixes(self, text: str) -> list[int]:
        """Exact counts of all prefixes of a text, by code points (0 to len)."""
        out = [0]
        parts = self.special.split(text) if self.special is not None else [text]
        done, start = 0, 0
        for i, part in enumerate(parts):
            if i % 2:
                # A special string that is cut is ordinary text after what stands before it.
                head = text[start - len(parts[i - 1]) : start]
                out += [done - self.count(head) + self.count(head + part[:k]) for k in range(1, len(part))]
                done += 1
                out.append(done)
            else:
                out += [done + x for x in self._plain(part)[1:]]
                done = out[-1]
            start += len(part)
        return out

    def _plain(self, text: str) -> list[int]:
        runs = {}  # where a run of white space starts: its end
        for m in self.blank.finditer(text):
            runs[m.start()] = m.end()
        out, done, at, run_end = [0], 0, 0, 0
        for p in self.pieces.findall(text):
            table = self.table(p.encode())
            if at in runs:
                # A prefix that ends in the run has the run so far as its last piece.
                run_end = runs[at]
                self._along(out, done, text[at:run_end], self.table(text[at:run_end].encode()))
            known = max(0, run_end - at)
            if known < len(p):
                if p[0] == "'" and not known:
                    # A contraction that is cut is split otherwise.
                    out += [done + self.count(p[:k]) for k in range(1, len(p) + 1)]
                else:
                    size = len(p[:known].encode())
                    self._along(out, done, p[known:], table, size)
            done += table[-1]
            at += len(p)
        return out

    @staticmethod
    def _along(out: list[int], done: int, part: str, table: list[int], size: int = 0) -> None:
        for c in part:
            size += len(c.encode())
            out.append(done + table[size])
