"""Benchmark decontamination: items met again in documents, also with other numbers, names and units.

Words become templates: numbers, names and units turn into typed placeholders.
Windows of the templates, and of the plain words, are joined by hash to those of
the items; a small filter of the items' hashes spares the join what can't match.
Then the slots must agree: within an occurrence of an item, one value of the item
always stands for one value of the document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, Run, batch, fresh, map_texts, spill, table, word_codes
from .substring_dedup import _ODD, _mix, word_hashes

#: Words of a window. Items with fewer words are one window.
WINDOW = 8
#: Items with fewer words than this are met in their own words only.
SHORT = 4
#: Share of an item's windows that must be met with consistent slots.
COVERAGE = 0.5
#: Places of one window, of an item or a text, that go in one row; more take more rows. And pairs of places that are compared at a time.
PLACES, PAIRS = 256, 1 << 17
#: Bits of the filter for each window of the items, and its bounds: it is broadcast, and never over 16 MB.
FILTER_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27

#: Units after a number, and numbers in words (fixed values).
UNITS = ["%", "percent", "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yards", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "gram", "grams", "kg", "kilograms", "lb", "lbs", "pound", "pounds", "oz", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "degrees", "celsius", "fahrenheit", "watt", "watts", "volt", "volts", "kb", "mb", "gb"]
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]

NUMBER, NAME, UNIT, OPENING = 1, 2, 3, 4
#: Placeholders by kind. A word that opens a sentence with a capital may be a name or not: it is one in one template only.
_PLACE = _mix(np.array([0, NUMBER, NAME, UNIT, NAME], np.uint64) * _ODD + np.uint64(77))
_NUMBER = r"[$€£]?\d[\d.,:/]*%?"
_ATTACHED = r"^(?P<n>[$€£]?\d[\d.,:/]*)(?P<u>(?:" + "|".join(sorted((u for u in UNITS if u != "%"), key=len, reverse=True)) + r"))$"


class Templates:
    """The words of many texts in a row: as they are, and what they stand for. A number and a unit written as one word are two."""

    def __init__(self, column: pa.Array):
        starts, codes, words = word_codes(column)
        low = pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}\p{N}%$€£]+|[^\p{L}\p{N}%]+$", "")
        split = pc.extract_regex(low, _ATTACHED)
        two = np.asarray(pc.is_valid(split)) if len(words) else np.zeros(0, bool)
        if two.any():
            # Codes of the units come after those of the words.
            unit = pc.fill_null(pc.struct_field(split, "u"), "").dictionary_encode()
            of = np.asarray(unit.indices, np.int64)
            n_words = len(low)
            own = two[codes]
            places = np.arange(len(codes)) + np.cumsum(own) - own
            wide = np.empty(len(codes) + int(own.sum()), np.int64)
            wide[places] = codes
            wide[places[own] + 1] = n_words + of[codes[own]]
            starts = starts + np.concatenate(([0], np.cumsum(own)))[starts]
            low = pc.if_else(pc.is_valid(split), pc.struct_field(split, "n"), low)
            low = pa.concat_arrays([low.cast(pa.string()), unit.dictionary.cast(pa.string())])
            words = pa.concat_arrays([words.cast(pa.string()), unit.dictionary.cast(pa.string())])
            codes = wide
        self.starts, self.codes, self.low = starts, codes, low
        n = len(codes)
        if not n:
            self.raw = np.zeros(0, np.uint64)
            self.kind = np.zeros(0, np.int8)
            return
        flag = lambda a: np.asarray(pc.fill_null(a, False).cast(pa.int8()), dtype=np.int8)[codes] == 1
        number = flag(pc.or_(pc.match_substring_regex(low, f"^{_NUMBER}$"), pc.is_in(low, pa.array(NUMBERS, low.type))))
        unit = flag(pc.is_in(low, pa.array(UNITS, low.type)))
        capital = flag(pc.match_substring_regex(words, r"^[\"'(\[]*\p{Lu}"))
        ends = flag(pc.match_substring_regex(words, r"[.!?:;|][\"')\]]*$"))
        inner = np.ones(n, bool)  # has a word before it in its text
        inner[starts[:-1][starts[:-1] < n]] = False
        after_number = np.concatenate(([False], number[:-1])) & inner
        opens = np.concatenate(([True], ends[:-1])) | ~inner
        self.kind = np.where(number, NUMBER, np.where(unit & after_number, UNIT, np.where(capital, np.where(opens, OPENING, NAME), 0))).astype(np.int8)
        self.raw = word_hashes(low)[codes]

    def windows(self, size: int) -> list[np.ndarray]:
        """The hash of every window of the row in plain words, as a template, and as one whose opening capitals are names.

        A template that is mostly placeholders, or of fewer than SHORT words, is
        taken in plain words; one that differs in nothing has the same hash.
        """
        n = len(self.raw) - size + 1
        if n <= 0:
            return [np.zeros(0, np.uint64)] * 3
        out = []
        for slots in (np.zeros(len(self.raw), bool), (self.kind > 0) & (self.kind != OPENING), self.kind > 0):
            words = np.where(slots, _PLACE[self.kind], self.raw)
            h = np.full(n, size, np.uint64)
            for k in range(size):
                h = _mix(h * _ODD + words[k : k + n])
            count = np.concatenate(([0], np.cumsum(slots)))
            plain = (2 * (count[size:] - count[:-size]) > size) | (size < SHORT)
            out.append(np.where(plain, out[0], h) if out else h)
        return out

    def inside(self, size: int) -> np.ndarray:
        """Which windows lie within one text."""
        n = len(self.raw) - size + 1
        ok = np.zeros(max(n, 0) + 1, np.int64)
        counts = np.maximum(np.diff(self.starts) - size + 1, 0)
        np.add.at(ok, self.starts[:-1][counts > 0], 1)
        np.add.at(ok, (self.starts[:-1] + counts)[counts > 0], -1)
        return np.cumsum(ok[:-1]) > 0

    def hashes(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, hashes) of the windows of `size` words within one text, each hash once for a place."""
        found, inside = self.windows(size), np.flatnonzero(self.inside(size))
        for k, h in enumerate(found):
            own = inside
            for earlier in found[:k]:
                own = own[h[own] != earlier[own]]
            yield own, h[own]


def _cut(places: list[int]) -> list[list[int]]:
    """Places in order, PLACES at a time."""
    places = sorted(places)
    return [places[k : k + PLACES] for k in range(0, len(places), PLACES)]


def _windows_of_items(items: DataFrame) -> DataFrame:
    """Per distinct window of each item (item, text), PLACES at a time: hash, size, item, total (windows of the item), at (its places), and the kinds and words of all of them in turn."""

    def work(part: pa.RecordBatch):
        t = Templates(part.column("text"))
        words = t.low.to_pylist()
        sizes = np.minimum(np.diff(t.starts), WINDOW)
        rows: list[tuple] = []
        items = part.column("item").to_pylist()
        for size in sorted({int(x) for x in sizes} - {0}):
            found: dict[tuple[int, int], list[int]] = {}
            for places, h in t.hashes(size):
                doc = np.searchsorted(t.starts, places, "right") - 1
                own = sizes[doc] == size
                for p, x, d in zip(places[own].tolist(), h[own].tolist(), doc[own].tolist(), strict=True):
                    found.setdefault((d, x), []).append(p)
            for (d, x), places in found.items():
                base, total = int(t.starts[d]), int(t.starts[d + 1] - t.starts[d]) - size + 1
                for own in _cut(places):
                    inside = [k for p in own for k in range(p, p + size)]
                    rows.append((x, size, items[d], total, [p - base for p in own], t.kind[inside].tolist(), [words[c] for c in t.codes[inside]]))
        kinds = (pa.uint64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.string()))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        named = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield batch(**dict(zip(("hash", "size", "item", "total", "at", "kinds", "words"), [named[0].view(pa.int64()), *named[1:]], strict=True)))

    return map_texts(items, lambda: work, "hash long, size int, item long, total long, at array<bigint>, kinds array<tinyint>, words array<string>")


class Filter:
    """Which hashes may be among the items' windows: a Bloom filter of three bits a hash."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def spots(h: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        return [(h >> np.uint64(s)) & mask for s in (0, 17, 34)]

    def maybe(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for at in self.spots(h, self.mask):
            ok &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def build_filter(windows: DataFrame, n: int) -> Filter:
    """The filter of the windows' hashes, of FILTER_BITS for each within its bounds: made in the tasks, joined by OR."""
    bits = min(max(1 << (FILTER_BITS * max(n, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    mask = np.uint64(bits - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for part in batches:
            for at in Filter.spots(np.asarray(part.column("hash")).view(np.uint64), mask):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield batch(i=pa.array(used), w=pa.array(words[used].view(np.int64)))

    out = np.zeros(bits // 64, np.uint64)
    for i, w in windows.select("hash").mapInArrow(fill, "i long, w long").groupBy("i").agg(F.bit_or("w")).collect():  # bits / 64 rows at most
        out[i] = np.int64(w).view(np.uint64)
    return Filter(out)


def _candidates(docs: DataFrame, sizes: list[int], may: Filter) -> DataFrame:
    """The windows of documents that the filter lets through, PLACES of an equal hash at a time: hash, size, rid, doc_id, place (their places), and the words of all of them in turn."""
    sent = docs.sparkSession.sparkContext.broadcast(may)

    def make():
        found = sent.value

        def work(part: pa.RecordBatch):
            t = Templates(part.column("text"))
            words = None
            rows: list[tuple] = []
            rids, ids = part.column("rid"), part.column("doc_id")
            for size in sizes:
                own: dict[tuple[int, int], list[int]] = {}
                for places, h in t.hashes(size):
                    near = found.maybe(h)
                    if not near.any():
                        continue
                    words = t.low.to_pylist() if words is None else words
                    places, h = places[near], h[near]
                    doc = np.searchsorted(t.starts, places, "right") - 1
                    for p, x, d in zip(places.tolist(), h.tolist(), doc.tolist(), strict=True):
                        own.setdefault((d, x), []).append(p)
                for (d, x), places in own.items():
                    base, rid, id_ = int(t.starts[d]), rids[d].as_py(), ids[d].as_py()
                    for part_of in _cut(places):
                        rows.append((x, size, rid, id_, [p - base for p in part_of], [words[c] for p in part_of for c in t.codes[p : p + size]]))
            kinds = (pa.uint64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            named = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield batch(**dict(zip(("hash", "size", "rid", "doc_id", "place", "found"), [named[0].view(pa.int64()), *named[1:]], strict=True)))

        return work

    return map_texts(docs, make, "hash long, size int, rid long, doc_id long, place array<bigint>, found array<string>")


class Meeting:
    """The places (at, place) at which an item and a text have equal windows: all with all of each row, never held at once.

    A row has places of the item and of the text, in order; kinds, own and found
    are of the words of all windows in turn, as codes into names. kind and own of
    the object are those of each word of the item, word that of each of the text
    from `base` on.
    """

    def __init__(self, at: list[np.ndarray], place: list[np.ndarray], kinds: np.ndarray, own: np.ndarray, found: np.ndarray, names: list[str]):
        self.at, self.place, self.names = at, place, names
        every, there = np.concatenate(at), np.concatenate(place)
        self.size = len(own) // len(every)
        self.inside = np.arange(self.size)
        self.length, self.base = int(every.max()) + self.size, int(there.min())
        self.kind, self.own = np.zeros(self.length, np.int64), np.full(self.length, -1, np.int64)
        self.kind[every[:, None] + self.inside] = np.where(kinds == OPENING, NAME, kinds).reshape(-1, self.size)
        self.own[every[:, None] + self.inside] = own.reshape(-1, self.size)
        self.word = np.full(int(there.max()) - self.base + self.size, -1, np.int64)
        self.word[there[:, None] - self.base + self.inside] = found.reshape(-1, self.size)
        self.many = sum(len(a) * len(p) for a, p in zip(at, place, strict=True))

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """All (at, place) whose distance place - at is from lo to hi - 1, by distance."""
        ats, places = [], []
        for at, place in zip(self.at, self.place, strict=True):
            first = np.searchsorted(place, at + lo)
            n = np.searchsorted(place, at + hi) - first
            ats.append(np.repeat(at, n))
            places.append(place[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
        at, place = np.concatenate(ats), np.concatenate(places)
        order = np.argsort(place - at, kind="stable")
        return at[order], place[order]

    def occurrences(self) -> Iterator[list]:
        """Pairs by occurrence of the item: as long as the distance of their places moves by less than half the item (8 words at most) at a time.

        An occurrence is a list of its pairs, or of the bounds of distances that hold about PAIRS of them.
        """
        near = min(WINDOW, max(1, self.length // 2))
        least = self.base - self.length

        def split(lo: int, hi: int) -> Iterator[list]:
            at, place = self.pairs(lo, hi)
            turn = np.flatnonzero(np.diff(place - at) >= near) + 1
            yield from ([x] for x in zip(np.split(at, turn), np.split(place, turn), strict=True))

        if self.many <= PAIRS:
            yield from split(least, self.base + len(self.word))
            return
        count = np.zeros(self.length + len(self.word) + 1, np.int64)  # pairs of each distance, from least on
        for at, place in zip(self.at, self.place, strict=True):
            if len(at) <= len(place):
                for a in at:
                    count[place - a - least] += 1
            else:
                for p in place:
                    count[p - at - least] += 1
        there = np.flatnonzero(count)
        ends = np.concatenate((np.flatnonzero(np.diff(there) >= near) + 1, [len(there)]))
        so_far = np.concatenate(([0], np.cumsum(count[there])))
        begin = 0
        while begin < len(there):
            end = ends[np.searchsorted(ends, begin, side="right")]  # of one occurrence, or of as many as hold PAIRS
            end = max(end, ends[max(0, np.searchsorted(so_far[ends], so_far[begin] + PAIRS, side="right") - 1)])
            lo, hi = int(there[begin]) + least, int(there[end - 1]) + least + 1
            if so_far[end] - so_far[begin] <= PAIRS:
                yield from split(lo, hi)
            else:
                own = there[begin:end]
                turn = np.flatnonzero(np.diff(np.cumsum(count[own]) // PAIRS)) + 1
                yield [(int(x[0]) + least, int(x[-1]) + least + 1) for x in np.split(own, turn)]
            begin = end

    def consistent(self, parts: list) -> tuple[int, bool]:
        """How many windows of the item an occurrence meets with slots that agree, and whether a slot differs.

        A word's value is read as what most often stands for it, one for one.
        """
        each = lambda: (x if isinstance(x[0], np.ndarray) else self.pairs(*x) for x in parts)
        n, wide = len(self.names), len(self.word)
        stands: Counter = Counter()
        for at, place in each():  # parts differ in the distance, so none has a spot of another
            i = at[:, None] + self.inside
            slots = self.kind[i] > 0
            if slots.any():
                i, j = i[slots], (place[:, None] - self.base + self.inside)[slots]
                i, j = np.divmod(np.unique(i * wide + j), wide)
                found, times = np.unique((self.kind[i] * n + self.own[i]) * n + self.word[j], return_counts=True)
                stands.update(dict(zip(found.tolist(), times.tolist(), strict=True)))
        votes = [(c // n // n, self.names[c // n % n], self.names[c % n], c) for c in stands]
        of: dict = {}
        taken = set()
        for kind, _, _, c in sorted(votes, key=lambda x: (-stands[x[3]], x[1] != x[2], x)):
            if c // n not in of and (kind, c % n) not in taken:
                of[c // n] = c % n
                taken.add((kind, c % n))
        want = self.own.copy()
        slots = np.flatnonzero(self.kind)
        want[slots] = [of.get(x, -2) for x in (self.kind[slots] * n + self.own[slots]).tolist()]
        met, differs = np.zeros(self.length, bool), False
        for at, place in each():
            i, word = at[:, None] + self.inside, self.word[place[:, None] - self.base + self.inside]
            same = (word == self.own[i]).all(axis=1)  # in the item's own words
            read = (word == want[i]).all(axis=1)
            met[at[same | read]] = True
            differs |= bool((read & ~same).any())
        return int(met.sum()), differs

    def best(self) -> tuple[int, bool]:
        """consistent() of the occurrence that meets most."""
        found = (0, True)
        for parts in self.occurrences():
            if not isinstance(parts[0][0], np.ndarray) or len(parts[0][0]) >= found[0]:  # fewer pairs meet fewer windows
                found = max(found, self.consistent(parts), key=lambda x: (x[0], not x[1]))
        return found


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meeting.best() of each (rid, item), from joined windows in that order."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        """For whole (rid, item)."""
        rid, item, doc, total = (np.asarray(rows.column(c)) if c != "doc_id" else rows.column(c).to_pylist() for c in ("rid", "item", "doc_id", "total"))
        begin = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (item[1:] != item[:-1]))))
        end = np.append(begin[1:], len(rid))
        lists = {c: rows.column(c).combine_chunks() for c in ("at", "place", "kinds", "words", "found")}
        bounds = {c: np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(x), dtype=np.int64)))) for c, x in lists.items()}
        flat = {c: np.asarray(lists[c].flatten()) for c in ("at", "place", "kinds")}
        coded = pa.concat_arrays([lists["words"].flatten(), lists["found"].flatten()]).dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        flat["words"], flat["found"] = np.split(codes, [bounds["words"][-1]])
        whole = lambda c, a, b: flat[c][bounds[c][a] : bounds[c][b]]
        out = []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            at, place = (np.split(whole(c, a, b), bounds[c][a + 1 : b] - bounds[c][a]) for c in ("at", "place"))
            meeting = Meeting(at, place, whole("kinds", a, b), whole("words", a, b), whole("found", a, b), names)
            out.append((doc[a], int(item[a]), int(total[a]), *meeting.best()))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return batch(**{c: pa.array(x, k) for c, x, k in zip(("doc_id", "item", "n_windows", "n_met", "reparameterised"), cols, kinds, strict=True)})

    held: list[pa.RecordBatch] = []
    last = lambda x, k: (x.column("rid")[k].as_py(), x.column("item")[k].as_py())
    for part in batches:
        if not part.num_rows:
            continue
        held.append(part)
        if last(held[0], 0) == last(part, part.num_rows - 1):
            continue  # it may go on
        rows = pa.Table.from_batches(held)
        rid, item = (np.asarray(part.column(c)) for c in ("rid", "item"))
        open_ = int(((rid == rid[-1]) & (item == item[-1])).sum())  # the last one may, too
        yield judged(rows.slice(0, rows.num_rows - open_))
        held = [part.slice(part.num_rows - open_)]
    if held:
        yield judged(pa.Table.from_batches(held))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents (doc_id, text) that hold benchmark items (item_id, text), a row for each such pair.

    Returns doc_id, item_id, n_windows (of the item), n_met (met in the best
    occurrence with consistent slots, coverage or more of them) and reparameterised (a slot
    has another value than in the item). Windows have 8 words, an item with fewer
    is one window; one with fewer than 4 words must be met in its own words.
    Null texts, empty ones and items without words have no windows. Null ids are
    carried. Repeated rows of docs give repeated results, repeated rows of the
    benchmark do not; an empty table on either side gives an empty result.
    """
    with Run(docs.sparkSession) as run:
        named = benchmark.select("item_id", "text").where("text IS NOT NULL").dropDuplicates()
        # Items of one text are looked for once.
        items = spill(named.withColumn("item", F.xxhash64("text")), "leak-items")
        windows = spill(_windows_of_items(items.dropDuplicates(["item"]).select("item", "text")), "leak-windows")
        sizes = windows.groupBy("size").agg(F.sum(F.size("at"))).collect()  # WINDOW rows at most
        n_windows = sum(n for _, n in sizes)
        may = build_filter(windows, n_windows)
        rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
        near = spill(_candidates(rows, sorted(s for s, _ in sizes), may), "leak-candidates")
        # Equal windows of an item and a text are one row, whatever their number; all of their pairs are judged.
        # Few windows are sent to all tasks; many are shuffled by their hash.
        met = near.join(windows.drop("size").hint("broadcast" if n_windows <= MOST_BROADCAST else "shuffle_hash"), "hash")
        met = met.select("rid", "item", "doc_id", "total", "at", "place", "kinds", "words", "found")
        judged = met.repartition("rid", "item").sortWithinPartitions("rid", "item").mapInArrow(_judge, "doc_id long, item long, n_windows long, n_met long, reparameterised boolean")
        judged = spill(judged.where(F.col("n_met") >= coverage * F.col("n_windows")), "leak-judged")
        ids = spill(items.select("item", "item_id"), "leak-ids")
        run.keep(judged, ids)
    return judged.join(ids, "item").select("doc_id", "item_id", "n_windows", "n_met", "reparameterised")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (with any columns) without the documents that hold a benchmark item; rows with a null doc_id are matched by text."""
    own = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    (id_,) = fresh(docs, "id")
    leaks = find_leaks(docs.select(own.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(leaks, own == F.col(id_), "left_anti")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_template_decontamination": op2_template_decontamination}
