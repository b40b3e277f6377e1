import collections
import random
import re
import zlib

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import common, decontamination, packing, registry, sharding, toxicity, trees
from sieveline.llm.common import Run

from .cases import awkward, documents

public = pytest.importorskip("public_tokenizers")


def test_shards_are_gapless_and_near_equal(spark):
    rows = awkward() + [(1000 + k, "copy " * 40) for k in range(300)]
    df = documents(spark, rows, extra=True).drop("shard", "slot")
    out = sharding.shard_by_bytes(df, shards=5, cell_bytes=30_000).collect()
    assert len(out) == len(rows) and collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += len((r.text or "").encode()) + 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(len((t or "").encode()) for _, t in rows) + 8
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    copies = {r.shard for r in out if r.doc_id and r.doc_id >= 1000}
    assert max(copies) - min(copies) + 1 == len(copies)


def test_shards_of_small_rows_are_equal_to_a_row(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randrange(20) if k % 3 else "hot") for k in range(4000)]
    out = sharding.shard_by_bytes(documents(spark, rows), shards=8).selectExpr("shard", "octet_length(text) + 8 AS n").groupBy("shard").sum("n").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 28


def test_shards_of_no_rows_and_equal_rows(spark):
    assert sharding.shard_by_bytes(documents(spark).where("false"), 3).count() == 0
    same = documents(spark, [(None, None)] * 9)
    out = sharding.shard_by_bytes(same, 3).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(k, j) for k in range(3) for j in range(3)]


@pytest.mark.parametrize("m", [2, 20, 2000])
def test_groups_of_repeated_rows_are_cut(spark, m):
    rng = random.Random(m)
    rows = [(k, "x" * rng.randrange(20)) for k in range(m)] + [(None, "hot text")] * m + [(3, "hot too")] * m
    out = sharding.shard_by_bytes(documents(spark, rows), shards=4, cell_bytes=4000).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    sizes, slots, texts = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        sizes[r.shard] += len(r.text) + 8
        slots[r.shard].append(r.slot)
        texts[r.text].add(r.shard)
    assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 2 * 28 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(max(x) - min(x) + 1 == len(x) for x in texts.values())


def test_word_ids_equal_the_tokenizer():
    import pyarrow as pa

    path = public.path("word_bpe_49k.json")
    own, library = packing.WordIds(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    parts = [*"abcdefghiABC  \n\t'123!?.,\x1c\x85\xa0　éßñİΣσ中😀é½", "'s", "'re", "the ", "ing", "<|endoftext|>", "  \n", "word, ", "(Ärger) "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    assert [x.tolist() for x in own.encode(pa.array([*texts, None]))] == [library.encode(x, add_special_tokens=False).ids for x in texts] + [[]]


def test_pieces_round_trip(spark):
    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = awkward()
    got = collections.defaultdict(list)
    for r in packing.token_pieces(documents(spark, rows), path, with_ids=True).collect():
        assert r.length == len(r.ids) and 1 <= r.length <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id].append((r.piece, r.start, r.ids))
    for d, t in rows:
        if [x for x, _ in rows].count(d) == 1:
            whole = library.encode(t or "", add_special_tokens=False).ids + [0]
            assert [i for _, _, ids in sorted(got[d]) for i in ids] == whole
            assert [s for _, s, _ in sorted(got[d])] == list(range(0, len(whole), 2048))


def test_packing_places_every_piece_once(spark):
    rng = random.Random(2)
    rows = [(k, 0, rng.choice([1, 5, 700, 2048, 1024, rng.randrange(1, 2049)]), "x") for k in range(3000)] + [(None, None, 3, "x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _rank string")
    out = packing.pack(df, rows_per_bucket=10).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r._rank) for r in out) == collections.Counter(rows)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    size = [r[2] for r in rows]
    bound = 0  # of Martello and Toth: items over half a bin, and what their room can't take of the others
    for k in range(1, 1025):
        alone, half, rest = sum(s > 2048 - k for s in size), [s for s in size if 1024 < s <= 2048 - k], sum(s for s in size if k <= s <= 1024)
        bound = max(bound, alone + len(half) + max(0, -(-(rest - sum(2048 - s for s in half)) // 2048)))
    fitted: list[int] = []  # plain first-fit decreasing
    for s in sorted(size, reverse=True):
        k = next((i for i, room in enumerate(fitted) if room >= s), None)
        if k is None:
            fitted.append(2048 - s)
        else:
            fitted[k] -= s
    assert bound <= len(bins) <= len(fitted)
    assert packing.pack(df.where("false")).count() == 0


def test_reduction_and_best_fit_against_the_least_number_of_bins():
    def least(items, room):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= room and bins[j] not in bins[:j]:
                    go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    rng, more, threes = random.Random(3), 0, 0
    for turn in range(1200):
        room = rng.choice([10, 20, 30])
        low = 1 if turn % 2 else room // 5
        count = collections.Counter(rng.randrange(low, room + 1 if turn % 3 else room * 2 // 3) for _ in range(rng.randrange(1, 10)))
        rest = collections.Counter(count)
        found = packing.reduce_by_dominance(rest, room)
        assert all(sum(sizes) <= room for _, sizes in found)
        threes += sum(len(sizes) == 3 for _, sizes in found)
        fixed = sum(n for n, _ in found)
        want = least(sorted(count.elements(), reverse=True), room)
        assert fixed + least(sorted(rest.elements(), reverse=True), room) == want
        more += sum(n for n, _ in packing.plan(count, room)) - want
    assert more <= 12 and threes > 100


def test_leaks_literal_and_reparameterised(spark):
    question = "A train leaves Boston at 60 mph and travels toward Denver for 3 hours before Boston calls it back."
    other = question.replace("Boston", "Paris").replace("60", "85").replace("3 hours", "seven hours")
    mixed = "A train leaves Paris at 80 mph and travels toward Madrid for 5 hours before Lyon calls it back, unlike Rome."
    rows = [(1, "Words before. " + question + " And after."), (2, other), (3, question.upper()), (4, None), (5, ""), (6, "Nothing to see in this text, which is clean and long enough."), (None, question), (2, other), (7, "x " * 20_000 + question), (8, mixed)]
    items = [(7, question), (7, question), (8, None), (9, "too short"), (10, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, "Some item without an id that nobody copied anywhere at all.")]
    docs = documents(spark, rows, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_leaks(docs, bench).collect()
    got = collections.Counter((r.doc_id, r.item_id, r.reparameterised) for r in out if r.doc_id != 8)
    assert got == collections.Counter([(1, 7, False), (2, 7, True), (2, 7, True), (3, 7, False), (None, 7, False), (7, 7, False)])
    full = next(r for r in out if r.doc_id == 2)
    assert all(r.n_met < full.n_met for r in out if r.doc_id == 8)  # one name for two of the item
    left = decontamination.remove_leaks(docs, bench)
    assert left.columns == docs.columns and {4, 5, 6} <= {r.doc_id for r in left.collect()} and not {1, 2, 3, 7, None} & {r.doc_id for r in left.collect()}
    assert decontamination.find_leaks(docs.where("false"), bench).count() == decontamination.find_leaks(docs, bench.where("false")).count() == 0


def plain_leaks(rows, items, share=0.5):
    """The docstring of find_leaks, pair by pair, on words."""
    units = "|".join(sorted((u for u in decontamination.UNITS if u != "%"), key=len, reverse=True))

    def read(text):
        out, before, opens = [], "", True
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            low = regex.sub(r"^[^\p{L}\p{N}%$€£]+|[^\p{L}\p{N}%]+$", "", word.lower())
            two = re.fullmatch(rf"([$€£]?\d[\d.,:/]*)({units})", low)
            for part in two.groups() if two else (low,):
                if re.fullmatch(r"[$€£]?\d[\d.,:/]*%?", part) or part in decontamination.NUMBERS:
                    kind = "number"
                elif part in decontamination.UNITS and before == "number":
                    kind = "unit"
                elif not two and regex.match(r"[\"'(\[]*\p{Lu}", word):
                    kind = "opening" if opens else "name"
                else:
                    kind = ""
                out.append((part, kind))
                before = kind
            opens = bool(re.search(r"[.!?:;|][\"')\]]*$", word))
        return out

    def templates(window):
        plain = [w for w, _ in window]
        out = {tuple(plain)}
        for slots in (("number", "unit", "name"), ("number", "unit", "name", "opening")):
            if len(window) >= 4 and 2 * sum(k in slots for _, k in window) <= len(window):
                out.add(tuple({"opening": "name"}.get(k, k).upper() if k in slots else w for w, k in window))
        return out

    found = collections.Counter()
    for doc, text in rows:
        d = read(text)
        for item, question in {(i, q) for i, q in items if q is not None}:
            q = read(question)
            size = min(8, len(q))
            if not size:
                continue
            kinds = [{"opening": "name"}.get(k, k) for _, k in q]
            pairs = [(p - a, a, p) for a in range(len(q) - size + 1) for p in range(len(d) - size + 1) if templates(q[a : a + size]) & templates(d[p : p + size])]
            pairs.sort()
            if not pairs:
                continue
            near = min(8, max(1, (max(a for _, a, _ in pairs) + size) // 2))
            runs = [[pairs[0]]]
            for x, y in zip(pairs, pairs[1:]):
                if y[0] - x[0] >= near:
                    runs.append([])
                runs[-1].append(y)
            scores = []
            for run in runs:
                votes = collections.Counter((kinds[i], q[i][0], d[j][0]) for i, j in {(a + k, p + k) for _, a, p in run for k in range(size)} if kinds[i])
                of, taken = {}, set()
                for (kind, x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0][1] != v[0][2], v[0])):
                    if (kind, x) not in of and (kind, y) not in taken:
                        of[kind, x] = y
                        taken.add((kind, y))
                met, other = set(), False
                for _, a, p in run:
                    both = [(kinds[a + k], q[a + k][0], d[p + k][0]) for k in range(size)]
                    if all(x == y for _, x, y in both):
                        met.add(a)
                    elif all(of.get((kind, x)) == y if kind else x == y for kind, x, y in both):
                        met.add(a)
                        other = True
                scores.append((len(met), not other))
            n, same = max(scores)
            if n >= share * (len(q) - size + 1):
                found[doc, item, len(q) - size + 1, n, not same] += 1
    return found


NAMES = ["Alice", "Bob", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas"]
SHAPES = [
    "{a} has {x} apples and buys {y}km of rope from {b} for the garden near the lake.",
    "If {a} walks {x} miles per day and {b} walks {y} miles per day, who arrives first at the old mill?",
    "{a} sold {x}kg of flour. {b} sold {y}kg more. How much flour did they sell in all at the market?",
    "The train of {a} leaves at {x} and meets the slow bus of {b} after {y} hours on the northern road.",
]


def questions(rng):
    items = []
    for k in range(24):
        shape = rng.choice(SHAPES) + f" Give the answer in form {chr(97 + k)}{chr(97 + k)} of the sheet."
        items.append(lambda rng, shape=shape: shape.format(**dict(zip("ab", rng.sample(NAMES, 2), strict=True)), x=rng.randrange(2, 99), y=rng.randrange(100, 999)))
    return items


@pytest.mark.parametrize("most", [0, 100_000])
def test_leaks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    rng = random.Random(21)
    shapes = questions(rng)
    items = [(k, f(rng)) for k, f in enumerate(shapes)] + [(90, "Forty two."), (91, "seven kites"), (92, "ok"), (93, "? !"), (94, "echo " * 30)]
    fill = lambda n: " ".join(rng.choice(["some", "words", "Here", "and", "there.", "ok,", "7", "km", "5km", "the", "Bob"]) for _ in range(n))
    rows = [(k, " ".join([fill(rng.randrange(20)), *[rng.choice(shapes)(rng) for _ in range(rng.randrange(3))], fill(rng.randrange(20))])) for k in range(40)]
    rows += [(100 + k, f"{fill(9)} {t.upper() if k % 2 else t} {fill(9)}") for k, (_, t) in enumerate(items)] + [(None, items[0][1]), (3, rows[3][1]), (200, None), (201, ""), (202, "echo " * 50)]
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = collections.Counter(map(tuple, decontamination.find_leaks(documents(spark, rows, extra=True), bench).collect()))
    assert got == plain_leaks(rows, items) and {i for _, i, *_ in got} >= {*range(24), 90, 91, 92, 94}


def test_recall_and_precision_of_reparameterised_items(spark):
    """Copies with other names, numbers and units, one to three in a document, against documents that hold none or mix values."""
    rng = random.Random(22)
    shapes = questions(rng)
    items = [(k, f(rng)) for k, f in enumerate(shapes)]
    fill = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, want = [], set()
    for k in range(300):
        held = rng.sample(range(24), 1) * rng.randrange(1, 4) if k % 3 else []
        rows.append((k, " ".join([fill(30), *[f"{shapes[i](rng)} {fill(rng.randrange(3))}" for i in held], fill(20)])))
        want |= {(k, i) for i in held}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # Items of one shape differ only in their last words, so a document may hold several; those are no mistakes.
    alike = lambda i, j: items[i][1].split()[-12] == items[j][1].split()[-12] and len(items[i][1].split()) == len(items[j][1].split())
    wrong = {(d, i) for d, i in got - want if not any(alike(i, j) for e, j in want if e == d)}
    assert len(got & want) >= 0.95 * len(want) and len(wrong) <= 0.05 * len(got)


def test_windows_that_an_item_holds_very_often_are_all_paired(spark, tmp_path):
    """A list of 80 alike lines: copies with other numbers, behind alike lines of their own or without the first lines."""
    import corpus_pipeline

    rng = random.Random(23)
    values = [rng.randrange(10, 15) for _ in range(80)]
    lines = lambda own: " ".join(f"row {v} then" for v in own)
    other = [v + 50 for v in values]
    texts = [lines(values), lines(other), f"{lines([31, 32, 33])} and on. {lines(other)}", lines(other[25:]), lines([rng.randrange(10, 99) for _ in values]), "Nothing here is like any of the lines, however often it is read."]
    rows, items = list(enumerate(texts)), [(1, lines(values)), (2, "echo " * 100)]
    rows += [(20, "echo " * 50 + " pause here " + "echo " * 90), (21, "echo " * 45)]
    docs, bench = documents(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter(map(tuple, decontamination.find_leaks(docs, bench).collect()))
    assert got == plain_leaks(rows, items) and {(d, i) for d, i, *_ in got} >= {(0, 1), (1, 1), (2, 1), (3, 1), (20, 2)}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()}
    assert left == set(dict(rows)) - {d for d, *_ in got} and 5 in left


@pytest.mark.parametrize("distinct", [0, 3])
def test_pairs_of_places_in_parts_are_judged_alike(monkeypatch, distinct):
    """Equal windows in rows of a few places, compared a few at a time."""
    n, m = 40, 150
    rng = np.random.default_rng(24)
    item, text = np.arange(n) % 4, np.arange(m) % 4
    kinds = np.zeros(n, np.int8)
    if distinct:
        kinds[::4] = 1
        item[::4] = 4 + rng.integers(distinct, size=10)
        text[::4] = 7 + rng.integers(distinct, size=38)
        text[80:120:4] = item[::4] + 3  # a copy with other values
    inside = lambda own, of: np.concatenate([of[k : k + 8] for x in own for k in x])
    found = []
    for pairs, cut in ((1 << 17, 1000), (1, 1000), (30, 7)):
        monkeypatch.setattr(decontamination, "PAIRS", pairs)
        monkeypatch.setattr(decontamination, "PLACES", cut)
        ats, places = [], []
        for c in range(4):
            for a in decontamination._cut(list(range(c, n - 7, 4))):
                for p in decontamination._cut(list(range(c, m - 7, 4))):
                    ats.append(np.array(a))
                    places.append(np.array(p))
        meeting = decontamination.Meeting(ats, places, inside(ats, kinds), inside(ats, item), inside(places, text), [f"w{k}" for k in range(10)])
        found.append(meeting.best())
    assert found == [(33, distinct > 0)] * 3


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    p = 1 / (1 + np.exp(-(3 * (x[:, 0] > 0.5) + 2 * x[:, 1] * (x[:, 2] > 0) - 1.5)))
    y = (rng.random(3000) < p).astype(float)
    model = trees.BoostedTrees().fit(x[:2000], y[:2000])
    curve = trees.Isotonic().fit(model.margin(x[2000:]), y[2000:])
    assert np.abs(curve(model.margin(x)) - p).mean() < 0.12
    margins = np.sort(rng.normal(size=50))
    assert (np.diff(curve(margins)) >= 0).all()
    assert trees.BoostedTrees().fit(x[:0], y[:0]).margin(x[:3]).shape == (3,)


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = random.Random(8)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["blargh", "snorf", "sn0rf", "you", "grumplike###"])
            w.append("blargh")
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5001, ""), (None, "blargh snorf you")]
    labels += [(3, 1, None), (None, 1, 1), (99_999, 1, 1)]
    out = toxicity.score_toxicity(documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    held = [(r.score, r.doc_id % 6 == 0) for r in out if r.held_out and r.doc_id < 1500]
    good = [s for s, t in held if not t]
    assert np.mean([np.mean([s > g for g in good]) for s, t in held if t]) > 0.97
    none = toxicity.score_toxicity(documents(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len({r.score for r in none}) == 1 and none[0].predicted == 0


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"term{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, question = text(60), text(30)
    base = text(150).split()
    near = list(base)
    near[40] = "edited"
    rows = [(k, text(80), "en", f"h{k % 3}", 1) for k in range(40)]
    rows += [(100, "few words", "en", "h1", 1), (101, None, "en", "h1", 1), (102, " ".join(base), "en", "h1", 1), (103, " ".join(near), "en", "h1", 1), (104, " ".join(base), "en", None, 1)]
    rows += [(110, text(40) + " " + passage, "en", "h2", 1), (111, passage + " " + text(90), "en", "h2", 1), (120, text(50) + " " + question, "en", "h0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in now.collect()})
        if k < 4:
            assert now.columns == docs.columns
    clean = set(range(40)) | {110, 111, 120}
    assert set(seen[0]) == clean | {102, 103, 104}
    assert set(seen[1]) == clean | {102}
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][111].text and seen[2][110].text == rows[45][1] and seen[2][111].n_chars == len(seen[2][111].text)
    assert set(seen[3]) == set(seen[2]) - {120}
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_results_survive_other_runs_and_nothing_stays(spark, tmp_path, monkeypatch):
    """Tables of one job are not deleted by another, and a run around a job leaves the folder empty."""
    monkeypatch.setattr(common, "scratch_root", lambda spark: str(tmp_path / "scratch"))
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i) % 90}" for i in range(70)), "en", f"h{k % 3}", 1) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item that nobody has copied")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with Run(spark):
        first = registry.queries()["op1_substring_dedup"](spark, str(tmp_path))
        near = registry.queries()["op3_order_minhash"](spark, str(tmp_path))
        n = corpus_pipeline.run(spark, str(tmp_path)).count()
        assert first.count() == near.count() == 30 and n > 0
        assert len(list((tmp_path / "scratch").iterdir())) < 12
    assert not list((tmp_path / "scratch").iterdir())


def test_empty_tables(spark, tmp_path):
    none = documents(spark, extra=True).where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(none, labels).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["quotation_cases", "host_verdict_cases"])
def test_made_up_cases_equal_sql(spark, name):
    import duckdb

    df = registry.queries()[name](spark, "")
    cursor = duckdb.connect().execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = collections.Counter(cursor.fetchall())
    rows = df.select(*columns).collect()
    assert collections.Counter(map(tuple, rows)) == want
    if name == "host_verdict_cases":
        kept = {r.doc_id: r.kept for r in rows}
        assert not any(kept[k] for k in range(66)) and not kept[150] and kept[401] and kept[403] and kept[200]
    else:
        assert sum(r.n_linked for r in rows) > 20 and max(r.depth for r in rows) == 3


def test_leaks_of_an_item_with_several_variants(spark):
    item = "when a shop sells 60 pens and 3 books how many are left"
    variant = lambda a, b: item.replace("60", a).replace("3", b)
    rows = [(1, item), (2, " then ".join([item, variant("80", "4"), variant("80", "5")])), (3, f"{variant('70', '8')} or {variant('80', '4')}")]
    out = decontamination.find_leaks(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_met, r.reparameterised) for r in out) == [(1, 6, False), (2, 6, False), (3, 6, True)]
