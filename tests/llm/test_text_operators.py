import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sieveline.llm import bpe_prefix, html_text, near_dedup, quality_rules, quotation, substring_dedup, token_counts
from sieveline.llm.alignment import edit_distance
from sieveline.llm.fm_index import FMIndex
from sieveline.llm.html_tree import parse, render

from .cases import awkward, documents

public = pytest.importorskip("public_tokenizers")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(rows, window):
    """The contract of substring dedup, word by word."""
    last = (1 << 63) - 1
    first, cut = {}, [(last if d is None else d, SPLIT.findall(t or "")) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for (d, w), (given, _) in zip(cut, rows, strict=True):
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((given, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return collections.Counter(out)


def test_substring_dedup_equals_brute_force(spark):
    rows = awkward()
    got = substring_dedup.find_repeats(documents(spark, rows, extra=True)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 50)
    assert any(r.n_removed for r in got)


def test_substring_dedup_short_windows_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k // 2, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "HOT_ROUTE", 3)
    got = substring_dedup.find_repeats(documents(spark, rows), window=6, run=3).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 6)


def test_hot_routes_are_split_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w[rng.randrange(20) :])))
    monkeypatch.setattr(substring_dedup, "HOT_ROUTE", 5)
    got = substring_dedup.find_repeats(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 50)


def test_a_common_passage_is_not_split_for_every_document(spark, monkeypatch):
    """Windows that the pivots of a hot route have make no parts, and equal parts of a segment are one."""
    rng = random.Random(21)
    passage, rows = [f"p{k}" for k in range(200)], []
    for k in range(80):
        w = list(passage)
        w[rng.randrange(200)] = f"edit{k}"
        rows.append((k if k % 9 else None, " ".join(w + ["once", "more"] * (30 + k))))
    made, split = [], substring_dedup._split

    def counted(*given):
        out = split(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "_split", counted)
    monkeypatch.setattr(substring_dedup, "HOT_ROUTE", 5)
    got = substring_dedup.find_repeats(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 50)
    assert 0 < sum(made) < 2000


@pytest.mark.parametrize("m", [2, 20, 2000])
def test_repeated_rows_are_linear_in_substring_dedup(spark, m):
    rng = random.Random(m)
    passage = [f"w{rng.randrange(5000)}" for _ in range(400)]
    text = " ".join(passage)
    other = "  ".join(passage)  # the same words, other white space
    rows = [(1, "start " + " ".join(passage[:120]))] + [(None, text)] * m + [(5, text), (5, other)] + [(7, "x " + text)] * m
    got = substring_dedup.find_repeats(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 50)


@pytest.mark.parametrize("m", [2, 20, 2000])
def test_repeated_rows_are_linear_in_near_classes(spark, m):
    rng = random.Random(m)
    text = [f"w{rng.randrange(5000)}" for _ in range(80)]
    near = [*text[:40], "edited", *text[41:]]
    rows = [(6, " ".join(text))] * m + [(7, " ".join(near))] * m + [(None, " ".join(text[:-1]))] * m + [(None, " ".join(["other", *near]))] * m
    out = near_dedup.near_classes(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in out) == {(6, 6): m, (7, 6): m, (None, 6): 2 * m}
    kept = near_dedup.keep_one(documents(spark, rows, extra=True))
    assert [(r.doc_id, r.text) for r in kept.collect()] == [rows[0]]
    alone = near_dedup.near_classes(documents(spark, rows[2 * m :])).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in alone) == {(None, None): 2 * m}
    assert near_dedup.keep_one(documents(spark, rows[2 * m :])).count() == 1


def test_empty_tables(spark):
    none = documents(spark, extra=True).where("false")
    assert substring_dedup.find_repeats(none).count() == substring_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_classes(none).count() == near_dedup.keep_one(none).count() == 0
    assert token_counts.count_tokens(none, public.path("byte_bpe_50k.json")).count() == 0
    hosts = none.selectExpr("*", "'h' AS source")
    assert quality_rules.judge(hosts).count() == quality_rules.keep_good(hosts).count() == 0


def test_remove_repeats_keeps_columns_and_clean_texts(spark):
    df = documents(spark, extra=True).selectExpr("*", "length(text) AS n_chars")
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    texts = dict((r.doc_id, r.text) for r in out.where("doc_id IS NOT NULL").collect())
    before = dict(awkward())
    assert texts[9] == before[9] and texts[2] == "" and 6 not in texts
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def some_sequences(rng, length, n):
    import numpy as np

    parts = [rng.integers(0, 3, rng.integers(0, 25)) for _ in range(n)]
    return parts, np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@pytest.mark.parametrize("length", [1, 2, 5, 9])
def test_matching_statistics_equal_brute_force(length):
    import numpy as np

    rng = np.random.default_rng(length)
    for turn in range(40):
        parts, starts = some_sequences(rng, length, int(rng.integers(1, 9)))
        if turn % 3 == 0:
            parts.append(parts[0])
            starts = np.append(starts, starts[-1] + len(parts[0]))
        value = rng.integers(0, 100, len(parts))
        found: dict = {}
        for p, v in zip(parts, value.tolist(), strict=True):
            for i in range(len(p)):
                for n in range(1, min(length, len(p) - i) + 1):
                    g = tuple(p[i : i + n].tolist())
                    found[g] = min(found.get(g, 1000), v)
        streams, bounds = some_sequences(rng, length, 12)
        streams[0] = rng.integers(-1, 6, len(streams[0]))  # words that no indexed sequence has
        many, least = FMIndex(np.concatenate(parts), starts, value, length).match(np.concatenate(streams), bounds)
        want = []
        for p in streams:
            for i in range(len(p)):
                n = max((n for n in range(1, min(length, len(p) - i) + 1) if tuple(p[i : i + n].tolist()) in found), default=0)
                want.append((n, found[tuple(p[i : i + n].tolist())] if n == length else -1))
        assert list(zip(many.tolist(), least.tolist(), strict=True)) == want


def test_a_long_index_is_smaller_than_its_text():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 20_000, 200_000)
    codes[100_000:110_000] = codes[:10_000]
    starts = np.arange(0, 200_001, 200)
    index = FMIndex(codes, starts, np.arange(1000) * 1_000_003, 50)
    assert index.nbytes() < 4 * len(codes) * 1.5 and index.nbytes() < sum(len(f"w{c} ") for c in codes)
    many, least = index.match(codes[100_000:110_000], np.array([0, 10_000]))
    assert (many[:-200] > 0).all() and least[0] == 0


def test_banded_alignment_equals_the_full_table():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(3) for _ in range(rng.randrange(14))]
        b = [x if rng.random() > 0.2 else 9 for x in a if rng.random() > 0.1] if rng.random() < 0.5 else [rng.randrange(3) for _ in range(rng.randrange(14))]
        limit, d = rng.randrange(15), full(a, b)
        assert edit_distance(a, b, limit) == (d if d <= limit else None)


def normal(text):
    out = (re.sub(r"[^\w]|_", "", w) for w in SPLIT.findall((text or "").lower()))
    return [w for w in out if w]


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(7)
    rows = awkward()
    base = normal(rows[3][1])
    for k in range(12):  # near copies of one text: each other word list, all in one class
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((200 + k, " ".join(w)))
    got = {(r.doc_id, r.th): r.root for r in near_dedup.near_classes(documents(spark, rows, extra=True)).collect()}
    out = near_dedup.near_classes(documents(spark, rows)).collect()
    assert len(out) == len(rows) and got
    words = [normal(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if words[i] and words[j] and edit_distance(words[i], words[j], int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)) is not None:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        want[find(i)].append(d)
    expected = collections.Counter((d, min((x for x in ids if x is not None), default=None)) for ids in want.values() for d in ids)
    assert collections.Counter((r.doc_id, r.class_id) for r in out) == expected


def test_keep_one_leaves_one_document_of_each_class(spark):
    df = documents(spark, extra=True)
    out = near_dedup.keep_one(df)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns and 4 in ids and 5 not in ids and 6 not in ids and ids.count(13) == 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 50)}


def test_prefix_counts_equal_the_tokenizer():
    path = public.path("byte_bpe_50k.json")
    own, library = bpe_prefix.PrefixCounts(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = [*"abcdefghiABC  \n\t'123!?.,\x1c\x85\xa0　éßñ中😀", "'s", "'re", "the ", "ing", "<|endoftext|>", "  \n"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert own.prefixes(text) == want and own.count(text) == want[-1]


def test_token_counts_of_awkward_rows(spark):
    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = awkward()
    out = token_counts.count_tokens(documents(spark, rows, extra=True), path, limit=40, prefixes=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), n) and len(r.prefix_tokens) == len(text) + 1
        fits = max(k for k, c in enumerate(r.prefix_tokens) if c <= 40)
        assert r.fitting_bytes == len(text[:fits].encode()) and r.id == "x"


def test_quality_counts_and_hosts(spark):
    rows = [(d, t, None if d is None else "h" if d < 9 else "bad" if d < 20 else "ok") for d, t in awkward()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality_rules.judge(df).collect()
    assert len(out) == len(rows)
    want = collections.Counter()
    for d, t, _ in rows:
        w = SPLIT.findall(t or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if SPLIT.search(x)]
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    good = quality_rules.keep_good(df.selectExpr("*", "'y' AS n_words", "1 AS base_failed"))
    assert collections.Counter(r.doc_id for r in good.collect()) == collections.Counter(r.doc_id for r in out if r.kept)


def test_a_bad_host_takes_its_clean_documents_and_a_small_one_does_not(spark):
    clean, bad = " ".join(f"w{i}" for i in range(30)), "x"
    rows = [(k, bad, "awful") for k in range(90)] + [(k, clean, "awful") for k in range(90, 100)]
    rows += [(100 + k, clean, f"fine{k % 9}") for k in range(300)] + [(500, bad, "tiny"), (501, clean, "tiny")]
    out = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[k] for k in range(100)) and all(out[100 + k] for k in range(300)) and out[501]


def test_repeated_words_with_large_vocabularies():
    import numpy as np

    rng = np.random.default_rng(0)
    codes = np.concatenate((rng.permutation(9000), [5, 6, 7, 8, 9, 5, 6, 7, 8, 9]))
    n = len(codes)
    grams = collections.Counter(tuple(codes[i : i + 5]) for i in range(n - 4))
    covered = {k for i in range(n - 4) if grams[tuple(codes[i : i + 5])] > 1 for k in range(i, i + 5)}
    assert quality_rules.repeated_words(codes) == len(covered)


def test_html_layout():
    draw = lambda x: render(*parse(x))
    assert draw("<p>One<p>Two <b>bold</b>  text<br>line<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after") == "One\n\nTwo bold text\nline\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nafter"
    assert draw("<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td colspan=2>a longer total<tr><td>x<td>22</table>") == "Name  | Qty\napple | 1\na longer total\nx     | 22"
    assert draw("<style>.ad{display:none}#z{visibility:hidden}</style><div class='ad big'>n</div><i id=z>n</i><b hidden>n</b><s style='display: none'>n</s><input type=hidden value=n>yes &amp; so") == "yes & so"
    assert draw("<details><summary>S</summary>no</details><script>if(a<b)'</p>'</script><title>t</title>a < b") == "S\na < b"
    assert draw("<div>" * 20_000 + "deep") == "deep"
    assert draw("<pre>a\n  b</pre><blockquote>q</blockquote>") == "a\n  b\n\n> q"
    assert draw("") == "" and draw("<") == "<" and draw("<a href='x") == ""


def test_html_table_of_pages(spark):
    rows = [(1, "u", "<p>x"), (2, "u", None), (3, "u", ""), (3, "u", ""), (None, None, "<li>a")]
    df = spark.createDataFrame(rows, "page_id long, text string, html string")
    out = html_text.extract_text(df).collect()
    assert collections.Counter((r.page_id, r.text) for r in out) == collections.Counter([(1, "x"), (2, None), (3, ""), (3, ""), (None, "- a")])
    assert html_text.extract_text(df.where("false")).count() == 0


def test_quotes_equal_sql(spark):
    import duckdb

    rng = random.Random(3)
    lines = [f"Sentence number {i} says w{i}." for i in range(12)]
    rows = [(1, 0, "u", "Hello there. How are you?\nIt rains."), (1, 1, "a", "> Hello there. How are you?\n\nFine."), (1, 2, "u", "Bob wrote:\n>> Hello there. How\n>> are you?\n> Fine.\nGood.\n\n\n\nBye."), (2, 0, "u", None), (2, 1, "u", ""), (None, 0, "a", "Say this."), (None, 1, "b", "> say THIS\nok"), (3, None, "x", "> Hello\nq"), (1, 2, "u", "> It rains.\ntwice"), (1, 1, "a", "> Hello there. How are you?\n\nFine.")]
    rows += [(20, 0, "u", "One."), (20, 1, "u", "> One.\nTwo."), (20, 2, "u", "> Two.\nThree."), (20, 3, "u", "> Three.\nFour.")]
    for c in range(5, 10):
        for t in range(10):
            quoted = [rng.choice(["> ", ">> ", "> > "]) + rng.choice(lines) for _ in range(rng.randrange(4))] if t else []
            rows.append((c, t, "u", "\n".join(quoted + [rng.choice(lines), rng.choice(lines)])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cols = list(zip(*rows, strict=True))
    con = duckdb.connect()
    con.register("conversations", pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": cols[2], "text": pa.array(cols[3], pa.string())}))
    want = con.execute(quotation.ORACLE_SQL["op7_quotation_linking"]).fetchall()
    got = quotation.link_quotes(df).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    replies = {(r.conv_id, r.turn, r.clean): (r.reply_to, r.root_turn, r.depth) for r in got}
    # Another message of turn 2 answers turn 0, and messages of one turn share the chain of the earliest.
    assert replies[1, 2, "Good.\n\nBye."] == (1, 0, 1)
    assert replies[20, 3, "Four."] == (2, 0, 3)
    assert quotation.link_quotes(df.where("false")).count() == 0


def template_texts(rng, unlike, pairs, shared, size=300):
    """Texts that share a long passage: so many unlike ones, then pairs of near copies that are like no other."""
    passage = [f"p{k}" for k in range(shared)]
    out = []
    for k in range(unlike + pairs):
        own = [f"o{k}w{i}" for i in range(size - shared)]
        out.append(passage + own)
        if k >= unlike:
            for e in rng.sample(range(len(own)), 5):
                own[e] = f"e{k}w{e}"
            out.append(passage + own)
    return out


@pytest.mark.parametrize("few", [64, 2])
def test_near_pairs_behind_unlike_hubs_are_found(spark, monkeypatch, few):
    import numpy as np

    monkeypatch.setattr(near_dedup, "FEW", few, raising=False)
    monkeypatch.setattr(near_dedup, "BLOCK", 16, raising=False)
    # One bucket for all, so that a pair has no second one to meet in.
    monkeypatch.setattr(near_dedup, "sketch", lambda hashes: np.array([7], np.uint64))
    monkeypatch.setattr(near_dedup, "SKETCHES", 1)
    texts = template_texts(random.Random(4), 25, 12, 200)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(documents(spark, rows)).collect()}
    assert got == {k: k if k < 25 or (k - 25) % 2 == 0 else k - 1 for k in range(len(rows))}


@pytest.mark.parametrize("few", [64, 2])
def test_a_text_near_a_member_of_the_hubs_class_is_found(spark, monkeypatch, few):
    import numpy as np

    monkeypatch.setattr(near_dedup, "FEW", few, raising=False)
    monkeypatch.setattr(near_dedup, "sketch", lambda hashes: np.array([7], np.uint64))
    monkeypatch.setattr(near_dedup, "SKETCHES", 1)
    hub = [f"w{k}" for k in range(200)]
    a = [f"a{k}" if k % 6 == 0 else w for k, w in enumerate(hub)]  # 17% away
    b = [f"b{k}" if k % 6 == 1 and k < 100 else w for k, w in enumerate(a)]  # 8% from a, 25% from the hub
    rows = [(k, " ".join(t)) for k, t in enumerate([hub, a, b, [f"x{k}" for k in range(200)]])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(documents(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_texts_at_the_law_share_an_entry():
    """Words replaced at random: none of the pairs at a run similarity of 0.8 is lost, few at an edit similarity of 0.9."""
    import numpy as np

    rng = np.random.default_rng(5)
    for share, most in ((0.022, 0), (0.05, 0), (0.1, 8)):
        lost = 0
        for _ in range(200):
            words = rng.integers(1, 1 << 62, 200).astype(np.uint64)
            edited = words.copy()
            at = rng.choice(200, round(share * 200), replace=False)
            edited[at] = rng.integers(1, 1 << 62, len(at)).astype(np.uint64)
            lost += not (near_dedup.sketch(words) == near_dedup.sketch(edited)).any()
        assert lost <= most, (share, lost)


def test_hot_buckets_are_split_and_keep_pairs_at_the_law(spark, monkeypatch):
    """Texts that share two thirds of their words, near pairs among them, in buckets that are all hot."""
    monkeypatch.setattr(near_dedup, "HOT", 6)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    texts = template_texts(random.Random(8), 60, 20, 200)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(documents(spark, rows)).collect()}
    assert got == {k: k if k < 60 or (k - 60) % 2 == 0 else k - 1 for k in range(len(rows))}


def one_shared_entry(hashes):
    """A sketch whose first entry all texts share, and no other."""
    import numpy as np

    return np.concatenate(([7], hashes[:1] + np.arange(1, 24, dtype=np.uint64) * hashes.sum(dtype=np.uint64))).astype(np.uint64)


@pytest.mark.parametrize("hot", [6, 4096])
def test_pairs_that_share_one_hot_bucket_only_are_found(spark, monkeypatch, hot):
    """No pair of a large bucket is lost because its texts share no second entry."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "sketch", one_shared_entry)
    texts = template_texts(random.Random(9), 120, 20, 200)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = {k: k if k < 120 or (k - 120) % 2 == 0 else k - 1 for k in range(len(rows))}
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(documents(spark, rows)).collect()} == want
    assert {r.doc_id for r in near_dedup.keep_one(documents(spark, rows)).collect()} == set(want.values())


def test_the_pipeline_drops_copies_that_share_one_hot_bucket_only(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    monkeypatch.setattr(near_dedup, "HOT", 6)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    monkeypatch.setattr(near_dedup, "sketch", one_shared_entry)
    texts = template_texts(random.Random(10), 30, 15, 200)
    docs = documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {*range(30), *range(30, 60, 2)}


def test_stars_of_unlike_texts_end_after_a_round_without_links(spark, monkeypatch):
    """The pairs that are rows grow with the number of texts; the rest is compared in blocks."""
    pairs, alike = [], near_dedup.alike
    monkeypatch.setattr(near_dedup, "alike", lambda df, similarity: pairs.append(df.count()) or alike(df, similarity))
    monkeypatch.setattr(near_dedup, "sketch", one_shared_entry)
    rows = [(k, " ".join(t)) for k, t in enumerate(template_texts(random.Random(3), 60, 0, 200))]
    assert all(r.class_id == r.doc_id for r in near_dedup.near_classes(documents(spark, rows)).collect())
    assert sum(pairs) == 59


def test_html_with_stray_quotes():
    draw = lambda x: render(*parse(x))
    assert draw("<p class='x\"'\">first</p><p>second <b>third</b></p>") == "first\n\nsecond third"
    assert draw('<p class="x"">first</p><p>second <b>third</b></p>') == "first\n\nsecond third"
    assert draw("<p don't>first</p><p>it's</p>") == "first\n\nit's"
    assert draw("<a href=x\"y>one</a> <a title = 'a>b' hidden>no</a><i ='>two</i>") == "one two"


def test_html_shows_what_a_screen_shows():
    draw = lambda x: render(*parse(x))
    page = lambda css: draw(f"<style>{css}</style><p class='content'>a</p><p class='tab on'>b</p>")
    assert page("@media print{.content{display:none}}") == page("@media (max-width:600px){.tab{display:none}}") == "a\n\nb"
    assert page(".tab{display:none}.tab{display:block}") == page(".tab{display:none}.on{display:block}") == "a\n\nb"
    assert page("@media screen{.content{display:none}}") == page("@import 'x';@media print{p{color:red}}.content{display:none}") == "b"
    assert page(".tab{display:none!important}.tab{display:block}") == page("@media (min-width:600px){.tab{visibility:hidden}}") == "a"
    assert draw("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>") == "x=2"
    assert draw("a<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text x=1>one <tspan>two</tspan></text><g><text>three</text></g>no</svg>b") == "a one two three b"


def test_html_visibility_and_selectors():
    draw = lambda x: render(*parse(x))
    assert draw("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p>z") == "yes\n\nz"
    assert draw("<style>.h{visibility:hidden}.h i{visibility:visible}</style><div class=h>no<i>yes</i></div>") == "yes"
    assert draw("<style>div .x{display:none}</style><div><p><b class=x>no</b>a</p></div><b class=x>yes</b>") == "a\n\nyes"
    assert draw("<style>div > .x{display:none}</style><div><p><b class=x>yes</b></p><b class=x>no</b></div>") == "yes"
    assert draw("<style>p.a.b{display:none}</style><p class='b a'>no</p><p class=a>yes</p>") == "yes"
    assert draw("<style>[aria-hidden=true],a[href='x, y']{display:none}</style><i aria-hidden=true>no</i><i aria-hidden=false>yes</i><a href='x, y'>no</a>") == "yes"
    assert draw("<style>#a p{display:none}p.b{display:block}</style><div id=a><p class=b>no</p></div><p class=b>yes</p>") == "yes"
    assert draw("<style>p:hover{display:none}p + p{display:none}</style><p>a</p><p>b</p>") == "a\n\nb"
    assert draw("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>") == "- yes"


def test_html_tables_with_cells_over_rows():
    draw = lambda x: render(*parse(x))
    assert draw("<table><tr><td rowspan=2>ab<td>1<tr><td>22<tr><td>c<td>3</table>") == "ab | 1\n   | 22\nc  | 3"
    assert draw("<table><tr><td>a<td rowspan=0>down<td>b<tr><td>c<td>d<tr><td>e</table>") == "a | down | b\nc |      | d\ne"


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<b>" * 200_000, "<button><p>" + "<div>" * 100_000 + "</p></i>" * 100_000, "<ul><li>a" * 20_000, "<style>div div{display:block}p div div{display:none}</style>" + "<div class='a b'>" * 100_000])
def test_html_of_any_depth_takes_linear_time(page):
    import time

    begin = time.process_time()
    assert render(*parse(page + "end")).endswith("end") and time.process_time() - begin < 5


def random_page(rng, depth=0):
    """A tree of (tag, class, style, children) and texts; children of tables are rows of (rowspan, colspan, text)."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["text", "text", "b", "div", "p", "ul", "ol", "br", "table", "blockquote"]) if depth < 4 else "text"
        looks = rng.choice(["", "", "", "k", "x"]), rng.choice(["", "", "", "display:none", "visibility:hidden", "visibility:visible"])
        if kind == "text":
            out.append(f"t{rng.randrange(1000)} u ")
        elif kind in ("ul", "ol"):
            out.append((kind, *looks, [("li", "", "", random_page(rng, depth + 2)) for _ in range(rng.randrange(1, 4))]))
        elif kind == "table":
            out.append((kind, "", "", [[(rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 1, 2]), f"c{rng.randrange(10 ** rng.randrange(1, 7))}") for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]))
        elif kind == "p":
            out.append((kind, *looks, [x for x in random_page(rng, 4) if isinstance(x, str)]))
        else:
            out.append((kind, *looks, [] if kind == "br" else random_page(rng, depth + 1)))
    return out


def written(page):
    def one(x):
        if isinstance(x, str):
            return x
        tag, cls, style, inner = x
        looks = f" class={cls}" * bool(cls) + f" style='{style}'" * bool(style)
        if tag == "br":
            return f"<br{looks}>"
        if tag == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td rowspan={r} colspan={c}>{t}" for r, c, t in row) for row in inner) + "</table>"
        return f"<{tag}{looks}>{written(inner)}</{tag}>"

    return "".join(map(one, page))


def plain_lines(page, classes=(), visible=True):
    """The lines that a page shows, by plain recursion: strings, and None where an empty line may stand."""
    lines, now = [], ""

    def flush():
        nonlocal now
        if now.strip():
            lines.append(" ".join(now.split()))
        now = ""

    for x in page:
        if isinstance(x, str):
            now += x if visible else (" " if now else "")
            continue
        tag, cls, style, inner = x
        if style == "display:none" or (cls == "x" and "k" in classes):
            continue
        seen = visible if not style.startswith("visibility") else style == "visibility:visible"
        within = (*classes, cls)
        if tag == "b":
            got = plain_lines(inner, within, seen)
            if got and not any(y is None for y in got) and len(got) == 1 and all(isinstance(y, str) for y in inner):
                now += got[0] + " "
            else:
                return None  # blocks within inline elements: not this plain
        elif tag == "br":
            return None
        elif tag == "table":
            flush()
            spots, widths = {}, {}
            for r, row in enumerate(inner):
                c = 0
                for down, span, text in row:
                    while (r, c) in spots:
                        c += 1
                    n = 1
                    while n < span and (r, c + n) not in spots:
                        n += 1
                    for i in range(down):
                        for j in range(n):
                            spots[r + i, c + j] = ("", 1)
                        spots[r + i, c] = (text if visible and i == 0 else "", n)
                    if n == 1:
                        widths[c] = max(widths.get(c, 0), len(text) if visible else 0)
                    c += n
            lines.append(None)
            for r in range(len(inner)):
                cells, c, end = "", 0, max((j for i, j in spots if i == r), default=-1)
                while c <= end:
                    text, n = spots.get((r, c), ("", 1))
                    wide = sum(widths.get(c + k, 0) for k in range(n)) + 3 * (n - 1)
                    cells += text.ljust(wide) + " | "
                    c += n
                if cells.strip(" |"):
                    lines.append(cells.rstrip(" |"))
            lines.append(None)
        else:
            flush()
            parts = inner if tag in ("ul", "ol") else [(tag, "", "", inner)]
            spaced = tag in ("p", "ul", "ol", "blockquote")
            got = []
            for k, (_, _, _, content) in enumerate(parts):
                own = plain_lines(content, within, seen)
                if own is None or (tag in ("ul", "ol") and None in own):
                    return None
                sign = {"ul": "- ", "ol": f"{k + 1}. ", "blockquote": "> "}.get(tag, "")
                if tag in ("ul", "ol"):
                    if not own:
                        return None
                    got += [(sign if seen and i == 0 else " " * len(sign)) + y for i, y in enumerate(own)]
                elif tag == "blockquote":
                    if None in own:
                        return None
                    got += [sign + y for y in own]
                else:
                    got += own
            lines += [None] * spaced + got + [None] * spaced
    flush()
    return lines


def test_html_layout_equals_plain_recursion():
    rng, seen = random.Random(31), 0
    for _ in range(6000):
        page = random_page(rng)
        lines = plain_lines(page)
        if lines is None:
            continue
        seen += 1
        want, gap = [], False
        for x in lines:
            if x is None:
                gap = bool(want)
            else:
                want += [""] * gap + [x]
                gap = False
        html = "<style>.k .x{display:none}</style>" + written(page)
        got = render(*parse(html))
        assert [x.rstrip() for x in got.split("\n")] == ([x.rstrip() for x in want] or [""]), html
    assert seen > 1000
