"""Toxicity scores: boosted trees over dense features of a text, calibrated isotonically.

Labelled rows are split by crc32(doc_id as text) mod 5: remainder 0 is held out
and never read, 1 and 2 give the lexicon, 3 the trees, 4 the calibration.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Run, batch, map_texts, spill, table, word_codes
from .trees import BoostedTrees, Isotonic

#: At most this many labelled rows are used (those whose ids hash lowest).
MAX_LABELLED = 20_000
#: At most this many words, and this many word beginnings, are in the lexicon.
MAX_TERMS = 400
#: Beginnings of words that the lexicon may hold, in code points.
BEGINNINGS = (4, 5, 6)
#: A term must occur this many times as often in toxic documents.
LIFT = 6.0
#: Second persons of the languages that are covered (general vocabulary).
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros"]
#: Words apart, at most, for a lexicon word to be near a second person.
NEAR = 5
#: Characters written for letters (fixed values).
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = ["log_words", "word_hits", "word_density", "word_weight", "beginning_hits", "beginning_density", "beginning_weight", "near_second_person", "second_person_density", "capitals", "all_capitals", "exclamations", "punctuation", "symbols", "obfuscated", "longest_run"]


def plain_forms(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words in lower case without marks at their ends, with letters written otherwise put back; and which changed inside."""
    low = pc.utf8_lower(words)
    bare = pc.replace_substring_regex(low, r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}]+$", "")
    odd = pc.match_substring_regex(bare, r"\p{L}[^\p{L}'’.,;:-]+\p{L}")
    back = bare
    for mark, letter in WRITTEN_FOR.items():
        back = pc.replace_substring(back, mark, letter)
    back = pc.replace_substring_regex(back, r"[^\p{L}\p{N}]", "")
    return pc.if_else(odd, back, bare), odd


def terms_of(words: pa.Array) -> list[pa.Array]:
    """Per word its plain form and its beginnings (null where too short), each marked by kind."""
    plain, _ = plain_forms(words)
    size = pc.utf8_length(plain)
    out = [pc.if_else(pc.greater(size, 1), pc.binary_join_element_wise("=", plain, ""), None)]
    for k in BEGINNINGS:
        start = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(plain, 0, k), "")
        out.append(pc.if_else(pc.greater(size, k), start, None))
    return out


def term_counts(labelled: DataFrame) -> DataFrame:
    """Documents of each label that have a term: term, toxic, n. Counted per task before the shuffle."""

    def make():
        def work(part: pa.RecordBatch):
            starts, codes, words = word_codes(part.column("text"))
            if not len(words):
                return
            kinds = terms_of(words.cast(pa.string()))
            toxic = part.column("toxic").to_pylist()
            found: tuple[Counter, Counter] = (Counter(), Counter())
            lists = [x.to_pylist() for x in kinds]
            for k, label in enumerate(toxic):
                own = np.unique(codes[starts[k] : starts[k + 1]]).tolist()
                found[label].update({t for x in lists for i in own if (t := x[i]) is not None})
            for label in (0, 1):
                yield batch(term=pa.array(list(found[label]), pa.string()), toxic=pa.array([label] * len(found[label]), pa.int32()), n=pa.array(list(found[label].values()), pa.int64()))

        return work

    return map_texts(labelled.select("text", "toxic"), make, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms and their log lift, from documents with text and toxic (0 or 1)."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not bad:
        return {}
    least = max(3, round(0.01 * bad))
    counts = term_counts(labelled).groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("g"))
    lift = F.log(((F.col("b") + 0.5) / (bad + 1)) / ((F.col("g") + 0.5) / (good + 1)))
    ranked = counts.where(F.col("b") >= least).withColumn("w", lift).where(F.col("w") >= float(np.log(LIFT)))
    found: dict[str, float] = {}
    for kind in "=^":
        top = ranked.where(F.col("term").startswith(kind)).orderBy(F.desc(F.col("w") * F.sqrt("b")), "term").limit(MAX_TERMS)
        found |= {r["term"]: float(r["w"]) for r in top.collect()}
    return found


def longest_runs(text: bytes) -> int:
    a = np.frombuffer(text, np.uint8)
    if len(a) < 2:
        return len(a)
    ends = np.flatnonzero(np.append(a[1:] != a[:-1], True))
    return int(np.diff(ends, prepend=-1).max())


def features(column: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per text; an empty or null text has none of anything."""
    starts, codes, words = word_codes(column)
    n, docs = np.diff(starts), len(column)
    out = np.zeros((docs, len(FEATURES)), np.float32)
    if not len(codes):
        return out
    words = words.cast(pa.string())
    plain, odd = plain_forms(words)
    terms = pa.array(list(lexicon) or [""], pa.string())
    weights = np.array([*(lexicon.values() or [0.0]), 0.0])
    number = lambda a: np.asarray(a.fill_null(0), np.float64)
    whole, *starts_of = (weights[np.asarray(pc.fill_null(pc.index_in(t, terms), len(weights) - 1), np.int64)] for t in terms_of(words))
    begins = np.max(starts_of, axis=0)
    second = number(pc.is_in(plain, pa.array(SECOND_PERSON)).cast(pa.int8()))
    of_doc = np.repeat(np.arange(docs), n)
    total = lambda per_word: np.bincount(of_doc, per_word[codes], docs)
    length = number(pc.utf8_length(words))
    letters, per = np.maximum(total(length), 1), np.maximum(n, 1)
    seen = np.concatenate(([0], np.cumsum(second[codes])))
    at = np.arange(len(codes))
    low, high = np.maximum(at - NEAR, starts[:-1][of_doc]), np.minimum(at + NEAR + 1, starts[1:][of_doc])
    hit = (whole[codes] > 0) | (begins[codes] > 0)
    near = np.bincount(of_doc, hit & (seen[high] > seen[low]), docs)
    upper = number(pc.count_substring_regex(words, r"\p{Lu}"))
    marks = number(pc.count_substring_regex(words, r"[.,;:!?'\"-]"))
    symbols = number(pc.count_substring_regex(words, r"[#*$%&|<>@^~]"))
    shouts = number(pc.count_substring(words, "!"))
    hits, starts_hit = total(np.sign(whole)), total(np.sign(begins))
    columns = (np.log1p(n), np.minimum(hits, 20), hits / per, total(whole) / per, np.minimum(starts_hit, 20), starts_hit / per, total(begins) / per, near / per, total(second) / per, total(upper) / letters, total((upper >= 3) & (upper == length)) / per, total(shouts) / per, total(marks) / letters, total(symbols) / letters, total(number(odd.cast(pa.int8()))) / per)
    for j, x in enumerate(columns):
        out[:, j] = x
    out[:, -1] = [min(longest_runs(x or b""), 50) for x in column.cast(pa.binary()).to_pylist()]
    return out


def feature_table(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def work(part: pa.RecordBatch):
        x = features(part.column("text"), lexicon)
        yield batch(doc_id=part.column("doc_id"), x=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), len(FEATURES)).cast(pa.list_(pa.float32())))

    return map_texts(docs.select("doc_id", "text"), lambda: work, "doc_id long, x array<float>")


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id counts as not held out (1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(1)).cast("int")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every document (doc_id, text) with held_out, score and predicted.

    Fits on at most max_labelled rows of labels (doc_id, toxic) whose remainder
    is not 0; only texts enter a score. Null labels are not used; of several
    labels of one id the largest counts; label rows without a document and
    documents without a label are fine. Empty and null texts get the score of a
    text without words. Repeated documents are scored alike, null ids too; an
    empty table gives an empty result, and without any positive label all scores
    are one low constant.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).withColumn("fold", remainder()).where("fold > 0")
    with Run(spark) as run:
        sample = spill(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "tox-sample")
        few = F.broadcast(sample)  # max_labelled rows at most
        lexicon = learn_lexicon(spill(docs.join(few.where("fold < 3"), "doc_id").select("text", "toxic"), "tox-texts"))
        table_ = spill(feature_table(docs, lexicon), "tox-features")
        rows = table_.join(few.where("fold >= 3"), "doc_id").dropDuplicates(["doc_id"]).select("fold", "toxic", "x").orderBy("fold", "toxic", "x").collect()
        run.keep(table_)
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    y, fold = np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])
    model = BoostedTrees().fit(x[fold == 3], y[fold == 3])
    curve = Isotonic().fit(model.margin(x[fold == 4]), y[fold == 4])

    def score(batches):
        for part in batches:
            v = np.asarray(part.column("x").flatten(), np.float64).reshape(part.num_rows, len(FEATURES))
            margin = model.margin(v)
            # A hundredth of the raw probability keeps the order within a step of the curve.
            s = 0.99 * curve(margin) + 0.01 / (1 + np.exp(-margin))
            yield batch(doc_id=part.column("doc_id"), score=pa.array(s, pa.float64()))

    out = table_.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_toxicity": op10_toxicity}
