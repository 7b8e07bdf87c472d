import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import neardup as N


def shingled(text):
    w = [x for x in (re.sub(r"[\W_]+", "", c).lower() for c in (text or "").split()) if x]
    k = min(N.WORDS, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None


def brute(rows):
    """Least doc_id of each component of the links of at least THRESHOLD, by all pairs."""
    sets = [shingled(t) for _, t in rows]
    df, n = Counter(), len(rows)
    for s in sets:
        df.update((s or {}).keys())
    rarest = min(1000, n, 2 * 2**21 / max(1, sum(len(t or "") for _, t in rows) / n))
    factor = lambda k: 1 + min(math.log(n / df[k]) / math.log(rarest**3), 1 / 3) if rarest > 1 else 1
    weight = [None if s is None else {k: v * factor(k) for k, v in s.items()} for s in sets]
    comp = list(range(n))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(n):
        for j in range(i):
            a, b = weight[i], weight[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = sum(min(v, b[k]) for k, v in a.items() if k in b)
                if both / (sum(a.values()) + sum(b.values()) - both) >= N.THRESHOLD:
                    comp[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(text, seed, n):
    rng = np.random.default_rng(seed)
    words = text.split()
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(sentences):
    base = sentences(150, 1)
    texts = [base, base.upper() + "!!", *(edited(base, s, s % 6) for s in range(40))]
    passage = sentences(60, 2)
    texts += [f"{sentences(30, 100 + s)} {passage} {sentences(30, 200 + s)}" for s in range(30)]
    texts += [sentences(80, 300 + s) for s in range(30)]
    texts += ["", None, "  ", "?! --", "", "one two", "one two", "one", "One!", "a b c d e", "a b c d e f", "same " * 50, "same " * 60, "same " * 400]
    texts += [sentences(20_000, 9), sentences(20_000, 9) + " more"]
    out = [(1000 - i, t) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base), (None, "x y z")]


@pytest.mark.parametrize("block", [1024, 8])
def test_as_by_all_pairs(docs_of, rows, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    out = N.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in out), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in out)


def test_a_common_text_has_exact_weights(docs_of, sentences):
    """Frequent shingles get less weight, by exact counts; one group's edits still do not part it."""
    line = sentences(8, 7)
    base = sentences(60, 8)
    rows = [(i, f"{sentences(40, 400 + i)} {line}") for i in range(60)] + [(100 + i, f"{edited(base, i, i % 2)} {line}") for i in range(30)]
    out = N.near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in out), key=repr) == brute(rows)


def test_deduplicated_keeps_one_of_each_class_and_the_columns(docs_of, rows):
    docs = docs_of(rows)
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    want = {d for d, c in brute(rows) if d == c}
    assert {r.doc_id for r in out.collect()} == want


def test_empty_table(docs_of, rows):
    assert N.near_duplicates(docs_of(rows).where("false")).count() == 0
    assert N.near_duplicates(docs_of([(1, None), (2, "")])).collect()[0].kept


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 2**62, 400).astype(np.uint64))
    hits, want = [], []
    for _ in range(30):
        keys = np.unique(rng.integers(1, 2**62, 300).astype(np.uint64))
        a, b = rng.choice([0.5, 1, 1, 2, 3], len(keys)), rng.choice([0.5, 1, 1, 2, 3], len(keys))
        hits.append((N.samples(keys, a) == N.samples(keys, b)).mean())
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert np.mean(hits) == pytest.approx(np.mean(want), abs=0.03)


def test_overlaps_equal_similarity():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        k = np.unique(rng.integers(1, 300, 120).astype(np.uint64))
        sets.append((k, np.ones(len(k)) if rng.random() < 0.3 else rng.choice([0.5, 1.0, 2.0], len(k))))
    got = N._overlaps(sets[:5], sets[5:])
    assert got == pytest.approx(np.array([[N.similarity(x, y) for y in sets[5:]] for x in sets[:5]]))


def test_heavy_slots_hold_all_frequent_shingles(docs_of, sentences):
    texts = [f"{sentences(40, i % 20)} {sentences(8, 500 + i)}" for i in range(90)]
    counts = Counter()
    for t in texts:
        counts.update(N.shingles(N.word_ids(t))[0].tolist())
    heavy = N.heavy_slots(docs_of(texts).repartition(5), 4, 1 << 12)
    sums = Counter()
    for k, v in counts.items():
        sums[k >> 52] += v
    assert set(np.flatnonzero(heavy).tolist()) == {k for k, v in sums.items() if v > 4}
    assert {k >> 52 for k, v in counts.items() if v > 4} <= set(np.flatnonzero(heavy).tolist())


def test_frequencies_are_exact_over_all_partitions(docs_of, sentences, monkeypatch):
    monkeypatch.setattr(N, "SLOTS", 1 << 10)  # collisions make more to count, and no other counts
    monkeypatch.setattr(N, "COUNTED", 100)
    texts = [f"{sentences(30, i)} {' '.join(['common'] * (5 + i % 3)) if i % 2 else ''}" for i in range(60)] + ["two words"] * 3 + [""]
    weights = N.common_shingles(docs_of(texts).repartition(7))
    df = Counter()
    for t in texts:
        df.update((shingled(t) or {}).keys())
    rarest = min(1000, len(texts))
    want = sorted((1 + math.log(len(texts) / v) / math.log(rarest**3)) / (4 / 3) for v in df.values() if v > 1)
    assert sorted(weights.values) == pytest.approx(want)
    assert N.rarest(10**9, 10**6) == 2 * 2**21 / 10**6 and N.rarest(10**9, 100) == 1000 and N.idf(np.array([1, 5]), 1, 1.0).tolist() == [1, 1]


def test_word_ids_tell_words_apart():
    equal = lambda a, b: np.array_equal(N.word_ids(a), N.word_ids(b))
    assert equal("Don't  stop_it\tNOW", "dont stopit now!") and len(N.word_ids(" -- ?! ")) == 0 == len(N.word_ids(""))
    assert not equal("ab c", "a bc") and not equal("abc", "acb") and not equal("\U0001d4d0", "a") and equal("É", "é")
    long = "x" * 200_000
    assert len(set(np.concatenate([N.word_ids(t) for t in (long, long[:-1], "y" + long, long + "y")]).tolist())) == 4


def test_equal_rows_in_number_make_no_hot_task(spark):
    from tidemark.llm.common import salted_join

    rows = spark.range(5000).selectExpr("id", "if(id < 4000, 7, id) as key")
    out = salted_join(rows, spark.createDataFrame([(7, "a"), (4500, "b"), (9, "c")], "key long, v string"), "key", "id")
    assert {(r.id, r.v) for r in out.collect()} == {(i, "a") for i in range(4000)} | {(4500, "b")}


def test_deduplicated_keeps_one_row_and_loses_no_text(docs_of, sentences):
    a, b, c = (sentences(80, 900 + k) for k in range(3))
    docs = docs_of([(1, a), (1, a), (1, a.upper()), (2, a), (2, b), (2, b), (3, b), (4, c), (4, "?!"), (4, "?!"), (5, None), (5, None), (6, ""), (None, a), (None, a)])
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    key = lambda t: {a: "a", a.upper(): "a", b: "b", c: "c"}.get(t, t)
    got = sorted(((r.doc_id, key(r.text)) for r in out.collect()), key=repr)
    assert got == sorted([(1, "a"), (2, "b"), (4, "c"), (4, "?!"), (5, None), (6, ""), (None, "a"), (None, "a")], key=repr)


def test_thresholds_that_the_bands_do_not_serve_are_refused(docs_of, rows):
    with pytest.raises(ValueError):
        N.near_duplicates(docs_of(rows), 0.5)


@pytest.mark.parametrize("operator", [N.classes, N.deduplicated])
def test_shuffle_files_of_finished_steps_do_not_stay(spark, docs_of, rows, operator):
    import time

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    docs, before = docs_of(rows), files()
    operator(docs)  # its steps run here; the frame that is returned has not run
    left = files() - before
    for _ in range(50):  # files go a little after the action that made them
        if not left:
            break
        time.sleep(0.2)
        left = files() - before
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
