import random

import numpy as np
import pytest

from tidemark.llm import quality as Q
from tidemark.llm import toxicity as X


@pytest.fixture(scope="module")
def corpus(sentences):
    """(texts, quality, toxic): junk is shouted, toxic texts hold one of a few words."""
    rng = random.Random(1)
    texts, good, toxic = [], [], []
    for i in range(600):
        words = sentences(rng.randint(5, 60), i).split()
        junk, bad = rng.random() < 0.25, rng.random() < 0.25
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "trash"]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words))
        good.append(int(not junk))
        toxic.append(int(bad))
    return texts, good, toxic


def labels(spark, good, toxic):
    return spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic))], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,at", [(Q, 1), (X, 2)])
def test_held_out_accuracy(spark, docs_of, corpus, module, at):
    texts, good, toxic = corpus
    docs = docs_of([*texts, "", None])
    out = module.scored(docs, module.train(docs, labels(spark, good, toxic))).collect()
    assert len(out) == len(texts) + 2 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.score >= module.THRESHOLD) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < len(texts)]
    assert 100 < len(held) < 200
    assert np.mean([r.predicted == corpus[at][r.doc_id] for r in held]) > 0.9


@pytest.mark.parametrize("module", [Q, X])
def test_labels_of_held_out_rows_do_not_matter(spark, docs_of, corpus, module):
    import zlib

    texts, good, toxic = corpus
    docs = docs_of(texts)
    flip = lambda ys: [1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y for i, y in enumerate(ys)]
    score = lambda g, t: {r.doc_id: r.score for r in module.scored(docs, module.train(docs, labels(spark, g, t))).collect()}
    assert score(good, toxic) == score(flip(good), flip(toxic))


@pytest.mark.parametrize("module,none", [(Q, 1.0), (X, 0.0)])
def test_no_labels_and_nulls(spark, docs_of, module, none):
    docs = docs_of([(1, "a"), (None, "b"), (3, None), (3, None), (4, "word " * 50_000)])
    empty = labels(spark, [], [])
    assert {r.score for r in module.scored(docs, module.train(docs, empty)).collect()} == {none}
    odd = spark.createDataFrame([(1, None, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.scored(docs, module.train(docs, odd)).collect()} == {none}
    assert module.scored(docs.where("false"), module.train(docs, empty)).count() == 0


def test_accepted_keeps_columns(spark, docs_of, corpus):
    texts, good, toxic = corpus
    docs = docs_of(texts)
    model = Q.train(docs, labels(spark, good, toxic))
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.scored(docs, model).collect() if r.predicted}


def test_obfuscated_words_are_read():
    assert X.word_of('"1d1ot!"') == ("idiot", True)
    assert X.word_of("i.d.i.o.t") == ("idiot", True)
    assert X.word_of("Straße,") == ("straße", False)
    assert X.word_of("1234") == ("", False) and X.word_of("---") == ("", False)


def test_isotonic_pools_violators():
    x, y = X.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(y) == [0, 0.5, 1] and list(x) == [1, 2.5, 4]


def test_hinge_separates():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])]
    w, b = Q.fit_hinge(rows, np.array([1, -1, 1, -1]), 3)
    assert w[0] + b > 0 > w[1] + b


def test_long_chunks_are_read_to_their_end():
    head = "word" * 16
    assert set(Q.features(head + "x1!Y" * 30)) != set(Q.features(head + "word" * 30))
    assert set(Q.features("ab c")) != set(Q.features(head)) and Q.shape("Ab12" * 16) == "Aa0" * 16 + "~5"


def test_all_words_of_a_chunk_are_read():
    assert X.words_of("you/idiot")[0] == ["you", "idiot", "youidiot"] and X.words_of("a...b")[0] == ["a", "b", "ab"]
    assert "idiot" in X.words_of("you/1d1ot")[0] and X.words_of("i.d.i.o.t") == (["i", "d", "i", "o", "t", "idiot"], True)
    assert "idiot" in X.words_of("x/" * 5000 + "idiot")[0] and X.words_of("idiot,idiot")[0][:2] == ["idiot", "idiot"]
    assert X.words_of("(Word),") == (["word"], False) and X.words_of("1234") == ([], False) and X.words_of("--") == ([], False)
    lexicon = X.Lexicon({"idiot": 5.0}, {})
    assert lexicon.features("word," * 100 + "idiot")[4] == 1 and lexicon.features("scum/you!idiot")[4] == 1


def test_isotonic_as_by_brute_force():
    """The least squares fit is max over a start of min over an end of the means between; order of ties is nothing."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        m, y = rng.integers(0, 8, 40) / 4.0, rng.integers(0, 2, 40).astype(float)
        levels = np.unique(m)
        mean = lambda i, j: y[(m >= levels[i]) & (m <= levels[j])].mean()
        want = [max(min(mean(i, j) for j in range(k, len(levels))) for i in range(k + 1)) for k in range(len(levels))]
        order = rng.permutation(40)
        knots = X.isotonic(m[order], y[order])
        # a pooled block stands at the mean of its margins: its value holds for every level in it
        blocks = sorted(set(np.round(want, 12)))
        assert np.round(knots[1], 12).tolist() == blocks
        centres = [m[np.isin(m, levels[np.isclose(want, b)])].mean() for b in blocks]
        assert knots[0] == pytest.approx(centres)


def test_trees_as_by_brute_force():
    """Every cut of every feature, tried row by row, level by level."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
    y[x[:, 1] > 3] = 1
    got = X.Trees(rounds=4, depth=2).fit(x, y).margin(x)
    margin = np.full(60, np.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
        groups = [np.ones(60, bool)]
        for _ in range(2):
            split = []
            for own in groups:
                best, chosen = 1e-9, None
                for f in range(3):
                    for cut in sorted(set(x[:, f])):
                        left, right = own & (x[:, f] <= cut), own & (x[:, f] > cut)
                        if min(h[left].sum(), h[right].sum()) >= 0.5:
                            value = gain(left) + gain(right) - gain(own)
                            if value > best + 1e-12:
                                best, chosen = value, (left, right)
                split += chosen or (own, np.zeros(60, bool))
            groups = split
        for own in groups:
            margin[own] += 0.1 * g[own].sum() / (h[own].sum() + 1)
    assert got == pytest.approx(margin)


def test_features_as_by_reading_word_by_word():
    words, starts = {"idiot": 5.0, "scum": 3.0}, {"trash": 2.5}
    lexicon = X.Lexicon(words, starts)
    text = "You are an IDIOT and scum, truly! 1d1ot trashy things; a fine-day you said"
    said = [w for c in text.split() for w in X.words_of(c)[0]]
    hits = [i for i, w in enumerate(said) if w in words]
    second = [i for i, w in enumerate(said) if w in X.SECOND]
    own = sorted((words[said[i]] for i in hits), reverse=True)
    got = lexicon.features(text)
    assert got[0] == pytest.approx(np.log1p(len(said))) and got[1] == 5.0 and got[2] == sum(own) and got[3] == sum(own[:3])
    assert got[4] == len(hits) and got[5] == pytest.approx(len(hits) / len(said)) and got[6] == sum(v >= 4 for v in own)
    assert got[8] == 2.5 and got[9] == sum(w[:5] in starts for w in said) and got[11] == len({said[i] for i in hits})
    assert got[13] == min(abs(i - j) for i in hits for j in second) and got[17] == pytest.approx(sum(len(w) for w, hidden in map(X.words_of, text.split()) if hidden) / len(said))
    assert lexicon.features("good day")[13] == X.FAR == lexicon.features("you there")[13] == lexicon.features("idiot there")[13]


def test_ratios_and_the_dual_optimum_as_by_brute_force():
    """Log-count ratios counted by hand; no step along any dual coordinate lowers the objective any more."""
    rng = np.random.default_rng(8)
    size, y = 12, np.where(np.arange(50) % 3 == 0, 1, -1)
    rows = [np.unique(np.r_[rng.integers(0, size, 4), rng.integers(0, 3) if v > 0 else rng.integers(3, 6)]) for v in y]
    weights, bias = Q.fit_hinge(rows, y, size, epochs=2000)
    p = np.array([1.0 + sum(k in r for r, v in zip(rows, y) if v > 0) for k in range(size)])
    q = np.array([1.0 + sum(k in r for r, v in zip(rows, y) if v < 0) for k in range(size)])
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = np.zeros((50, size + 1))
    x[:, size] = 1
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    caps = np.where(y > 0, 25 / (y > 0).sum(), 25 / (y < 0).sum())
    dual = np.zeros(50)
    gram = (x @ x.T) * np.outer(y, y)
    for _ in range(20_000):  # projected gradient, another way to the same optimum
        dual = np.clip(dual - (gram @ dual - 1) / np.linalg.norm(gram, 2), 0, caps)
    want = x.T @ (dual * y)
    assert bias == pytest.approx(want[-1], abs=2e-2)
    assert np.array([weights[r].sum() + bias for r in rows]) == pytest.approx(x @ want, abs=2e-2)


def test_shapes_and_shares_as_by_counting():
    """The indicators of a text, from its shapes' n-grams and their shares of the text, by plain dictionaries."""
    from collections import Counter

    text = "The CAT sat 12 times, the the cat!! " * 3
    chunks = text.split()
    named = [(Q.shape(c), c == b) for b, c in zip([None, *chunks], chunks)]
    code = [Q._codes[c] + Q.REPEAT * again for c, (_, again) in zip(chunks, named)]
    want = {Q.BUCKETS - 1 - int(np.log2(len(chunks) + 1))}
    for k in (1, 2, 3):
        grams = []
        for i in range(len(chunks) - k + 1):
            g = code[i]
            for j in range(1, k):
                g = (g * 1_000_003 + code[i + j]) & 0x7FFFFFFF
            grams.append(g)
        for g, times in Counter(grams).items():
            want |= {int(Q._bucket(np.array([g]), k, level)[0]) for level in range(7) if not level or times * 2**level >= len(grams)}
    assert set(Q.features(text).tolist()) == want


def test_the_sample_is_bounded_by_rows_whatever_repeats(spark, docs_of):
    """One doc_id in thousands of rows, some of them with texts of their own, is one row of the sample."""
    docs = docs_of([(1, "hot text")] * 3000 + [(1, f"hot text {i}") for i in range(200)] + [(i, f"text {i}") for i in range(2, 40)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)] + [(1, 1, 1)] * 50, "doc_id long, quality int, toxic int")
    rows = Q.sample(docs, labels, "quality", 8000).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) <= 39 and 1 in ids
    assert len(Q.sample(docs, labels, "quality", 7).collect()) == 7
    again = Q.sample(docs.repartition(7), labels, "quality", 8000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
