"""The divergence audit against a brute-force version; its tokenizer, its grouping under collisions, its blocks and tiles."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least):
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    held, count, every = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, said in rows:
        held[lang].update(set(said))
        count[lang, source].update(said)
        every[lang].add(source)
    out = []
    for lang, sources in every.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * len(kept))
        f = lambda p, q: floor(Fraction((p - q) ** 2, p + q))
        for s in sources:
            p = {t: share(count[lang, s][t], total[s]) for t in kept}
            pairs = [(sum(f(p[t], share(count[lang, o][t], total[o])) for t in kept), o) for o in sources if o != s]
            q = {t: share(whole[t], sum(whole.values())) for t in kept}
            best = [(f(p[t], q[t]), t) for t in kept if count[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def rows_of(n, langs=3, sources=5):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "ärger", "日本", "e", "zz", "éa", "naïve", "Beta-max", "x1y", "the", "THE"] + [f"w{chr(97 + i)}" for i in range(20)]
    each = [(f"l{rng.integers(langs)}", f"s{min(rng.integers(sources), rng.integers(sources))}", " ".join(rng.choice(words, rng.integers(0, 30)))) for _ in range(n)]
    odd = [(None, "s0", "alpha alpha"), ("l0", None, "alpha beta"), ("l0", None, None), ("l1", "bare", ""), (None, None, None), ("l0", "\x00", "a\x00b"), ("l0\x00", "", "the"), ("l2", "long", "word Über " * 40_000)]
    return each + odd + each[:7]


@pytest.mark.parametrize("cells, tile, chunk, dense", [(500_000, 256, 8 << 20, 1 << 21), (20, 2, 100, 7)])
def test_as_by_brute_force(spark, monkeypatch, cells, tile, chunk, dense):
    for name, value in zip(("CELLS", "TILE", "CHUNK", "DENSE"), (cells, tile, chunk, dense)):
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of(120)
    docs = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as term", "1 as count", "2 as block", "3 as total")
    got = sorted(tuple(r) for r in divergence.audit(docs.repartition(3), 10).collect())
    assert got == brute(rows, 10)


def test_languages_that_are_not_broadcast_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    rows = rows_of(40)
    docs = spark.createDataFrame([(t, lang, s) for lang, s, t in rows], "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(docs, 2).collect()) == brute(rows, 2)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_slices_that_share_a_digest_are_told_apart():
    texts = ["ab cd ab ef", "cd", "", "ghi ab", "ABCD é"]
    for weak in (lambda b: 0, lambda b: len(b), lambda b: b[0]):
        group, found, counts, held = divergence.cells_of(pa.array(texts), np.zeros(5, np.int64), weak)
        assert {t: (c, d) for t, c, d in zip(found.to_pylist(), counts.tolist(), held.tolist())} == {"ab": (3, 2), "cd": (2, 2), "ef": (1, 1), "ghi": (1, 1), "abcd": (1, 1), "é": (1, 1)}
    _, found, _, _ = divergence.cells_of(pa.array(["x", *texts]).slice(1, 2), np.array([0, 1]))
    assert sorted(found.to_pylist()) == ["ab", "cd", "cd", "ef"]


def test_shares_are_exact_for_large_sums():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total, v = int(rng.integers(1, 9 * 10**14)), int(rng.integers(1, 10**9))
        count = int(rng.integers(0, total + 1))
        assert divergence.shares(np.array([count]), total, v)[0] == 1 + 1_000_000_000 * (count + 2) // (total + 2 * v)


def test_a_block_is_the_same_in_narrow_slices(monkeypatch):
    rng = np.random.default_rng(2)
    cells = sorted({(f"s{rng.integers(6)}", f"t{rng.integers(30)}") for _ in range(90)})
    base = {"lang": "l", "block": 0, "one": 0, "two": 0, "tile": 0, "terms": 30, "lang_total": 900, "total": 150}
    rows = [base | {"source": f"s{i}", "term": None, "count": None, "lang_count": None} for i in range(6)]
    rows += [base | {"source": s, "term": t, "count": int(rng.integers(1, 20)), "lang_count": 40} for s, t in cells]
    table = pa.Table.from_pylist(rows)
    want = divergence._compared(table)
    monkeypatch.setattr(divergence, "DENSE", 18)
    assert divergence._compared(table) == want and want.num_rows > 30
    batches = pa.table({"text": ["x" * 50] * 30}).to_batches(max_chunksize=3)
    monkeypatch.setattr(divergence, "CHUNK", 400)
    assert [c.num_rows for c in divergence._chunks(iter(batches))] == [9, 9, 9, 3]
