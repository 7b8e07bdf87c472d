"""Importance resampling against a brute-force version, and its defined results on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import common, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, words):
    said = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(said), Counter(zlib.crc32(" ".join(said[i : i + k]).encode()) % 50 for k in range(1, words + 1) for i in range(len(said) - k + 1))


def brute(docs, target, words, least):
    each = [(i, *grams(t, words)) for i, t in docs]
    s, t = sum((c for _, _, c in each), Counter()), sum((grams(x, words)[1] for x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 50) / ((s[b] + 1) * (T + 50)))) for b in range(50)}
    rows = []
    for i, n, c in each:
        f = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // f if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, f, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = len(able) * 40 // 100
    return rows, able[:drawn], drawn


TEXTS = ["", None, "One two THREE", "Äpfel und Birnen über Äpfel 12", "a.b,c d-e", "x" * 70_000, "word " * 30_000, "\u0000nul \u007f del é", "日本 語 テキスト"]


@pytest.mark.parametrize("words", [1, 3])
def test_as_by_brute_force(spark, docs_of, sentences, words):
    docs = [*enumerate(TEXTS), *((100 + i, sentences(40, i % 9)) for i in range(60)), (3, "a second text of three"), (None, "no id but a few words")]
    target = ["two three four apples", "word", None, "日本 birnen und"]
    out = resample.resampled(docs_of(docs), docs_of(target).select("text"), words, 50, 7, 40, 3)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in out.collect()]
    rows, drawn, n = brute(docs, target, words, 3)
    plain = lambda rs: sorted(rs, key=repr)
    assert plain(r[:5] for r in got) == plain(rows)
    placed = sorted((r for r in got if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in placed] == list(range(1, n + 1))
    assert [(r[4], r[0]) for r in placed] == [(r[4], r[0]) for r in drawn]


def test_empty_tables_and_repeated_rows(spark, docs_of):
    none = docs_of(["x"]).limit(0)
    assert resample.resampled(none, none).collect() == []
    rows = resample.resampled(docs_of([(1, "a b c")] * 6 + [(2, "")]), none, 1, 10, 1, 50, 1).collect()
    assert sorted(r.rank for r in rows if r.rank) == [1, 2, 3] and {r.weight for r in rows if r.doc_id == 2} == {0}
    assert all(r.rank is None for r in rows if r.doc_id == 2)


def test_what_a_task_sums_up_is_what_its_documents_hold(spark, docs_of, sentences):
    rows = resample.counted(docs_of([sentences(50, i) for i in range(30)]).repartition(3), 2, 40).collect()
    each, sums = Counter(), Counter()
    for r in rows:
        (sums if r.total else each).update(dict(zip(r.buckets, r.counts)))
        assert r.total or (r.n_features == sum(r.counts) and r.n_features == 2 * r.n_words - 1)
    assert each == sums and sum(r.total for r in rows) >= 3


def test_nothing_but_the_result_stays_in_the_shared_folder(spark, docs_of):
    import os

    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert resample.resampled(docs_of(["a b", "c"]), docs_of(["a"])).count() == 2
    assert all(x.startswith("resample-") and x.endswith("-result") for x in set(os.listdir(folder)) - before)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(8 << 20)
