import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rollup as R
from tidemark.llm.secrets import _vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTED = "doc_id long, source string, lang string, version string, tokens long"


@pytest.fixture
def rollup(spark, tmp_path):
    return R.Rollup(spark, str(tmp_path / "rollup"))


def totals(r):
    return {(x.source, x.lang, x.version): (x.documents, x.tokens) for x in r.totals().collect()}


def test_signed_batches(spark, rollup):
    rows = lambda *x: spark.createDataFrame(x, COUNTED)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert totals(rollup) == {}
    assert rollup.insert("a/1", rows((1, "s", "en", "v1", 10), (2, "s", "en", "v1", 5), (3, None, None, "v1", 7), (3, None, None, "v1", 7), (None, "s", "en", "v1", 2)))
    assert totals(rollup) == {("s", "en", "v1"): (3, 17), (None, None, "v1"): (2, 14)}
    assert not rollup.insert("a/1", rows((9, "s", "en", "v1", 99)))  # the same batch again
    assert rollup.insert("a_1", rows((4, "t", "en", "v1", 1)))  # another name, though alike in a path
    assert rollup.revise("b", rows((1, "s", "fr", "v2", 8), (77, "s", "en", "v1", 1)))
    assert totals(rollup) == {("s", "en", "v1"): (2, 7), ("s", "fr", "v2"): (1, 8), (None, None, "v1"): (2, 14), ("t", "en", "v1"): (1, 1)}
    assert rollup.delete("c", ids(3, 1, 1, 55, None))
    assert not rollup.delete("c", ids(2))
    assert totals(rollup) == {("s", "en", "v1"): (2, 7), ("t", "en", "v1"): (1, 1)}
    assert rollup.delete("d", ids(1, 3))  # gone already
    assert rollup.insert("e", rows())
    assert totals(rollup) == {("s", "en", "v1"): (2, 7), ("t", "en", "v1"): (1, 1)}


def test_an_attempt_without_a_marker_does_not_count(spark, rollup):
    rows = spark.createDataFrame([(1, "s", "en", "v1", 10)], COUNTED)
    rows.withColumn("documents", F.lit(1)).write.parquet(f"{rollup.folder}/attempts/dead/ledger")
    assert totals(rollup) == {}


def test_history_as_by_brute_force(spark, docs_of, tmp_path):
    texts = ["a b", "a  b", " a\nb c ", "", None, "a b", "x " * 30_000, "é ½", "a b"]
    got = totals(R.history(spark, docs_of(texts), str(tmp_path / "r"), PATH, "v"))
    encode = _vocabulary(PATH).encode_ordinary
    firsts = {t or "": i for i, t in reversed(list(enumerate(texts)))}
    assert got == {("s", "en", "v"): (len(firsts), sum(len(encode(" ".join(t.split()))) for t in firsts))}


def test_empty_table(spark, docs_of, tmp_path):
    assert totals(R.history(spark, docs_of(["a"]).where("false"), str(tmp_path / "r"), PATH, "v")) == {}


def test_the_query_counts_all_rows_and_whole_texts(spark, docs_of, tmp_path):
    rows = [(0, "a b"), (1, "a  b"), (2, "a b"), (3, None), (4, " x\n y "), (4, " x\n y "), (4, "a b"), (None, "a b"), (None, " z  z")]
    got = totals(R.whole(spark, docs_of(rows), str(tmp_path / "r"), PATH, "v"))
    encode = _vocabulary(PATH).encode_ordinary
    assert got == {("s", "en", "v"): (len(rows), sum(len(encode(t or "")) for _, t in rows))}


def test_two_committers(spark, rollup):
    """A delete derived from an older ledger is derived again; none is subtracted twice, and each batch counts once."""
    rows = lambda *x: spark.createDataFrame(x, COUNTED)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    other = R.Rollup(spark, rollup.folder)
    rollup.insert("load", rows((1, "s", "en", "v", 10), (2, "s", "en", "v", 5), (3, "s", "en", "v", 1)))
    raced = []

    def late(state):  # the other committer gets in between reading and the entry
        if not raced:
            raced.append(other.delete("b", ids(1, 2)))
        return R._negated(rollup.ledger(state).join(ids(2, 3), "doc_id"))

    assert rollup.commit("a", late, True) and raced == [True]
    assert totals(rollup) == {} and [e["batch"] for e in rollup.state().entries] == ["load", "b", "a"]
    raced.clear()

    def same(state):
        if not raced:
            raced.append(other.insert("twice", rows((4, "s", "en", "v", 7))))
        return R._once(rows((4, "s", "en", "v", 7)))

    assert not rollup.commit("twice", same, False)
    assert not rollup._create(rollup._entry(0), "x")
    assert totals(rollup) == {("s", "en", "v"): (1, 7)}
    assert rollup.revise("late", rows((1, "s", "en", "v", 3)))  # deleted before: nothing
    assert totals(rollup) == {("s", "en", "v"): (1, 7)}


def test_snapshots_bound_what_is_read(spark, rollup, monkeypatch):
    monkeypatch.setattr(R, "SNAPSHOT", 3)
    rows = lambda *x: spark.createDataFrame(x, COUNTED)
    for k in range(7):
        assert rollup.insert(f"b{k}", rows((k, "s", "en", "v", k + 1)))
        assert len(rollup.state().entries) < 3
    rollup.vacuum()
    assert not rollup.insert("b1", rows((1, "s", "en", "v", 100)))  # older than the snapshot, still known
    assert rollup.delete("d", spark.createDataFrame([(0,), (6,)], "doc_id long"))
    assert totals(rollup) == {("s", "en", "v"): (5, 2 + 3 + 4 + 5 + 6)} and rollup.state().snapshot == 5
    assert {r.doc_id for r in rollup.ledger().collect()} == {1, 2, 3, 4, 5}


def test_the_query_leaves_its_totals_only(spark):
    import os

    from tidemark.llm import common
    from tidemark.llm import rollup as R

    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert R.query(spark, "/root/testdata/sf0.001").count() > 0
    assert [x for x in set(os.listdir(folder)) - before if x.startswith("rollup-") and not x.endswith("-result")] == []
