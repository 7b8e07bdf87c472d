import numpy as np
import pytest

from tidemark.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, kind=np.float32):
    n = len(rows)
    links, comp = [0] * n, list(range(n))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    def usable(v, e, c):
        return v is not None and c is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)

    for i in range(n):
        for j in range(i):
            if usable(*rows[i]) and usable(*rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(np.array(r[1], kind), float) for r in (rows[i], rows[j]))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= E.THRESHOLD:
                    links[i] += 1
                    links[j] += 1
                    comp[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(n)), key=repr)


@pytest.mark.parametrize("block", [512, 7, 2])
def test_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 16))
    rows = [(int(i), (centres[i % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.3])).tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(30)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None] + [0.0] * 14, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as n", "'k' as key")
    out = E.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_in_double_precision(spark):
    """What single precision cannot tell apart, or hold, counts as it is; labels need not be numbers."""
    a, tiny = [1.0, 0.0], float(np.sqrt(1 / E.THRESHOLD**2 - 1))
    rows = [(1, [1e39, 0.0], "x"), (2, [1e300, 0.0], "x"), (3, [1e-300, 0.0], "x"), (4, a, "y"), (5, [1.0, tiny * (1 - 1e-9)], "y"), (6, [1.0, tiny * (1 + 1e-9)], "y"), (7, [float("inf"), 1.0], "x"), (8, a, "1.5"), (9, a, "2"), (10, [], "x"), (11, [-0.0, 1.0], "z"), (12, [0.0, 1.0], "z")]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == brute(rows, float)
    assert {r.vec_id: r.n_links for r in out}[4] == 1


def test_shuffled_join_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 7)
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.3).tolist(), 0) for i in range(60)]
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == brute(rows)


def test_sketches_of_links_are_close():
    rng = np.random.default_rng(4)
    a = E.unit(rng.standard_normal((3000, 64)))
    b = E.unit(rng.standard_normal((3000, 64)))
    b = E.unit(b - (a * b).sum(1, keepdims=True) * a)
    pair = E.THRESHOLD * a + np.sqrt(1 - E.THRESHOLD**2) * b
    differ = np.bitwise_count(E.sketches(a, 256) ^ E.sketches(pair, 256)).sum(1)
    assert differ.max() <= E.most_different(256, E.THRESHOLD)
    words = E.sketches(a, 256)
    signs = (a @ E._planes(64, 256) > 0).astype(int)
    assert (E.signatures(words, 4, 10) == (signs[:, :40].reshape(-1, 10, 4) * [1, 2, 4, 8]).sum(2)).all()


def test_plan_meets_the_miss_rate():
    for rows in (1, 1000, 10**6, 10**9):
        bits, tables = E.plan(rows)
        p = (1 - np.arccos(E.THRESHOLD) / np.pi) ** bits
        assert (1 - p) ** tables <= E.MISS


def test_components(spark):
    from tidemark.llm.graph import components

    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 102)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 102, 200: 102}
