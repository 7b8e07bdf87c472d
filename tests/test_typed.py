"""Typed streaming state: over several micro-batches and a restart as the batch form, and idle keys are forgotten."""

import random

import pytest

from tidemark.operators import drift
from tidemark.storage import fresh_folder
from tidemark.streaming import typed

SCHEMA = "k string, i long, x double, y string, pred string"


def rows(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice(["a", "a", "b", "c"])
        p = 0.1 if i < n // 2 else 0.7
        hit = rng.random() > p
        out.append((k, i, float(not hit) if rng.random() < 0.97 else None, "u", "u" if hit else "v"))
    return out


def put(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, made, name="out"):
    with typed.rocksdb(spark):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = made(stream).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


@pytest.mark.parametrize("name", ["adwin", "ddm", "ewma"])
def test_detectors_over_micro_batches_and_a_restart_are_the_batch_form(spark, name):
    data, folder = rows(900), fresh_folder(spark, "t")
    detector = drift.adwin(delta=0.05) if name == "adwin" else getattr(drift, name)()
    made = lambda s: typed.detect(s, "k", "i", "x", detector)
    for k in range(0, 600, 150):
        put(spark, folder, random.Random(k).sample(data[k : k + 150], 150))
    run(spark, folder, made)
    put(spark, folder, data[600:])
    put(spark, folder, [("a", 5, 1.0, "u", "v"), ("new", 5, 0.0, "u", "u")])
    got = run(spark, folder, made).collect()
    want = drift.detect(spark.createDataFrame(data, SCHEMA), "k", "i", "x", detector).collect()
    told = lambda r: (r.k, r.i, r.change, r.warning, r.estimate)
    assert sorted(told(r) for r in got if not r.late and r.k != "new") == sorted(told(r) for r in want)
    assert any(r.change for r in want)
    assert [(r.k, r.i, r.change) for r in got if r.late] == [("a", 5, None)] and sum(r.k == "new" for r in got) == 1
    assert spark.conf.get(typed.PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or spark.conf.get(typed.PROVIDER, None) is None


@pytest.mark.parametrize("state", [[0, []], [64, [[[1.0, 0.0]], [[2.0, 0.5], [3.0, 0.1]]]], [1.0, 2.5, 3.0]])
def test_states_are_flat_and_deep(state):
    like = [0, []] if isinstance(state[1], list) else [1.0, 1.0, 1.0]
    assert typed.deep(*typed.flat(state), like) == state


def test_accuracy_from_a_ring(spark):
    data, folder = rows(400), fresh_folder(spark, "t")
    for k in range(0, 400, 100):
        put(spark, folder, data[k : k + 100])
    got = run(spark, folder, lambda s: typed.windowed_accuracy(s, "k", "i", "y", "pred", 7))
    ring, want = {}, []
    for k, i, _, y, pred in data:
        held = ring.setdefault(k, [])
        held.append(y == pred)
        want.append((k, i, sum(held[-7:]) / len(held[-7:]), False))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_idle_keys_are_forgotten(spark):
    """By event time: b rests longer than it may, so its detector starts anew; a goes on."""
    folder = fresh_folder(spark, "t")
    one = drift.Detector([0.0], lambda s, x: ([s[0] + 1], False, False, s[0] + 1))
    put(spark, folder, [("a", 1000, 1.0, "", ""), ("b", 1000, 1.0, "", "")])
    for t in (4000, 8000, 12_000, 16_000):
        put(spark, folder, [("a", t, 1.0, "", "")])
    put(spark, folder, [("a", 20_000, 1.0, "", ""), ("b", 20_001, 1.0, "", "")])

    def made(stream):
        timed = stream.selectExpr("*", "timestamp_millis(i) as ts").withWatermark("ts", "0 seconds")
        return typed.detect(timed, "k", "i", "x", one, idle=5000, event_time="ts")

    got = {(r.k, r.i): r.estimate for r in run(spark, folder, made).collect()}
    assert got["a", 20_000] == 6.0 and got["b", 20_001] == 1.0


def test_the_sql_of_the_adaptive_window_is_the_window():
    """Where it shrinks, too: SQL and steps on a table whose values turn."""
    import duckdb
    import pandas as pd

    from tidemark.plans.drift import _adwin

    rng = random.Random(8)
    data = [(u, i, rng.random() + (0 if i < 100 + 20 * u else 3 * (u % 3))) for u in range(5) for i in range(300)]
    con = duckdb.connect()
    con.register("events", pd.DataFrame(data, columns=["user_id", "event_id", "value"]))
    got = {r[0]: r[1:] for r in con.execute(f"select user_id, changes, estimate from ({_adwin('value')})").fetchall()}
    for u in range(5):
        steps = list(drift.adwin().run([x for k, _, x in data if k == u]))
        assert got[u][0] == sum(c for c, _, _ in steps) and abs(got[u][1] - steps[-1][2]) < 1e-4
    assert sum(c for c, _ in got.values()) > 2


def test_many_keys_are_folded_in_one_call():
    """A call of Python is a group's, not a key's: keys keep apart, each with its state, also where pandas made floats of them."""
    import numpy as np
    import pandas as pd

    class State(dict):
        getValue = dict.get
        updateValue = dict.__setitem__

    one = typed.Detecting("k", "bigint", "i", drift.ddm())
    one.state = State()
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"k": rng.integers(0, 40, 30_000).astype(float), "i": rng.permutation(30_000), "x": (rng.random(30_000) < 0.3).astype(float)})
    data.loc[data.k == 7, "k"] = np.nan
    parts = [data[data.i < 9000], data[data.i >= 9000]]
    got = pd.concat([f for p in parts for f in one.handleInputRows((0,), iter([p[:5000], p[5000:]]), None)])
    assert len(got) == 30_000 and not got.late.any() and set(one.state) == {(k if k != 7 else None,) for k in range(40)}
    for k in (3, None):
        rows = data[data.k.isna() if k is None else data.k == k].sort_values("i")
        mine = got[got.k.isna() if k is None else got.k == k]
        assert mine.i.tolist() == rows.i.tolist()
        assert list(zip(mine.change, mine.warning, mine.estimate)) == list(drift.ddm().run(rows.x.tolist()))
    late = pd.concat(one.handleInputRows((0,), iter([pd.DataFrame({"k": [3, 99], "i": [5, 5], "x": [1.0, 1.0]})]), None))
    assert late.late.tolist() == [True, False]


def test_a_part_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tidemark import storage
    from tidemark.plans import drift as batch
    from tidemark.plans import flows

    rng = random.Random(9)
    data = [(i, rng.randrange(60), rng.choice(["error", "view", "click"])) for i in range(3000)]
    spark.createDataFrame(data, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(flows, "FILE", 300)
    files = []
    monkeypatch.setattr(flows, "removed", lambda s, folder: files.append(len([n for n in storage.names(s, f"{folder}/in") if n.startswith("part-")])))
    got = sorted(map(tuple, flows.QUERIES["stream_ddm_by_user"](spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, batch.QUERIES["ddm_by_user"](spark, str(tmp_path)).collect())) and len(got) == 60
    assert files[0] > flows.PARTS
