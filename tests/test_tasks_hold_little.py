"""What meets in one task: the rows of a curve, not those it is made of."""

from pyspark.sql import functions as F

from tidemark.streaming import stateful


def test_a_curve_is_made_in_many_tasks_and_written_in_one(spark, tmp_path):
    at = spark.sparkContext.accumulator(0)

    def told(frames):
        from pyspark import TaskContext

        at.add(1 << TaskContext.get().partitionId())
        yield from frames

    stateful.dump_curve(spark.range(0, 40, 1, 4).mapInPandas(told, "id long").select("id", F.lit(1.5).alias("v")), str(tmp_path / "c"))
    assert at.value == 15  # tasks 0 to 3, once each
    assert len(list((tmp_path / "c").glob("part-*"))) == 1


def test_an_arff_row_is_taken_apart_once(spark, tmp_path):
    """Whatever the number of attributes, and where a sparse row's index stands twice or is none; the header is read from its file only."""
    from tidemark.sources import arff

    names = [f"a{k}" for k in range(12)]
    (tmp_path / "a.arff").write_text("@relation r\n" + "".join(f"@attribute {n} {'{u,v}' if n == 'a1' else 'string' if n == 'a2' else 'numeric'}\n" for n in names) + "@data\n")
    (tmp_path / "b.arff").write_text("@attribute other numeric\n{0 1.5, 1 v, 0 2.5}\n{ 2 'x, y 3' , 11   7 }\n{}\n{1 w}\n{3}\n{12 1}\n{99999999999 1}\n{0 ?,2 \"it\\'s\"}\n{0 1,}\n")
    df = arff.read(spark, str(tmp_path), class_index=0)
    assert df.columns == [*names, "bad_labels"]
    got = [(r.a0, r.a1, r.a2, r.a11, r.bad_labels) for r in df.collect()]
    wrong = (None, None, None, None, 12)
    assert got == [(2.5, "v", None, 0.0, 0), (0.0, "u", "x, y 3", 7.0, 0), (0.0, "u", None, 0.0, 0), (0.0, None, None, 0.0, 1), wrong, wrong, wrong, (None, "u", "it's", 0.0, 0), wrong]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_extract") <= 3  # fields, indexes and values


def test_the_row_before_is_found_without_a_sort_beside_the_windows(spark):
    """The last rows of blocks come from a hash aggregate; null values, null orders and gaps as before."""
    from tidemark.operators.ordered import previous

    data = [(i, None if i % 7 == 3 else i % 5) for i in range(100)]
    rows = spark.createDataFrame(data, "i long, y int").repartition(3)
    df = previous(rows, "i", "y", 9, block=10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
    got = {r.i: r.previous for r in df.collect()}
    assert got == {i: 9 if i == 0 or data[i - 1][1] is None else data[i - 1][1] for i, _ in data}
    nulls = previous(rows.unionByName(spark.createDataFrame([(None, 4)], "i long, y int")), "i", "y", 9, block=10)
    got = {r.i: r.previous for r in nulls.collect()}
    assert got[None] == 9 and got[0] == 4 and len(got) == 101
