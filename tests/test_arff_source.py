"""ARFF as a data source: every odd row has a stated result, in batches and as a stream."""

import datetime

import pytest

from tidemark.sources import arff, arff_source

HEAD = """% a comment
@relation 'some data'
@attribute a numeric
@Attribute 'the b' {x, 'y z', "w"}
@attribute s string
@attribute d date "yyyy-MM-dd HH:mm"
@attribute n integer

@data
"""
ROWS = [
    "1,x,hello,'2024-01-02 03:04',7",
    "2.5, 'y z' , 'a, b', \"2024-01-02 03:04\" ,?",
    "?,?,?,?,?",
    "1,,hello,x,",
    "1,x,hello",
    "1,x,hello,'2024-01-02 03:04',7,8",
    "z,q,'it\\'s','2024-13-02 03:04',1e3",
    "{0 4, 1 'y z', 2 'p, q'}",
    "{}",
    "{9 1}",
    "{0 1",
    "% gone",
    "",
]


def put(tmp_path, text, name="a.arff"):
    (tmp_path / name).write_text(text)


@pytest.fixture(autouse=True)
def known(spark):
    arff_source.register(spark)


def load(spark, path, **options):
    return spark.read.format("arff").options(**options).load(str(path))


def test_every_row_has_a_stated_result(spark, tmp_path):
    put(tmp_path, HEAD + "\n".join(ROWS))
    df = load(spark, tmp_path, class_index=0)
    assert df.dtypes[:5] == [("a", "double"), ("the b", "string"), ("s", "string"), ("d", "timestamp_ntz"), ("n", "double")]
    assert df.schema["the b"].metadata["labels"] == ["x", "y z", "w"]
    got = [tuple(r)[:6] for r in df.orderBy("_offset").collect()]
    day = datetime.datetime(2024, 1, 2, 3, 4)
    assert got == [
        (1.0, "x", "hello", day, 7.0, None),
        (2.5, "y z", "a, b", day, None, None),
        (None, None, None, None, None, None),
        (1.0, None, "hello", None, None, "the b is empty; d is no such date; n is empty"),
        (None, None, None, None, None, "3 fields instead of 5"),
        (None, None, None, None, None, "6 fields instead of 5"),
        (None, None, "it's", None, 1000.0, "a is no number; the b has no such label; d is no such date"),
        (4.0, "y z", "p, q", None, 0.0, None),
        (0.0, "x", None, None, 0.0, None),
        (None, None, None, None, None, "no attribute '9'"),
        (None, None, None, None, None, "a brace that does not close"),
    ]
    assert load(spark, tmp_path, mode="drop").count() == 5
    assert load(spark, tmp_path).columns[:5] == ["a", "the b", "s", "d", "n"] and load(spark, tmp_path, class_index=2).columns[:5] == ["a", "s", "d", "n", "the b"]
    with pytest.raises(Exception, match="the b is empty"):
        load(spark, tmp_path, mode="failfast").collect()


def test_ranges_lose_and_repeat_nothing(spark, tmp_path):
    for f in range(3):
        put(tmp_path, HEAD + "".join(f"{f * 1000 + i},x,'{'é' * (i % 40)}',?,{i}\n" for i in range(150)), f"f{f}.arff")
    for size in (97, 1000, 1 << 20):
        df = load(spark, tmp_path, range_bytes=size)
        rows = df.orderBy("_file", "_offset").collect()
        assert [r.a for r in rows] == [f * 1000.0 + i for f in range(3) for i in range(150)] and all(len(r.s) == int(r.n) % 40 for r in rows)
        if size == 1000:
            assert df.rdd.getNumPartitions() > 8


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="NotFound|No such|not found|missing"):
        load(spark, tmp_path / "missing").schema
    with pytest.raises(Exception, match="no ARFF files"):
        load(spark, tmp_path).schema
    put(tmp_path, "@relation x\n@attribute a numeric\n")
    with pytest.raises(Exception, match="without @data"):
        load(spark, tmp_path).schema
    put(tmp_path, HEAD + ROWS[0])
    put(tmp_path, HEAD.replace("integer", "string") + ROWS[0], "b.arff")
    with pytest.raises(Exception, match="other attributes"):
        load(spark, tmp_path).collect()
    with pytest.raises(Exception, match="no such type"):
        arff_source.attribute("@attribute a relational")


def test_a_stream_reads_each_file_once_over_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, HEAD + ROWS[0], "b.arff")
    put(source, HEAD + ROWS[1], "c.arff")

    def run():
        stream = spark.readStream.format("arff").load(str(source))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1.0, 2.5]
    put(source, HEAD + "9,x,s,?,1", "a.arff")
    assert run() == [1.0, 2.5, 9.0] and run() == [1.0, 2.5, 9.0]


def test_what_the_library_writes_is_read(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "u"), (None, "v"), (3.0, None)], "a double, c string").selectExpr("a", "c")
    df = df.withMetadata("c", {"labels": ["u", "v"]})
    arff.write(df.repartition(2), str(tmp_path / "w"))
    assert sorted(map(str, load(spark, tmp_path / "w").select("a", "c").collect())) == sorted(map(str, df.collect()))


def test_the_text_reader_is_as_strict(spark, tmp_path):
    put(tmp_path, HEAD + "\n".join(ROWS))
    df = arff.read(spark, str(tmp_path), class_index=0)
    got = [(r.a, r["the b"], r.s, str(r.d) if r.d else None, r.n, r.bad_labels) for r in df.collect()]
    day = "2024-01-02 03:04:00"
    assert got == [
        (1.0, "x", "hello", day, 7.0, 0), (2.5, "y z", "a, b", day, None, 0), (None, None, None, None, None, 0), (1.0, None, "hello", None, None, 0), (None, None, None, None, None, 5),
        (None, None, None, None, None, 5), (None, None, "it's", None, 1000.0, 1), (4.0, "y z", "p, q", None, 0.0, 0), (0.0, "x", None, None, 0.0, 0), (None, None, None, None, None, 5), (None, None, None, None, None, 5),
    ]
