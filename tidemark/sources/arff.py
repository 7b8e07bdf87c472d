"""ARFF files, dense and sparse, read and written with Spark's own text source.

Header lines begin with @ and are few; they give the schema: numbers, nominal values, strings, and dates with their pattern.  All
other lines are rows: they are parsed in the JVM, so any file system that Spark reads will do.  Fields are parted by commas outside
quotes.  A `?`, an empty field, what is no number and no date are null; a label that the header does not list is null and
counted in `bad_labels`; a row with a wrong number of fields, or an index that is none, is null throughout and counts with all
its attributes there.  An index that a sparse row leaves out is 0, the first label, or null (strings, dates).

`arff_source` is the same as a data source of Spark, with streams, ranges of files, the order of rows and strict modes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Attribute:
    name: str
    labels: list[str] | None = None
    kind: str = "numeric"
    pattern: str = ""

    @property
    def metadata(self) -> dict:
        return {"kind": "nominal", "labels": self.labels} if self.labels is not None else {"kind": self.kind}


_ITEM = r"'[^']*'|\"[^\"]*\"|[^,\s{}]+"
#: A value in quotes, with escapes; a field after its comma; a pair of a sparse row after its comma, as index (empty: it is none) and value.
_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_FIELD, _PAIR = rf",\s*({_QUOTED}|[^,]*?)\s*(?=,|$)", rf",\s*(?:([0-9]+)\s+({_QUOTED}|[^,]*?)|[^,]*?)\s*(?=,|$)"
_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", re.IGNORECASE)


def unquoted(s: str) -> str:
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s


def header(spark: SparkSession, path: str, glob: str = "*.arff") -> tuple[str, list[Attribute]]:
    """(relation, attributes) of the first file by path that has header lines.

    That is nearly always the first file, and then only this one is read.
    """
    lines = _lines(spark, path, glob).where(F.trim("value").startswith("@"))
    told = lambda *names: lines.where(F.col("file").isin(*names)).select("value", F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    first = min(lines.inputFiles(), default=None)
    # Spark names a local file with one slash or three
    rows = told(first, first.replace(":///", ":/", 1)) if first else []
    if not rows and (least := lines.agg(F.min("file")).first()[0]) is not None:
        rows = told(least)
    if not rows:
        raise ValueError(f"no ARFF header in {path}")
    relation, found = "", []
    # a line per attribute, in the order of the file
    for r in rows:
        text = r.value.strip()
        m = _ATTRIBUTE.match(text)
        if m:
            kind = m[2].strip()
            if kind.startswith("{"):
                found.append(Attribute(unquoted(m[1]), [unquoted(x.strip()) for x in re.findall(_FIELD, "," + kind.strip("{} "))], "nominal"))
            else:
                word, _, rest = kind.partition(" ")
                kinds = {"string": "string", "date": "date"}
                found.append(Attribute(unquoted(m[1]), None, kinds.get(word.lower(), "numeric"), unquoted(rest.strip()) or "yyyy-MM-dd'T'HH:mm:ss"))
        elif text.lower().startswith("@relation"):
            relation = unquoted(text.split(None, 1)[1].strip()) if len(text.split(None, 1)) > 1 else ""
    return relation, found


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob) if glob and not path.endswith(".arff") else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read(spark: SparkSession, path: str, class_index: int = -1, glob: str = "*.arff") -> DataFrame:
    """A column per attribute (the class, if any, last and named as in the header), and `bad_labels`.

    `class_index`: -1 the last attribute, 0 none, k the k-th.
    """
    _, found = header(spark, path, glob)
    text = F.trim("value")
    rows = _lines(spark, path, glob).where((text != "") & ~text.startswith("%") & ~text.startswith("@")).select(text.alias("t"))
    sparse = F.col("t").startswith("{")
    inner = F.trim(F.regexp_replace("t", r"^\{|\}$", ""))
    all_of = lambda text, pattern, part: F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(pattern), F.lit(part))
    # each row is taken apart once: a select of its own for what is used more than once, as Spark joins no such selects
    rows = rows.select("t", sparse.alias("sparse"), F.when(~sparse, all_of(F.col("t"), _FIELD, 1)).alias("v"), F.when(sparse, inner).alias("inner"))
    of_pairs = lambda part: F.when(F.col("inner") != "", all_of(F.col("inner"), _PAIR, part)).when(F.col("inner") == "", F.array().cast("array<string>"))
    # backwards, as the last of several pairs of an index counts
    rows = rows.select("t", "sparse", "v", F.reverse(F.transform(of_pairs(1), lambda k: k.try_cast("int"))).alias("keys"), F.reverse(of_pairs(2)).alias("told"))
    fine = F.when(~F.col("sparse"), F.size("v") == len(found)).otherwise(F.col("t").endswith("}") & F.forall("keys", lambda k: F.coalesce(k < len(found), F.lit(False))))
    rows = rows.select("sparse", "v", "keys", "told", fine.alias("fine"))
    raws = []
    for k, a in enumerate(found):
        default = F.lit("0.0") if a.kind == "numeric" else F.lit(a.labels[0]) if a.labels else F.lit(None)
        at = F.array_position("keys", F.lit(k))
        pair = F.when(at > 0, F.trim(F.get("told", (at - 1).cast("int")))).otherwise(default)
        raws.append(F.when(F.col("fine"), F.when(F.col("sparse"), pair).otherwise(F.get("v", k))).alias(f"_{k}"))
    rows = rows.select("fine", *raws)

    def bare(raw: Column) -> Column:
        quoted = (raw.startswith("'") | raw.startswith('"')) & raw.rlike(r"^(['\"]).*\1$")
        return F.when((raw != "?") & (raw != ""), F.when(quoted, F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")).otherwise(raw))

    rows = rows.select("fine", *(bare(F.col(f"_{k}")).alias(f"_{k}") for k in range(len(found))))
    columns, bad = [], F.lit(0)
    for k, a in enumerate(found):
        raw = F.col(f"_{k}")
        if a.labels is not None:
            known: Column = raw.isin(a.labels)
            bad = bad + F.coalesce((~known).cast("int"), F.lit(0))
            columns.append(F.when(known, raw).alias(a.name, metadata=a.metadata))
        else:
            value = raw if a.kind == "string" else F.try_to_timestamp(raw, F.lit(a.pattern)) if a.kind == "date" else raw.try_cast("double")
            columns.append(value.alias(a.name, metadata=a.metadata))
    bad = F.when(F.col("fine"), bad).otherwise(len(found))
    at = len(found) - 1 if class_index == -1 else class_index - 1
    if class_index != 0:
        columns.append(columns.pop(at))
    return rows.select(*columns, bad.alias("bad_labels"))


def to_arff(df: DataFrame, relation: str = "data") -> str:
    """The header for a DataFrame; nominal columns keep their labels."""
    out = [f"@relation {relation}"]
    for f in df.schema.fields:
        labels = f.metadata.get("labels")
        out.append(f"@attribute {f.name} " + ("{" + ",".join(labels) + "}" if labels else "numeric"))
    return "\n".join([*out, "@data"])


def write(df: DataFrame, path: str, relation: str = "data") -> None:
    """Text files, each of which begins with the header, so that each is an ARFF file by itself."""
    row = F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in df.columns))
    head = to_arff(df, relation).split("\n")

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    df.select(row.alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)
