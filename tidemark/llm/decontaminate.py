"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Text becomes tokens (letters or digits, lower case); numbers, units after numbers, and names
(capitalised words inside a sentence) become typed placeholders.  Runs of WINDOW tokens of every
document, both templates and plain tokens, are hash-joined to those of the benchmark items; the hits
of a document and an item on one diagonal (document position less item position) are taken together.
A document is contaminated by an item if a diagonal covers at least COVERED of the item's tokens and
the slots are consistent: each filler of the item stands for one filler in the document throughout.
So a question asked again with other numbers, names or units is caught, and a chance likeness of forms
with unrelated fillers is not.  Runs that agree token by token, in any case, need no consistent slots.
If windows with fewer than LITERALS words are needed to cover enough, at least COVERED of the item's
words (or as many fillers that agree) must be among what is covered, and one of them at least: a form
without any word is matched by its plain tokens alone.

Defined results: null and empty texts match nothing; items without tokens are left out, items of fewer
than WINDOW tokens are one window; rows that share a doc_id are judged text by text, and reported by the
text that covers most; rows with a null doc_id cannot be named and are kept; ties between spans go to the one
that covers more, then to the earlier; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table, unused

WINDOW, COVERED = 8, 0.5
#: Tokens of a window that are not placeholders, for its form to count without a look at the item's words.
LITERALS = 4
#: Windows of the benchmark, tokens of its items, or ids of documents, that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Units that can follow a number, and the signs that mark a name, a number, a unit and a decimal sign.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|yd|miles|meters|metres|feet|inches|l|ml|liters|litres|gallons|h|hr|hrs|hours|min|mins|minutes|s|sec|seconds|days|weeks|months|years|mph|kmh|usd|eur|dollars|euros|cents|percent|degrees|kw|kwh|w|v|hz|khz|mhz|ghz|kb|mb|gb|tb|pounds|grams|kilograms|kilometers|kilometres|centimeters|centimetres"
NAME, NUMBER, UNIT, DECIMAL = "\x02", "\x03", "\x04", "\x05"


def marked(text: Column) -> Column:
    """Lower-case text in which every filler is a token of its own that begins with its type's sign."""
    out = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT + DECIMAL, "    ")
    out = F.regexp_replace(out, r"(?<=[0-9])[.,](?=[0-9])", DECIMAL)
    out = F.regexp_replace(out, r"(\p{Lu})(?<=[^.!?:\s] .)(\p{Ll}+)(?!\p{L})", f" {NAME}$1$2 ")
    out = F.regexp_replace(out, rf"([0-9][0-9{DECIMAL}]*)\s?((?i:{UNITS}))(?![\p{{L}}0-9])", f" {NUMBER}$1 {UNIT}$2 ")
    out = F.regexp_replace(out, rf"(?<![0-9{NUMBER}{DECIMAL}])([0-9][0-9{DECIMAL}]*)", f" {NUMBER}$1 ")
    return F.lower(out)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, rf"[^\p{{L}}0-9{NAME}-{DECIMAL}]+"), lambda t: t != "")


def kind(token: Column) -> Column:
    """A filler's sign, any other token as it is.  Signs sort before all that other tokens begin with."""
    return F.when(token < DECIMAL, F.substring(token, 1, 1)).otherwise(token)


def plain(token: Column) -> Column:
    """A token without its sign."""
    return F.when(token < DECIMAL, F.substring(token, 2, 1 << 30)).otherwise(token)


def windows(hashes: Column, size: int) -> Column:
    """Hashes of the runs of `size` token hashes, in order."""
    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size))))


def keys(said: DataFrame, size: int) -> DataFrame:
    """at, key, exact for each window of the column `raw`: its template, and its plain tokens where they differ from that."""
    rest = [c for c in said.columns if c != "raw"]
    hashed = said.select(*rest, F.transform("raw", lambda t: F.xxhash64(kind(t))).alias("k"), F.transform("raw", lambda t: F.xxhash64(plain(t))).alias("r"))
    both = hashed.select(*rest, windows(F.col("k"), size).alias("k"), windows(F.col("r"), size).alias("r"))
    other = F.zip_with("k", "r", lambda a, b: F.when(a != b, b))
    places = both.select(*rest, F.size("k").alias("m"), other.alias("other"), "k").select(*rest, "m", "other", F.posexplode(F.concat("k", "other")).alias("pos", "key")).where("key is not null")
    at = F.pmod("pos", "m")
    return places.select(*rest, at.alias("at"), "key", ((F.col("pos") >= F.col("m")) | F.get("other", at).isNull()).alias("exact"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, raw tokens, template tokens, number of tokens."""
    rows = benchmark.select("item_id", tokens(marked(F.col("text"))).alias("raw")).where("item_id is not null")
    rows = rows.select("item_id", "raw", F.transform("raw", kind).alias("kinds"))
    return rows.withColumn("n", F.size("kinds")).where("n > 0")


def _bounded(df: DataFrame, size: Column | None = None) -> DataFrame:
    """`df`, to be broadcast if its rows, or what they hold by `size`, are few enough for that."""
    df = checkpointed(df)
    held = df.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_ROWS else df


#: A text of a document; its digest tells only the texts of one doc_id apart.
TEXT = ["doc_id", "digest"]
GROUP = [*TEXT, "item_id", "n", "span"]


def _digest() -> Column:
    return F.xxhash64("text").alias("digest")


def grouped(diagonals: DataFrame) -> DataFrame:
    """The diagonals of spans that may cover enough; a span is a run of neighbouring diagonals of a document and an item."""
    by = W.partitionBy(*TEXT, "item_id", "n").orderBy("diagonal")
    apart = F.greatest(F.lit(WINDOW), F.col("n") * (1 - COVERED))
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > apart).cast("int"), F.lit(1))
    diagonals = checkpointed(diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(by)).drop("new"))
    enough = diagonals.select(*GROUP, F.explode("under").alias("p")).groupBy(*GROUP).agg(F.countDistinct("p").alias("covered")).where(F.col("covered") >= COVERED * F.col("n"))
    return diagonals.join(enough.select(GROUP), GROUP, "left_semi")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest, item_id, start (token), covered, item_tokens, coverage: one row per text and item."""
    items = checkpointed(items_of(benchmark))
    sizes = sorted(r.w for r in items.select(F.least("n", F.lit(WINDOW)).alias("w")).distinct().collect())  # WINDOW at most
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(), "text").where("doc_id is not null")
    said = source.select(*TEXT, tokens(marked(F.col("text"))).alias("raw"))
    hits = None
    for size in sizes:
        own = keys(items.where(F.least("n", F.lit(WINDOW)) == size).select("item_id", "n", "raw"), size)
        own = own.select("key", "item_id", "n", F.col("at").alias("item_at"), (F.col("at") * 2 + F.col("exact").cast("int")).alias("place"))
        found = keys(said, size).select(*TEXT, "at", "key").join(_bounded(own), "key")
        found = found.select(*TEXT, "item_id", "n", (F.col("at") - F.col("item_at")).alias("diagonal"), "place", F.lit(size).alias("size"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, digest long, item_id long, start int, covered int, item_tokens int, coverage double")
    # no more places than twice the item's tokens in a group; an odd place is one that agrees token by token
    diagonals = hits.groupBy(*TEXT, "item_id", "n", "size", "diagonal").agg(F.collect_set("place").alias("places"))
    under = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + F.col("size") - 1))))
    ats = F.array_distinct(F.transform("places", lambda p: F.shiftright(p, 1)))
    exact = F.transform(F.filter("places", lambda p: p % 2 == 1), lambda p: F.shiftright(p, 1))
    diagonals = diagonals.select(*TEXT, "item_id", "n", "size", "diagonal", ats.alias("ats"), exact.alias("exact"))
    diagonals = grouped(diagonals.withColumn("under", under(F.col("ats"))))
    # slots: positions of the item under the windows, with their fillers
    filler = lambda p: F.get("kinds", p) < DECIMAL
    literals = lambda p: F.size(F.filter(F.slice("kinds", p + 1, F.col("size")), lambda k: k >= DECIMAL))
    wordy = F.filter("ats", lambda p: literals(p) >= F.least(F.lit(LITERALS), F.col("size")))
    diagonals = diagonals.join(_bounded(items.select("item_id", "raw", "kinds"), F.size("raw")), "item_id").withColumn("wordy", wordy)
    diagonals = checkpointed(diagonals.withColumn("slots", F.filter("under", filler)).withColumn("firm", F.filter(under(F.col("wordy")), filler)))
    alike = F.size(F.array_except("ats", "exact")) == 0
    slotted = diagonals.where(~alike)
    fills = _bounded(slotted.select("doc_id").distinct())
    texts = source.join(fills, "doc_id").dropDuplicates(TEXT).select(*TEXT, tokens(marked(F.col("text"))).alias("said"))
    pair = lambda p: F.struct(F.get("raw", p).alias("item"), plain(F.get("said", p + F.col("diagonal"))).alias("doc"))
    pairs = F.array_distinct(F.transform("slots", pair))
    agree = lambda c: F.size(c) == F.size(F.array_distinct(F.transform(c, lambda q: q["item"])))
    held = slotted.join(texts, TEXT).select(*TEXT, "item_id", "diagonal", pairs.alias("pairs"), F.array_distinct(F.transform("firm", pair)).alias("firm"))
    held = held.groupBy(*TEXT, "item_id", "diagonal").agg(F.max(agree(F.col("pairs"))).alias("held"), F.max(agree(F.col("firm"))).alias("some"))
    # where slots conflict, the windows of enough words count if theirs do not, and else only what agrees token by token
    judged = diagonals.join(held, [*TEXT, "item_id", "diagonal"], "left").withColumn("ats", F.when(F.col("held") | alike, F.col("ats")).when(F.col("some"), F.array_union("wordy", "exact")).otherwise(F.col("exact")))
    strong = F.filter("ats", lambda p: F.array_contains("exact", p) | (literals(p) >= F.least(F.lit(LITERALS), F.col("size"))))
    judged = judged.select(*GROUP, "diagonal", "kinds", F.size(F.filter("kinds", lambda k: k >= DECIMAL)).alias("words"), under(F.col("ats")).alias("all"), under(strong).alias("strong"), under(F.col("exact")).alias("exact"))
    each = judged.select(*GROUP, "words", F.explode(F.transform("all", lambda p: F.struct(p.alias("p"), F.col("diagonal").alias("diagonal"), F.array_contains("strong", p).alias("strong"), (~filler(p) | F.array_contains("exact", p)).alias("agrees")))).alias("at"))
    count = lambda c: F.countDistinct(F.when(c, F.col("at.p"))).cast("int")
    out = each.groupBy(*GROUP, "words").agg(count(F.lit(True)).alias("covered"), count(F.col("at.strong")).alias("strong"), count(F.col("at.agrees")).alias("agrees"), F.min(F.struct("at.p", "at.diagonal"))["diagonal"].alias("diagonal"))
    enough = (F.col("strong") >= COVERED * F.col("n")) | (F.col("covered") >= COVERED * F.col("n")) & (F.col("agrees") > 0) & (F.col("agrees") >= COVERED * F.col("words"))
    best = W.partitionBy(*TEXT, "item_id").orderBy(F.col("covered").desc(), "diagonal")
    out = out.where(enough).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return out.select(*TEXT, "item_id", F.greatest("diagonal", F.lit(0)).alias("start"), "covered", F.col("n").alias("item_tokens"), (F.col("covered") / F.col("n")).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (token), covered, item_tokens, coverage: one row per leak."""
    best = W.partitionBy("doc_id", "item_id").orderBy(F.col("covered").desc(), "start", "digest")
    return _leaks(docs, benchmark).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "digest")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text no item contaminates, columns as they are."""
    doc, own = unused(docs, "_doc"), unused(docs, "_digest")
    gone = _bounded(_leaks(docs, benchmark).select(F.col("doc_id").alias(doc), F.col("digest").alias(own)).distinct())
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(own)), "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
