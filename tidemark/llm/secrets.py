"""Secret scan: fixed patterns, and a token-efficiency test for strings that look random.

Text that people write compresses well under a byte-pair vocabulary; a random string does not.  A
candidate is a run of 20 or more key characters that mixes at least two of lower case, upper case
and digits.  Digests of known lengths, UUIDs and plain identifiers (words joined by separators or
by camel case) are left out, and so is what a base pattern covers already; each part of a run beside
that, of 20 or more characters, is a candidate of its own.  The rest is reported where it has fewer than `max_ratio` characters per token.

Defined results: a null text is the empty text and has no spans (the digest of the empty string);
other columns of the input, nulls and repeated rows included, pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps_caches, short_batches, table, turn_of

#: The base patterns and the least lengths of what they take.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 or more characters
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

MAX_RATIO = 1.9
LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
DIGESTS = {32, 40, 56, 64, 96, 128}
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
IDENTIFIER = re.compile(r"([A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}|[_/=+-])+")
MASK = "<secret>"

_vocabularies: dict = {}
keeps_caches("secrets", _vocabularies.clear)


def _vocabulary(path: str):
    if path not in _vocabularies:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def looks_random(run: str, path: str, max_ratio: float = MAX_RATIO) -> bool:
    mixed = any(c.islower() for c in run) + any(c.isupper() for c in run) + any(c.isdigit() for c in run)
    if mixed < 2 or len(run) in DIGESTS and HEX_ONLY.fullmatch(run) or UUID.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    return len(run) < max_ratio * len(_vocabulary(path).encode_ordinary(run))


def uncovered(start: int, end: int, spans: list[tuple[int, int]]):
    """The parts of [start, end) outside the sorted spans."""
    for a, b in spans:
        if a >= end:
            break
        if b > start:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def find(text: str, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if max(map(len, text.split()), default=0) >= 20:  # no run is longer than a chunk between white space
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
        base = sorted((a, b) for _, a, b in spans)
        parts = (p for m in CANDIDATE.finditer(text) for p in uncovered(*m.span(), base) if p[1] - p[0] >= LEAST)
        spans += [("random", a, b) for a, b in parts if looks_random(text[a:b], path, max_ratio)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, joined where they overlap, replaced by MASK."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, path: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id -> counts by kind, digest of the base spans, all spans."""
    short_batches(docs.sparkSession)

    def run(batches):
        turn_of("secrets")
        for batch in batches:
            found = [find(x or "", path, max_ratio) for x in batch.column(1).to_pylist()]
            base = [said([s for s in x if s[0] != "random"]) for x in found]
            counts = [pa.array([sum(s[0] == kind for s in x) for x in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([said(x) for x in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(docs: DataFrame, path: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """documents with every secret masked; n_chars, where there, follows the text."""
    short_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        turn_of("secrets")
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            new = [x and masked(x, find(x, path, max_ratio)) for x in texts]
            columns[at] = pa.array(new, columns[at].type)
            if counted is not None:
                n = columns[counted].to_pylist()
                columns[counted] = pa.array([k if a == b else len(b) for k, a, b in zip(n, texts, new)], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
