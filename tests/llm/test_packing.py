import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "   ", "It's a naïve café — 12 kg!!", "ΣΑΣ İstanbul ǅ \x1c b", "word " * 3000, "日本語 text ½ x²", "It's a naïve café — 12 kg!!", "<|endoftext|> is text", "\u0085 a b", "Ɨɨ ẞß ŉ", "x" * 5000]


def whole(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_tokens_are_those_of_the_whole_text():
    for text in [*TEXTS, *(chr(a) + chr(b) + "1" for a in range(0x21, 0x260, 5) for b in (0x61, 0x27, 0x39, 0xC9))]:
        assert P.token_bytes(text or "", PATH) == whole(text)[:-1].tobytes()


def brute_best(lengths, capacity):
    """Least number of sequences, by search."""
    best = [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                put(i + 1, bins)
                bins[k] -= lengths[i]
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_dominance_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = sorted((rng.randint(1, capacity) for _ in range(9)), reverse=True)
    counts = np.bincount(lengths, minlength=capacity + 1)
    rest = counts.copy()
    fixed = P.reduce_by_dominance(rest, capacity)
    left = [s for s in range(capacity, 0, -1) for _ in range(rest[s])]
    assert sum(t for t, _ in fixed) + brute_best(left, capacity) == brute_best(lengths, capacity)
    kinds = P.solve(counts, capacity)
    back = np.zeros(capacity + 1, int)
    for times, content in kinds:
        assert sum(s * n for s, n in content) <= capacity
        for s, n in content:
            back[s] += times * n
    assert (back == counts).all()


def test_best_fit_equals_best_fit_piece_by_piece():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 40) for _ in range(500)), reverse=True)
    rooms = []
    for s in lengths:
        fit = [k for k, r in enumerate(rooms) if r >= s]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        if k == len(rooms):
            rooms.append(50)
        rooms[k] -= s
    made = P.best_fit(np.bincount(lengths, minlength=51), 50)
    assert sum(t for t, _ in made) == len(rooms)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, docs_of, capacity):
    docs = docs_of(TEXTS)
    docs = docs.union(docs.where("doc_id = 3"))  # a repeated row
    rows = P.pack(docs, PATH, capacity, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.array(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length <= capacity and r.start == r.piece * capacity
        if r.doc_id != 3:
            by_doc.setdefault(r.doc_id, []).append((r.piece, ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.doc_id == 3 for r in rows) % 2 == 0
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert (np.concatenate([x for _, x in sorted(by_doc[i], key=lambda p: p[0])]) == whole(text)).all()
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def test_empty_table(docs_of):
    assert P.pack(docs_of(TEXTS).where("false"), PATH).count() == 0
