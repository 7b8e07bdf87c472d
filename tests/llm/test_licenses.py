import re

from tidemark.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = dict(L.TEMPLATES)["mit-text"]
TEXTS = [
    "", None, "Released under the MIT License.", "mit  LICENSE mit-license, MIT licensed", "the Apache license and the GNU General Public License", "general public", f"code\n{MIT}\nmore", MIT.replace("without limitation", "with no new and odd limit"),
    " ".join(MIT.split()[:12]), "İ MIT License ÉTÉ mit license", "mit license " * 20_000, "!!!", "Licensed under the Apache License, Version 2.0.",
]


def brute(text):
    w = WORD.findall((text or "").translate(str.maketrans(L.CAPITALS, L.SMALL)))
    hits = [(j, label) for p, label in L.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
    at = [j for j, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in hits}))


def test_base_as_by_brute_force(docs_of):
    rows = {r.doc_id: r for r in L.scan(docs_of(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text and text[:60]
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates(docs_of):
    rows = {r.doc_id: r for r in L.scan(docs_of(TEXTS)).collect()}
    labels = lambda i: rows[i].labels.split(",")
    assert "mit-text" in labels(6) and "mit-text" in labels(7)  # an edit moves the words to a neighbouring diagonal
    assert rows[8].labels == "" and rows[8].score == 0
    assert labels(2) == ["mit", "mit-notice"] and labels(12) == ["apache", "apache-2.0-notice"]


def test_repeated_rows_and_empty_table(docs_of):
    docs = docs_of([(1, TEXTS[2]), (1, TEXTS[2]), (None, TEXTS[2])])
    assert [(r.doc_id, r.n_base) for r in L.scan(docs).orderBy("doc_id").collect()] == [(None, 1), (1, 1), (1, 1)]
    assert L.scan(docs.where("false")).count() == 0


def test_templates_as_by_brute_force(docs_of):
    """Every run of K words against every place of every template, diagonal by diagonal; several templates may share a text."""
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(40):
        words = rng.choice(L.TEMPLATES)[1].split()
        lo = rng.randint(0, len(words) // 2)
        kept = [w for w in words[lo : lo + rng.randint(3, 80)] if rng.random() > 0.08]
        for _ in range(rng.randint(0, 3)):
            kept.insert(rng.randint(0, len(kept)), "odd")
        texts.append(" ".join(["said", *kept, *(rng.choice(L.TEMPLATES)[1].split()[:30] if rng.random() < 0.3 else []), "end"]))

    def marks(text):
        w = WORD.findall(text.translate(str.maketrans(L.CAPITALS, L.SMALL)))
        labels, best = {v for p, v in L.BASE.items() if f" {p} " in f" {' '.join(w)} "}, 0.0
        score = 1.0 if labels else 0.0
        for label, template in L.TEMPLATES:
            t = WORD.findall(template.translate(str.maketrans(L.CAPITALS, L.SMALL)))
            votes = sorted({(i - j, j) for i in range(len(w) - L.K + 1) for j in range(len(t) - L.K + 1) if w[i : i + L.K] == t[j : j + L.K]})
            last, held = None, set()
            for d, j in votes:
                if last is not None and d - last > L.APART:
                    held = set()
                held.add(j)
                last = d
                share = len(held) / (len(t) - L.K + 1)
                if share >= L.COVERED:
                    labels.add(label)
                    best = max(best, share)
        return ",".join(sorted(labels)), max(score, best)

    for r in L.scan(docs_of(texts)).collect():
        labels, score = marks(texts[r.doc_id])
        assert r.labels == labels and abs(r.score - score) < 1e-12, texts[r.doc_id]
