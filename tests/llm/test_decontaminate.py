import random

import pytest

from tidemark.llm import decontaminate as D

ITEM = "A train leaves Paris at 9 and then goes 120 km to meet John who waits for 3.5 hours near the old bridge while Mary counts 9 birds."
SAME = "Hello there. A train leaves London at 7 and then goes 88 km to meet Peter who waits for 2 hours near the old bridge while Susan counts 7 birds. End"


@pytest.fixture
def benchmark(spark):
    def make(items):
        return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, lang string")

    return make


def found(out):
    return sorted((r.doc_id, r.item_id) for r in out.collect())


def test_reparameterised_questions(docs_of, benchmark):
    docs = docs_of([(1, SAME), (2, SAME.replace("counts 7", "counts 5")), (3, None), (4, ""), (5, "well, a short one here"), (6, "A TRAIN LEAVES"), (None, ITEM), (8, "junk " * 30_000 + ITEM.upper()), (8, "nothing")])
    items = benchmark([(1, ITEM), (2, "Short one"), (3, None), (4, ""), (None, ITEM)])
    # a copy in capitals has no names to see, but enough of the item is there as it stands
    assert found(D.contaminated(docs, items)) == [(1, 1), (5, 2), (8, 1)]


def test_plain_copies_as_by_brute_force(docs_of, benchmark, sentences):
    rng = random.Random(3)
    items = [(i, sentences(rng.randint(12, 50), 50 + i)) for i in range(20)]
    docs, want = [], []
    for d in range(60):
        text = sentences(rng.randint(0, 80), 500 + d).split()
        if d % 3 == 0:
            i, item = rng.choice(items)
            words = item.split()
            share = rng.choice([0.2, 1.0, 1.0])
            at = rng.randint(0, len(text))
            text[at:at] = words[: max(1, int(len(words) * share))]
            if share == 1.0:
                want.append((d, i))
        docs.append(" ".join(text))
    out = D.contaminated(docs_of(docs), benchmark(items))
    assert found(out) == sorted(want)
    assert all(r.covered == r.item_tokens for r in out.collect())


def test_only_functions_on_the_main_path(docs_of, benchmark):
    plan = D.decontaminated(docs_of([SAME]), benchmark([(1, ITEM)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_decontaminated_and_empty_tables(docs_of, benchmark):
    docs = docs_of([(1, SAME), (2, "fine"), (None, ITEM), (2, "fine")])
    out = D.decontaminated(docs, benchmark([(1, ITEM)]))
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "2", "None"]
    assert D.decontaminated(docs, benchmark([])).count() == 4
    assert D.contaminated(docs.where("false"), benchmark([(1, ITEM)])).count() == 0


def test_items_of_few_words_are_found(docs_of, benchmark):
    names = "Seen there with Anna Bob Carl Dora and Emil Fred Gina Hugo then Ivan Jane Karl Lena or Mona Nora Olaf Paul"
    items = benchmark([(1, "What is 17 times 23"), (2, names), (3, "12 + 5 = ?"), (4, "List 3 8 1 7 9 2 6 4 5 then add 10 km 20 km")])
    docs = docs_of([(1, "so, what is 17 times 23"), (2, "what is 5 times 9"), (3, names.upper()), (4, "12 + 5 = 17"), (5, "scores 4 8 9 and 31 7 2 66 54 15 91 11 were seen"), (6, "List 4 8 1 7 9 2 6 3 5 then add 11 km 22 km"), (7, "what is 17 plus 23")])
    # a row of numbers alone is no copy of an item made of numbers, unless they are the same
    assert found(D.contaminated(docs, items)) == [(1, 1), (2, 1), (3, 2), (4, 3), (6, 4)]


def test_neighbouring_diagonals_count_together(docs_of, benchmark, sentences):
    longer = ITEM.replace("Paris", "New York").replace("John", "Mary Ann").replace("Mary counts", "Sue Ellen counts")
    words = sentences(40, 77).split()
    put_in = " ".join([*words[:12], "one", *words[12:24], "and", "two", *words[24:34], "three", *words[34:]])
    repeated = " x ".join([" ".join(words[:9])] * 5)
    far = " ".join([*words[:12], *sentences(60, 78).split(), *words[24:36]])
    docs = docs_of([(1, "Well. " + longer), (2, "pre " + put_in), (3, repeated), (4, far), (5, longer.replace("120", "60").replace("3.5", "9"))])
    out = D.contaminated(docs, benchmark([(1, ITEM), (2, " ".join(words))]))
    assert found(out) == [(1, 1), (2, 2), (5, 1)]
    assert {r.doc_id: (r.start, r.covered) for r in out.collect()}[2] == (1, 34)


def test_rows_that_share_a_doc_id_are_judged_text_by_text(docs_of, benchmark, sentences):
    words = sentences(40, 90).split()
    head, tail = " ".join(words[:18]), " ".join(words[18:36])
    docs = docs_of([(1, head), (1, tail), (2, " ".join(words)), (2, "clean text"), (2, head)])
    items = benchmark([(1, " ".join(words))])
    assert found(D.contaminated(docs, items)) == [(2, 1)]  # two halves of two texts are no leak
    assert sorted((r.doc_id, len(r.text.split())) for r in D.decontaminated(docs, items).collect()) == [(1, 18), (1, 18), (2, 2), (2, 18)]


def tokens(text):
    import regex

    out = regex.sub(f"[{D.NAME}-{D.DECIMAL}]", " ", text or "")
    out = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", D.DECIMAL, out)
    out = regex.sub(r"(\p{Lu})(?<=[^.!?:\s] .)(\p{Ll}+)(?!\p{L})", rf" {D.NAME}\1\2 ", out)
    out = regex.sub(rf"([0-9][0-9{D.DECIMAL}]*)\s?((?i:{D.UNITS}))(?![\p{{L}}0-9])", rf" {D.NUMBER}\1 {D.UNIT}\2 ", out)
    out = regex.sub(rf"(?<![0-9{D.NUMBER}{D.DECIMAL}])([0-9][0-9{D.DECIMAL}]*)", rf" {D.NUMBER}\1 ", out)
    return [t for t in regex.split(rf"[^\p{{L}}0-9{D.NAME}-{D.DECIMAL}]+", out.lower()) if t]


def leak(doc, item):
    """The tokens covered by the best span of a document, by comparing every window with every window."""
    a, b = tokens(doc), tokens(item)
    sign = lambda t: t[0] < D.DECIMAL
    kind, plain = lambda t: t[0] if sign(t) else t, lambda t: t[1:] if sign(t) else t
    n, size = len(b), min(len(b), D.WINDOW)
    diagonals = {}
    for i in range(len(a) - size + 1):
        for j in range(n - size + 1):
            x, y = a[i : i + size], b[j : j + size]
            same = [plain(t) for t in x] == [plain(t) for t in y]
            if same or [kind(t) for t in x] == [kind(t) for t in y]:
                diagonals.setdefault(i - j, {})[j] = same
    under = lambda places: {p for j in places for p in range(j, j + size)}
    words = sum(not sign(t) for t in b)
    wordy = lambda j: sum(not sign(t) for t in b[j : j + size]) >= min(D.LITERALS, size)
    spans, last = [], None
    for d in sorted(diagonals):
        if last is None or d - last > max(D.WINDOW, n / 2):
            spans.append([])
        spans[-1].append(d)
        last = d
    best = 0
    for span in spans:
        covered, strong, agrees = set(), set(), set()
        for d in span:
            places = diagonals[d]
            exact = {j for j, same in places.items() if same}
            pairs = lambda own: {(b[p], plain(a[p + d])) for p in under(own) if sign(b[p])}
            held = lambda own: len(pairs(own)) == len({x for x, _ in pairs(own)})
            firm = {j for j in places if wordy(j)}
            own = set(places) if exact == set(places) or held(places) else firm | exact if held(firm) else exact
            covered |= under(own)
            strong |= under(j for j in own if j in exact or wordy(j))
            agrees |= {p for p in under(own) if not sign(b[p]) or p in under(exact)}
        if 2 * len(strong) >= n or 2 * len(covered) >= n and agrees and 2 * len(agrees) >= words:
            best = max(best, len(covered))
    return best


def test_templates_and_slots_as_by_brute_force(docs_of, benchmark):
    rng = random.Random(11)
    plain = "the a near over bridge river walks runs counts buys sells then and while who waits green old small boat".split()
    names, units = ["Paris", "Rome", "Anna", "Bob", "Oslo", "Mary"], ["km", "kg", "hours", "cm"]

    def word():
        k = rng.random()
        return rng.choice(names) if k < 0.15 else str(rng.randint(1, 40)) if k < 0.3 else f"{rng.randint(1, 9)} {rng.choice(units)}" if k < 0.35 else rng.choice(plain)

    items = [(i, "Say " + " ".join(word() for _ in range(rng.choice([3, 6, 14, 25])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = items[rng.randrange(len(items))][1].split()
        swap = {w: rng.choice(names) for w in names} | {str(k): str(rng.randint(1, 60)) for k in range(1, 41)}
        changed = [swap.get(w, w) if rng.random() < (1.0 if d % 3 else 0.7) else w for w in words]
        changed = [w for w in changed if rng.random() > 0.03]
        lo, hi = sorted((rng.randint(0, len(changed)), rng.randint(0, len(changed))))
        body = changed if d % 4 else changed[lo:hi]
        docs.append(" ".join([*(word() for _ in range(rng.randint(0, 9))), *body, *(word() for _ in range(rng.randint(0, 9)))]))
    out = D.contaminated(docs_of(docs), benchmark(items))
    want = {(d, i): leak(t, x) for d, t in enumerate(docs) for i, x in items}
    assert {(r.doc_id, r.item_id): r.covered for r in out.collect()} == {k: v for k, v in want.items() if v}
