import random

from hypothesis import given, settings
from hypothesis import strategies as st

from arbolith.llm import leaks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_automaton_finds_all_maximal_matches(items, text):
    made = leaks.Automaton()
    for k, x in enumerate(items):
        made.add(k, x)
    text = [None if x == 3 else x for x in text]
    want = set()
    for k, x in enumerate(items):
        for i in range(len(x)):
            for d in range(len(text)):
                n = 0
                while i + n < len(x) and d + n < len(text) and x[i + n] == text[d + n]:
                    n += 1
                if n >= leaks.SEED:
                    want.add((k, i, d, n))
    got = {(k, end - n, d - n, n) for d, n, state in made.matches(text) for k, end in made.occurrences(state)}
    # Every match reported is one; the longest that ends at each place is there.
    for k, i, d, n in got:
        assert items[k][i : i + n] == text[d : d + n]
    for k, i, d, n in want:
        longest = max(w[3] for w in want if w[2] + w[3] == d + n)
        alive = any(w[2] < d and w[2] + w[3] >= d + n for w in want)
        if n == longest and not alive and not any(w[2] == d and w[3] > n for w in want):
            assert (k, i, d, n) in got


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    items = [(k, "Given {} under {} with {} children and {} carrying flags, decide if {} may list {} beside {} when {} reports {} sheets and {} lost {} names to {} since {}.".format(*[word() for _ in range(13)])) for k in range(12)]
    return rng, word, items


def test_leaks_and_near_misses(spark):
    rng, word, items = make(1)
    docs, want = [], set()
    for n in range(120):
        k, text = items[n % 12]
        ws = text.split()
        kind = n % 6
        if kind == 0:
            part = ws[3:30]
        elif kind == 1:  # one in nine altered
            part = [word() if i % 9 == 4 else w for i, w in enumerate(ws)]
        elif kind == 2:  # too short
            part = ws[:13]
        elif kind == 3:  # built alike, other names
            part = make(1000 + n)[2][0][1].split()
        elif kind == 4:  # layout, case, markup, look-alikes, unseen characters
            part = [w.upper().replace("E", "Е") if i % 3 else "<b>" + w[:1] + "​" + w[1:] + "</b>" for i, w in enumerate(ws)]
        else:  # every third word altered
            part = [word() if i % 3 == 1 else w for i, w in enumerate(ws)]
        noise = lambda: " ".join(word() for _ in range(rng.randrange(60)))
        docs.append((n, noise() + "\n> " + " ".join(part) + ". " + noise(), "x"))
        if kind in (0, 1, 4):
            want.add((n, k))
    broken = items[5][1].replace("children", "chil-\n> dren").replace("carrying", "carry-\n    ing")
    docs += [(500, broken, "x"), (501, None, "x"), (502, "", "x"), (503, "und " * 5000 + items[7][1], "x")]
    want |= {(500, 5), (503, 7)}
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    tests = spark.createDataFrame(items + [(90, None), (91, ""), (92, "too short")], "item_id long, item_text string")
    for block in (10_000, 100):
        spans = leaks.leak_spans(table, tests, block_words=block)
        assert {(r["doc_id"], r["item_id"]) for r in spans.collect()} == want
    cleaned = leaks.without_leaks(table, leaks.leak_spans(table, tests))
    assert cleaned.count() == len(docs)
    assert leaks.leak_spans(cleaned, tests).count() == 0
    assert leaks.leak_spans(table, tests.limit(0)).count() == 0 and leaks.leak_spans(table.limit(0), tests).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=25))
def test_runs_are_the_maximal_matches_of_each_item(items, text):
    made = leaks.Automaton()
    for k, x in enumerate(items):
        made.add(k, x)
    text = [None if x == 3 else x for x in text]
    want = set()
    for k, x in enumerate(items):
        for i in range(len(x)):
            for d in range(len(text)):
                n = 0
                while i + n < len(x) and d + n < len(text) and x[i + n] == text[d + n]:
                    n += 1
                if n >= leaks.SEED and not (i and d and x[i - 1] == text[d - 1]):
                    want.add((k, i + n, d + n, n))
    got = made.runs(text)
    assert len(got) == len(set(got)) and set(got) == want


def test_items_that_share_a_passage():
    rng = random.Random(7)
    fresh = iter(rng.sample(range(100_000), 400))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    shared = new(30)
    a, b = new(10) + shared + new(10), new(10) + shared + new(10)
    part = b[15:38]
    near = [w if k % 10 != 4 else x for k, (w, x) in enumerate(zip(b, new(50), strict=True))]
    scanner = leaks.Scanner([(1, a), (2, b), (3, part), (4, near)])
    text = " ".join(new(20) + b + new(20))
    assert {s[0] for s in scanner.scan(text)} == {1, 2, 3, 4}


def spread(*runs):
    """A passage of runs of an item's words, one word altered (or, after a 0, left out) between them."""
    item, text, at = list(range(100, 160)), [], 10
    for k, n in enumerate(runs):
        if k:
            text += [] if runs[k - 1] == 0 else [-k]
            at += n > 0
        text += item[at : at + n]
        at += n
    return item, text


def held(item, text):
    number = {w: k for k, w in enumerate(item)}
    scanner = leaks.Scanner([(1, [f"w{w}" for w in item])])
    words = [f"w{w}" if w in number else f"x{abs(w)}" for w in text]
    return [s[1:] for s in scanner.scan(" ".join(["before", "it", *words, "behind", "it"]))]


def test_short_runs_at_the_ends_count():
    for runs in ((2, 19), (19, 2), (2, 16, 2), (3, 14, 3), (1, 18), (18, 1), (7, 6, 7), (3, 0, 19)):
        item, text = spread(*runs)
        got = held(item, text)
        assert len(got) == 1 and got[0][0] == 2 and got[0][1] == 2 + len(text), runs
    for runs in ((19,), (2, 16), (5, 4, 4, 4, 4), (1, 1, 1, 14)):
        assert held(*spread(*runs)) == [], runs


def least_leak(item, text):
    """Whether any passage of the item holds, by a full comparison."""
    for i in range(len(item)):
        for d in range(len(text)):
            if item[i] != text[d]:
                continue
            last = list(range(len(text) - d + 1))
            for r in range(1, len(item) - i + 1):
                row = [r]
                for c in range(1, len(text) - d + 1):
                    same = item[i + r - 1] == text[d + c - 1]
                    row.append(min(last[c] + 1, row[-1] + 1, last[c - 1] + (not same)))
                    if same and r >= leaks.LEAST_WORDS and row[c] * leaks.ONE_IN <= r:
                        return True
                last = row
    return False


def test_leaks_are_those_of_a_full_comparison():
    rng, seen = random.Random(3), []
    for _ in range(150):
        item = [rng.randrange(60) for _ in range(rng.randrange(20, 36))]
        text, k = [], rng.choice((0, 0, 3, 6))
        for w in item[k : k + rng.randrange(19, 30)]:
            kind = rng.random()
            text += [] if kind < 0.05 else [rng.randrange(60)] if kind < 0.1 else [w, 99] if kind < 0.15 else [w]
        scanner = leaks.Scanner([(1, [f"w{w}" for w in item])])
        want = least_leak(item, text)
        seen.append(want)
        assert bool(scanner.scan(" ".join(f"w{w}" for w in text))) == want, (item, text)
    assert 20 < sum(seen) < 130


def test_phrases_repeated_in_an_item():
    phrase = [f"p{k}" for k in range(8)]
    item = [w for row in range(90) for w in (*phrase, f"n{row}")]
    scanner = leaks.Scanner([(1, item)])
    spans = scanner.scan(" ".join(["before", *phrase * 4, "behind"]))  # the words between are left out
    assert [s[:3] for s in spans] == [(1, 1, 33)] and spans[0][4:] == (35, 3)
