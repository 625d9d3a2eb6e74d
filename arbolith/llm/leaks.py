"""Passages of held-out items in a corpus, by a suffix automaton over words.

All items form one generalised suffix automaton, whose size is bounded before it is sent to the
executors (more items are taken in several blocks). Every text is streamed through it: the longest
match that ends at each word is followed, and where it is long enough, the maximal matches of each
item, within longer ones of other items too, become seeds. From each seed item and text are aligned
in both directions; where that is long enough and close enough to the item's words there is a leak.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.llm.lookalikes import latinized

#: Words of all items in one automaton at most.
BLOCK_WORDS = 500_000
#: A leak holds at least so many words of the item, one in so many of them not as they are.
LEAST_WORDS, ONE_IN = 20, 7
#: Words in a row that a match has at least, and that start an alignment. A leak of k edits holds 7 k
#: words (20 at least), thus 6 k unaltered ones in k + 1 runs, one of which has five words or more.
SEED, LONG_SEED = 3, 5
#: A leak of 60 words or more has a shorter one in it: of its first 30 words and the rest, one has
#: its edits in the allowed share, and keeps 25 words without edits at its ends. So a run that
#: belongs to a leak has one with less than 60 words, 54 on one side of the run, and 8 edits.
MOST_EDITS, MOST_REACH = 8, 54
#: A leak has so many unaltered words at least.
LEAST_KEPT = LEAST_WORDS - LEAST_WORDS // ONE_IN
#: Of the leaks over one run that one is reported which has most words, an edit taking off so many.
EDIT_COST = 4

SPANS = "doc_id long, item_id long, first_word int, last_word int, item_words int, held_words int, edits int"

_TAG, _ENTITY = re.compile(r"<[^<>\n]{1,200}>"), re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t>*#|\-]*(?=\w)")
_WORD = re.compile(r"\w+")
_ASCII_ONLY = {c: " " for c in range(128) if not chr(c).isalnum()}


def words(text: str) -> list[str]:
    """The words of a text as a reader sees them: no markup, punctuation, case, unseen or look-alike characters."""
    text = latinized(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text and _ENTITY.search(text):
        text = latinized(html.unescape(text))
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        return text.lower().translate(_ASCII_ONLY).split()
    return _WORD.findall(text.casefold().replace("_", " "))


class Automaton:
    """Generalised suffix automaton of sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.items: dict[int, list[int]] = {}
        self._places: list[tuple[int, int, int | None]] | None = None
        self._spans: list[tuple[int, int]] = []

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, before: int, word: int, wide: int) -> int:
        """The state of exactly length(before) + 1 behind ``word``, cut out of ``wide`` if needed."""
        if self.length[before] + 1 == self.length[wide]:
            return wide
        cut = self._state(self.length[before] + 1, dict(self.next[wide]), self.link[wide])
        self.link[wide] = cut
        while before >= 0 and self.next[before].get(word) == wide:
            self.next[before][word] = cut
            before = self.link[before]
        return cut

    def add(self, item: int, sequence: list[int]) -> None:
        last = 0
        self.items[item] = sequence
        for place, word in enumerate(sequence):
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
            else:
                made = self._state(self.length[last] + 1, {}, 0)
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = made
                    at = self.link[at]
                if at >= 0:
                    self.link[made] = self._split(at, word, self.next[at][word])
                last = made
            self.ends[last].append((item, place + 1))

    def _ordered(self) -> list[tuple[int, int, int | None]]:
        """(item, end, next word) of all places, those of a state and of the states below it side by side."""
        if self._places is None:
            below: list[list[int]] = [[] for _ in self.link]
            for child, parent in enumerate(self.link):
                if parent >= 0:
                    below[parent].append(child)
            self._places, starts = [], [0] * len(self.link)
            self._spans = [(0, 0)] * len(self.link)
            todo = [0]
            while todo:
                at = todo.pop()
                if at < 0:
                    self._spans[~at] = (starts[~at], len(self._places))
                    continue
                starts[at] = len(self._places)
                for item, end in self.ends[at]:
                    sequence = self.items[item]
                    self._places.append((item, end, sequence[end] if end < len(sequence) else None))
                todo.append(~at)
                todo += below[at]
        return self._places

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(item, end) of all places where the state's words stand."""
        places = self._ordered()
        lo, hi = self._spans[state]
        return [(item, end) for item, end, _ in places[lo:hi]]

    def matches(self, numbers: list[int | None]) -> list[tuple[int, int, int]]:
        """(end, length, state) of the longest matches over all items, of at least SEED words, that can't go on."""
        out, moves, length_of, link = [], self.next, self.length, self.link
        state = length = 0
        for place, word in enumerate(numbers):
            if word is None:
                if length >= SEED:
                    out.append((place, length, state))
                state = length = 0
                continue
            to = moves[state].get(word)
            if to is None:
                if length >= SEED:
                    out.append((place, length, state))
                while to is None and state:
                    state = link[state]
                    length = length_of[state]
                    to = moves[state].get(word)
                if to is None:
                    continue
            state = to
            length += 1
        if length >= SEED:
            out.append((len(numbers), length, state))
        return out

    def runs(self, numbers: list[int | None], least: int = SEED) -> list[tuple[int, int, int, int]]:
        """(item, item end, end, length) of every run of at least ``least`` words of each item that can't be carried on.

        The longest match at a word is that of its state; the places of the states it links to have
        shorter ones of their own, each as long as the first of these states that holds the place.
        """
        out, moves, length_of, link = [], self.next, self.length, self.link
        places, spans = self._ordered(), self._spans
        state = length = 0
        last = len(numbers) - 1
        for at, word in enumerate(numbers):
            if word is None:
                state = length = 0
                continue
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                length = length_of[state]
                to = moves[state].get(word)
            if to is None:
                continue
            state = to
            length += 1
            after = numbers[at + 1] if at < last else None
            holds, n, lo, hi = state, length, 0, 0
            while n >= least:
                first, end = spans[holds]
                if lo == hi:
                    lo = hi = first
                for part in (places[first:lo], places[hi:end]):
                    for item, item_end, goes_on in part:
                        if goes_on is None or goes_on != after:
                            out.append((item, item_end, at + 1, n))
                lo, hi = first, end
                holds = link[holds]
                n = length_of[holds]
        return out


def _reach(item: list[int], text: list, i: int, d: int, step: int, words_left: int) -> list[tuple[int, int]]:
    """For 0 to MOST_EDITS edits the most (item words, text words) from i and d on that end with a word of both."""
    best = [(0, 0)] * (MOST_EDITS + 1)
    none = MOST_EDITS + 1
    # last[k] is the least number of edits for r item words and r + k - MOST_EDITS text words.
    last = [none] * MOST_EDITS + [*range(min(MOST_EDITS, words_left) + 1)]
    last += [none] * (2 * MOST_EDITS + 2 - len(last))
    for r in range(1, min(MOST_REACH, len(item) - i if step > 0 else i + 1) + 1):
        word = item[i + step * (r - 1)]
        row = [none] * (2 * MOST_EDITS + 2)
        for k in range(max(0, MOST_EDITS - r), min(2 * MOST_EDITS, words_left - r + MOST_EDITS) + 1):
            c = r + k - MOST_EDITS
            cost = min(last[k + 1], row[k - 1] if k else none) + 1
            if c:
                if text[d + step * (c - 1)] == word:
                    cost = last[k]
                    if cost < none and best[cost][0] < r:
                        best[cost] = (r, c)
                elif last[k] + 1 < cost:
                    cost = last[k] + 1
            row[k] = min(cost, none)
        if min(row) == none:
            break
        last = row
    for e in range(1, MOST_EDITS + 1):
        best[e] = max(best[e], best[e - 1], key=lambda x: x[0])
    return best


def _near(text: list, d: int, n: int, lo: int, hi: int) -> set:
    """The words that a leak over the run of n words at d can hold."""
    wide = MOST_REACH + MOST_EDITS
    return set(text[max(lo, d - wide) : min(hi, d + n + wide)])


def aligned(item: list[int], text: list, i: int, d: int, n: int, lo: int, hi: int) -> tuple[int, int, int, int, int] | None:
    """(item from, to, text from, to, edits) of the best leak over the run of n words at i and d within text[lo:hi].

    Every passage over the run that is long enough counts; of these the one with most words, an
    edit weighing as EDIT_COST words, is taken and carried on while that gains.
    """
    near = _near(text, d, n, lo, hi)
    if sum(w in near for w in item[max(0, i - MOST_REACH) : i + n + MOST_REACH]) < LEAST_KEPT:
        return None
    ahead, back = _reach(item, text, i + n, d + n, 1, hi - d - n), _reach(item, text, i - 1, d - 1, -1, d - lo)
    fits = [
        (held - EDIT_COST * (e + f), held, e, f)
        for e in range(MOST_EDITS + 1)
        for f in range(MOST_EDITS + 1 - e)
        if (held := n + ahead[e][0] + back[f][0]) >= LEAST_WORDS and (e + f) * ONE_IN <= held
    ]
    if not fits:
        return None
    _, _, e, f = max(fits, key=lambda x: (x[0], x[1], -x[2]))
    i0, i1, d0, d1, edits = i - back[f][0], i + n + ahead[e][0], d - back[f][1], d + n + ahead[e][1], e + f
    carried = True
    while carried:
        carried = False
        for step in (1, -1):
            more = _reach(item, text, i1, d1, 1, hi - d1) if step > 0 else _reach(item, text, i0 - 1, d0 - 1, -1, d0 - lo)
            gain, e = max((w - EDIT_COST * e, -e) for e, (w, _) in enumerate(more) if (edits + e) * ONE_IN <= i1 - i0 + w)
            if gain > 0:
                w, c = more[-e]
                i0, i1, d0, d1 = (i0, i1 + w, d0, d1 + c) if step > 0 else (i0 - w, i1, d0 - c, d1)
                edits -= e
                carried = True
    return i0, i1, d0, d1, edits


def leaked(item: list[int], text: list, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(item from, to, text from, to, edits) of all leaks of one item in one text, none over another.

    ``seeds`` are the runs of both (item start, text start, length). The longest are taken first;
    what is left of the others beside the spans taken is aligned there.
    """
    out: list[tuple[int, int, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # text spans in order
    todo = [(-n, d, i) for i, d, n in set(seeds)]
    heapify(todo)
    while todo:
        n, d, i = heappop(todo)
        n = -n
        if n < LONG_SEED:
            break
        k = bisect_left(taken, (d + n, 0))  # the spans before k start before the run's end
        if k and taken[k - 1][1] > d:
            a, b = taken[k - 1]
            heappush(todo, (d - a, d, i))
            heappush(todo, (b - d - n, b, i + b - d))
            continue
        found = aligned(item, text, i, d, n, taken[k - 1][1] if k else 0, taken[k][0] if k < len(taken) else len(text))
        if found:
            out.append(found)
            taken.insert(k, found[2:4])
    return out


class Scanner:
    """The automaton of a block of items and the search of one text."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.number: dict[str, int] = {}
        self.items = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items]
        self.kinds = [(set(ws), len(ws) - len(set(ws))) for _, ws in self.items]
        self.automaton = Automaton()
        for k, (_, sequence) in enumerate(self.items):
            self.automaton.add(k, sequence)

    def scan(self, text: str) -> list[tuple]:
        numbers = list(map(self.number.get, words(text)))
        if not any(n >= LONG_SEED for _, n, _ in self.automaton.matches(numbers)):
            return []
        by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        around: dict[tuple[int, int], set] = {}
        for item, item_end, end, n in self.automaton.runs(numbers, LONG_SEED):
            near = around.get((end, n))
            if near is None:
                near = around[end, n] = _near(numbers, end - n, n, 0, len(numbers))
            kinds, repeated = self.kinds[item]
            if len(near) + repeated >= LEAST_KEPT and len(near & kinds) + repeated >= LEAST_KEPT:
                by_item[item].append((item_end - n, end - n, n))
        out = []
        for item, seeds in by_item.items():
            number, sequence = self.items[item]
            for i0, i1, d0, d1, edits in leaked(sequence, numbers, seeds):
                out.append((number, d0, d1, len(sequence), i1 - i0, edits))
        return out


#: The scanner that this Python process made last: its tasks over one block of items share it.
_held: dict[str, Scanner] = {}


def _scanner(token: str, items: list[tuple[int, list[str]]]) -> Scanner:
    if token not in _held:
        _held.clear()
        _held[token] = Scanner(items)
    return _held[token]


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items as word lists, streamed to the driver and cut into blocks of bounded size."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").distinct().toLocalIterator():
        found = words(row["t"])
        if len(found) < LEAST_WORDS:
            continue
        if block and size + len(found) > block_words:
            yield block
            block, size = [], 0
        block.append((row["k"], found))
        size += len(found)
    if block:
        yield block


def leak_spans(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every span of a document that holds at least 20 words of an item with about one in eight altered at most.

    Columns as in SPANS; word places count the words of the document as ``words`` cuts them. Null
    and empty texts have no spans, items of fewer than 20 words none either; repeated items and
    documents count like any other. Texts are never moved: one pass over them per block of items, whose
    automaton each Python process makes once.
    """
    spark = documents.sparkSession
    given = documents.where(F.col(text).isNotNull()).select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for block in item_blocks(items, item_key, item_text, block_words):
        sent = spark.sparkContext.broadcast(block)  # bounded by block_words

        def run(batches: Iterator[pd.DataFrame], sent=sent, token=uuid4().hex) -> Iterator[pd.DataFrame]:
            scanner = _scanner(token, sent.value)
            for pdf in batches:
                out = [(d, *span) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for span in scanner.scan(t)]
                yield pd.DataFrame([(d, i, a, b, n, h, e) for d, i, a, b, n, h, e in out], columns=["doc_id", "item_id", "first_word", "last_word", "item_words", "held_words", "edits"])

        parts.append(given.mapInPandas(run, SPANS))
    if not parts:
        return spark.createDataFrame([], SPANS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, spans: DataFrame, least_held: int = LEAST_WORDS, least_share: float = 0.0) -> DataFrame:
    """``documents`` (doc_id, text) with the leaked spans of enough words and share of the item cut out.

    Only texts with such a span are rewritten, as their remaining words joined by blanks.
    """
    wanted = spans.where((F.col("held_words") >= least_held) & (F.col("held_words") >= least_share * F.col("item_words")))
    cut = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("cuts"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cuts, strict=True):
            if c is None or t is None:
                out.append(t)
                continue
            kept = words(t)
            gone = {k for s in c for k in range(s["first_word"], s["last_word"])}
            out.append(" ".join(w for k, w in enumerate(kept) if k not in gone))
        return pd.Series(out, dtype=object)

    return documents.select("doc_id", "text").join(cut, "doc_id", "left").select("doc_id", rest("text", "cuts").alias("text"))
