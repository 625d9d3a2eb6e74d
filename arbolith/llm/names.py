"""Names as typed, mapped to a reference list.

The words of the list and their spellings with letters left out (symmetric deletes) form a
dictionary, a table that is broadcast while it is small and joined by its keys beyond that. A typed
name is parsed into the words that name something; each word's candidates within a bounded edit
distance come from the dictionary, names made of them that are listed are ranked by weighted
Damerau-Levenshtein distance, then by how many names of the list have their words. What has no
listed name is unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.functions.text import BLANKS
from arbolith.llm.lookalikes import latinized
from arbolith.runtime import materialize

#: Rows of the dictionary (about 60 bytes each) up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Edits of both words of a name together.
EDITS_BOTH = 3
UNMATCHED = -1

# What typists write besides the name.
_LATO = re.compile(r"\bsensu\s+(?:lato|stricto|auct\w*)\b\.?|(?<!\w)s\.\s*(?:l|lat|s|str|strict)\.?(?!\w)", re.IGNORECASE)
_BRACKETS = re.compile(r"\[[^\]]*\]?|\([^)]*\)?")
_QUOTES = re.compile(r"[\"“”„«»‘’‚`´']")
_NUMBER, _YEAR = re.compile(r"#\s*\d*"), re.compile(r"\b(?:1[5-9]|20)\d\d\b[a-z]?")
_LATO_WORDS = ("lato", "stricto")
_SEPARATORS = re.compile(r"[,;:!?&+/\\|=~*<>_\-‐-―]")
_QUALIFIERS = {"cf", "aff", "nr", "agg", "x", "×", "ssp", "subsp", "var", "auct", "gen", "nov", "et", "al", "ex", "in", "sic"}
_UNNAMED = {"sp", "spp", "species", "indet"}
_DIGITS = str.maketrans("0135689", "olesbeg")
# Letters and groups that are heard or read as one another.
_GROUPS = (("ph", "f"), ("rn", "m"), ("ii", "u"), ("ks", "x"), ("vv", "w"), ("ae", "e"), ("oe", "e"), ("th", "t"), ("rh", "r"), ("ch", "c"), ("cl", "d"), ("li", "h"))
_CLOSE = {frozenset(p) for p in ("ck", "iy", "cs", "sz", "gj", "vw", "uv", "bd", "oa", "ei", "il", "nm", "ou")}


@dataclass
class Typed:
    words: list[str] = field(default_factory=list)
    dotted: list[bool] = field(default_factory=list)
    capital: list[bool] = field(default_factory=list)
    unnamed: bool = False
    dated: bool = False


def plain(text: str) -> str:
    """Latin letters without accents, one kind of blank, no unseen characters; case kept."""
    text = latinized(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return text


def parse(raw: str) -> Typed:
    """The words of a typed name, without authors' years, remarks, marks of doubt and hybrid signs."""
    text = _LATO.sub(" ", _QUOTES.sub(" ", _BRACKETS.sub(" ", plain(raw).replace("_", " "))))
    text = _SEPARATORS.sub(" ", _YEAR.sub(" ", _NUMBER.sub(" ", text)))
    typed = Typed(dated=_YEAR.search(plain(raw)) is not None)
    for token in text.split():
        core = token.strip(".")
        dotted = token.endswith(".") and bool(core)
        lower = core.lower()
        if typed.words and lower in _UNNAMED:
            typed.unnamed = True
            break
        if not lower or lower in _QUALIFIERS and not (lower == "x" and (dotted or not typed.words)) or not any(c.isalpha() for c in lower):
            continue
        word = "".join(c for c in lower.translate(_DIGITS) if c.isalpha())
        if word in _LATO_WORDS and len(typed.words) > 1 and edits(typed.words[-1], "sensu", 2) <= 2:
            for held in (typed.words, typed.dotted, typed.capital):
                held.pop()
            continue
        typed.words.append(word)
        typed.dotted.append(dotted)
        typed.capital.append(core[:1].isupper() or core[1:].isupper() and len(core) > 2)
    return typed


def bound(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (neighbours swapped count one), or most + 1 if above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def weight(a: str, b: str) -> float:
    """Damerau-Levenshtein distance in which likely slips cost less: swaps, doubled letters, letters that sound or look alike."""
    before, last = None, [0.0]
    for j, y in enumerate(b, 1):
        last.append(last[-1] + (0.5 if j > 1 and b[j - 2] == y else 1.0))
    for i, x in enumerate(a, 1):
        double = 0.5 if i > 1 and a[i - 2] == x else 1.0
        row = [last[0] + double]
        for j, y in enumerate(b, 1):
            change = 0.0 if x == y else 0.5 if frozenset((x, y)) in _CLOSE else 1.0
            d = min(last[j] + double, row[-1] + (0.5 if j > 1 and b[j - 2] == y else 1.0), last[j - 1] + change)
            if i > 1 and j > 1 and x != y and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 0.7)
            row.append(d)
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    """The word with groups that are heard or read as one another brought to one spelling."""
    for group, letter in _GROUPS:
        word = word.replace(group, letter)
    word = word.replace("k", "c").replace("y", "i")
    return re.sub(r"(.)\1+", r"\1", word)


def near(typed: str, listed: str, plain_: bool, folded: bool) -> tuple[int, float] | None:
    """(edits, weight) of a listed word that shares a spelling with letters left out with a typed one, plainly or as both fold; None beyond the bound."""
    found = None
    most = bound(typed)
    if plain_ and (n := edits(typed, listed, most)) <= most:
        found = (n, weight(typed, listed))
    if folded and (n := edits(fold(typed), fold(listed), 1)) <= 1:
        cost = 0.6 + n
        if found is None or cost < found[1]:
            found = (n + 1 if found is None else min(n + 1, found[0]), cost)
    return found


# --- tables of the list


def entries(canonical: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, ott_id, context_name, listed) of both lists; a synonym has the context of its entry."""
    own = canonical.where("name is not null and ott_id is not null").select("name", "ott_id", "context_name")
    other = synonyms.where("name is not null").select("name", "ott_id").join(own.select("ott_id", "context_name").distinct(), "ott_id")
    return (
        own.withColumn("listed", F.lit(True)).unionByName(other.withColumn("listed", F.lit(False))).distinct()
    )


def _name_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(key=[" ".join(plain(n).lower().split()) for n in pdf["name"]])


def name_ids(listed: DataFrame) -> DataFrame:
    """(key, ott_id, context_name, n_names): an entry's own name goes before another's synonym; n_names counts an entry's names."""
    named = listed.mapInPandas(_name_keys, "name string, ott_id long, context_name string, listed boolean, key string").where("key <> ''")
    named = materialize(named.drop("name").distinct())
    own = named.groupBy("key").agg(F.bool_or("listed").alias("own"))
    names = named.select("ott_id", "key").distinct().groupBy("ott_id").agg(F.count("*").alias("n_names"))
    kept = named.join(own, "key").where(F.col("listed") == F.col("own")).join(names, "ott_id")
    return kept.select("key", "ott_id", "context_name", "n_names").distinct()


def name_keys(ids: DataFrame) -> DataFrame:
    """(key, first, rest, times): the listed names, ``rest`` being null but for two words; times counts the names with either word."""
    words = F.split("key", " ")
    keys = ids.select("key").distinct().select("key", words[0].alias("first"), F.when(F.size(words) == 2, words[1]).alias("rest"), (F.size(words) == 1).alias("alone"))
    by = lambda c: keys.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(f"{c}_times"))
    both = keys.join(by("first"), "first").join(by("rest"), "rest", "left")
    return both.select("key", "first", "rest", "alone", (F.col("first_times") + F.coalesce("rest_times", F.lit(0))).alias("times"))


def _folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(fold=[fold(w) for w in pdf["word"]])


def _kinds(rows: DataFrame, pick: dict[str, Column]) -> DataFrame:
    every = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("word")) for k, c in pick.items()])
    return rows.select(F.inline(every)).where("word is not null").distinct()


def listed_words(keys: DataFrame) -> DataFrame:
    """(kind, word): first words, second words of two, names of one word, and the last letters of second words."""
    return _kinds(keys, {"first": F.col("first"), "rest": F.col("rest"), "alone": F.when(F.col("alone"), F.col("first")), "ending": F.right("rest", F.lit(2))})


def _left_out(word: Column) -> Column:
    """The spellings of a word with one letter left out."""
    size = F.length(word)
    made = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, size)))
    return F.when(size > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _spellings(word: Column, most: Column) -> Column:
    """The word and what is left of it when up to ``most`` (0 to 2) letters are left out."""
    one = _left_out(word)
    two = F.flatten(F.transform(one, _left_out))
    return F.array_distinct(F.concat(F.array(word), F.when(most > 0, one).otherwise(F.array().cast("array<string>")), F.when(most > 1, two).otherwise(F.array().cast("array<string>"))))


def _bound(word: Column) -> Column:
    return F.when(F.length(word) < 4, 0).when(F.length(word) < 7, 1).otherwise(2)


def _dictionary(words: DataFrame, plainly: Column, folded: Column) -> DataFrame:
    """(kind, spelling, is_fold, word) of (kind, word, fold), where a word goes in plainly and as it folds."""
    none = F.array().cast("array<string>")
    rows = F.array(
        F.struct(F.lit(False).alias("is_fold"), F.when(plainly, _spellings(F.col("word"), _bound(F.col("word")))).otherwise(none).alias("spellings")),
        F.struct(F.lit(True).alias("is_fold"), F.when(folded, _spellings(F.col("fold"), F.lit(1))).otherwise(none).alias("spellings")),
    )
    return words.select("kind", "word", F.inline(rows)).select("kind", "is_fold", "word", F.explode("spellings").alias("spelling"))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [near(t, w, p, f) for t, w, p, f in zip(pdf["word"], pdf["listed"], pdf["plainly"], pdf["folded"], strict=True)]
        hit = [x is not None for x in found]
        yield pdf.loc[hit, ["kind", "word", "listed"]].assign(n=[x[0] for x in found if x], cost=[x[1] for x in found if x])


def candidates(typed: DataFrame, listed: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(kind, word, listed, n, cost): for typed words (kind, word) the listed words of that kind within the bound.

    Both sides are spelled with letters left out and meet on equal spellings. A typed word too
    long to be within the bound of the longest listed one isn't spelled out: it has no candidate.
    """
    known = materialize(listed.where("kind <> 'ending'").mapInPandas(_folds, "kind string, word string, fold string"))
    longest = known.agg(F.max(F.length("word")).alias("w"), F.max(F.length("fold")).alias("f")).first()
    dictionary = materialize(_dictionary(known, F.lit(True), F.length("word") > 4).withColumnRenamed("word", "listed"))
    # Each word gives dozens of spellings: a few words a task are worth a task.
    spread = max(typed.sparkSession.sparkContext.defaultParallelism, int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = typed.where("kind <> 'ending'").repartition(spread, "word").mapInPandas(_folds, "kind string, word string, fold string")
    fits = F.length("word") <= (longest["w"] or 0) + 2
    asked = _dictionary(asked, fits, (F.length("fold") > 3) & (F.length("fold") <= (longest["f"] or 0) + 1))
    if dictionary.count() <= broadcast_rows:
        dictionary = F.broadcast(dictionary)
    met = asked.join(dictionary, ["kind", "is_fold", "spelling"]).groupBy("kind", "word", "listed").agg(F.bool_or(~F.col("is_fold")).alias("plainly"), F.bool_or("is_fold").alias("folded"))
    close = met.mapInPandas(_measured, "kind string, word string, listed string, n int, cost double")
    endings = typed.where("kind = 'ending'").join(listed, ["kind", "word"], "left_semi")
    return close.unionByName(endings.select("kind", "word", F.col("word").alias("listed"), F.lit(0).alias("n"), F.lit(0.0).alias("cost")))


def name_index(keys: DataFrame) -> DataFrame:
    """(kind, k1, k2, whole, key, times): listed names by themselves and by what abbreviations leave of them."""
    none, pair = F.lit(""), F.col("rest").isNotNull()
    row = lambda kind, k1, k2, whole: F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"), whole.alias("whole"))
    rows = F.array(
        row("name", F.col("key"), none, none),
        F.when(pair & (F.length("rest") >= 3), row("rest", F.col("first"), F.left("rest", F.lit(3)), F.col("rest"))),
        *[F.when(pair & (F.length("first") >= k), row("head", F.col("rest"), F.left("first", F.lit(k)), F.col("first"))) for k in (1, 2, 3)],
        F.when(F.col("alone") & (F.length("first") >= 4), row("start", none, F.left("first", F.lit(4)), F.col("first"))),
    )
    return keys.select("key", "times", F.inline(F.array_compact(rows)))


# --- what a typed name may stand for

_PARSED = "typed string, key string, w0 string, w1 string, dot0 boolean, dot1 boolean, unnamed boolean, marked boolean"
#: Readings of two words, turned round or not, go before those of one; what each costs besides.
STRAIGHT, TURNED, SINGLE = 0, 1, 2
TURN, SHORTENED = 0.3, 0.5


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for raw in pdf["typed"]:
            t = parse(raw)
            one, two = len(t.words) > 0, len(t.words) > 1
            marked = two and (t.capital[1] or t.dated or not t.capital[0])
            out.append((raw, " ".join(plain(raw).lower().split()), t.words[0] if one else None, t.words[1] if two else None, one and t.dotted[0], two and t.dotted[1], t.unnamed, marked))
        yield pd.DataFrame(out, columns=["typed", "key", "w0", "w1", "dot0", "dot1", "unnamed", "marked"])


def _readings(word0: str, word1: str, dot0: bool, dot1: bool, heads: dict, tails: dict) -> Iterator[tuple]:
    """(tier, kind, k1, k2, probe, cost) of two words as a name; a lower tier that has a listed name goes before."""
    firm0, firm1 = (0, 0.0) == heads.get(word0), (0, 0.0) == tails.get(word1)
    own_heads = {word0: (0, 0.0)} if firm0 else heads
    own_tails = {word1: (0, 0.0)} if firm1 else tails
    for h, (n, cost) in own_heads.items():
        for t, (m, more) in own_tails.items():
            if n + m <= EDITS_BOTH:
                yield 0, "name", f"{h} {t}", "", "", cost + more
    if firm0 and firm1:  # both are listed: where not together, one of them may be another listed word misspelled
        for h, (_, cost) in heads.items():
            yield 1, "name", f"{h} {word1}", "", "", cost
        for t, (_, cost) in tails.items():
            yield 1, "name", f"{word0} {t}", "", "", cost
    if dot1 and len(word1) >= 3:
        for h, (_, cost) in own_heads.items():
            yield 2, "rest", h, word1[:3], word1, cost
    if len(word0) <= 3 and (dot0 or len(word0) == 1):
        for t, (_, cost) in own_tails.items():
            yield 3, "head", t, word0, word0, cost


def _options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            near_: dict[tuple[str, str], dict] = {}
            for c in r.found if r.found is not None else ():
                near_.setdefault((c["kind"], c["word"]), {})[c["listed"]] = (c["n"], c["cost"])
            look = lambda kind, word: near_.get((kind, word), {})  # noqa: B023, E731
            two = isinstance(r.w1, str)
            if two and not r.unnamed:
                out += [(r.typed, STRAIGHT, *o) for o in _readings(r.w0, r.w1, r.dot0, r.dot1, look("first", r.w0), look("rest", r.w1))]
                out += [(r.typed, TURNED, *o) for o in _readings(r.w1, r.w0, r.dot1, r.dot0, look("first", r.w1), look("rest", r.w0))]
            # An author neither is nor ends like a listed species word and has a capital or a year, or the name has no capitals.
            author = two and r.marked and not look("ending", r.w1[-2:]) and not look("rest", r.w1)
            if not two or author:
                alone = look("alone", r.w0)
                if (0, 0.0) == alone.get(r.w0):
                    alone = {r.w0: (0, 0.0)}
                if not alone and r.dot0 and len(r.w0) >= 4:
                    out.append((r.typed, SINGLE, 1, "start", "", r.w0[:4], r.w0, 0.0))
                elif (0, 0.0) != look("rest", r.w0).get(r.w0):
                    out += [(r.typed, SINGLE, 0, "name", w, "", "", cost) for w, (_, cost) in alone.items()]
        yield pd.DataFrame(out, columns=["typed", "way", "tier", "kind", "k1", "k2", "probe", "cost"])


def meant(parsed: DataFrame, keys: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(typed, key) of the typed names (_PARSED) that stand for a listed one without being it."""
    slots = {"first": ("w0", "w1"), "rest": ("w0", "w1"), "alone": ("w0",), "ending": ("w1",)}
    pick = lambda kind, c: F.right(c, F.lit(2)) if kind == "ending" else F.col(c)
    looked = F.array(*[F.struct(F.lit(k).alias("kind"), pick(k, c).alias("word")) for k, cs in slots.items() for c in cs])
    looked = materialize(parsed.where("w0 is not null").select("typed", F.inline(looked)).where("word is not null").distinct())
    close = materialize(candidates(looked.select("kind", "word").distinct(), listed_words(keys), broadcast_rows))
    # A list holds the candidates of a name's own two words.
    found = looked.join(close, ["kind", "word"]).groupBy("typed").agg(F.collect_list(F.struct("kind", "word", "listed", "n", "cost")).alias("found"))
    asked = parsed.where("w0 is not null").join(found, "typed", "left")
    options = asked.mapInPandas(_options, "typed string, way int, tier int, kind string, k1 string, k2 string, probe string, cost double")
    hits = options.join(name_index(keys), ["kind", "k1", "k2"]).where(F.startswith("whole", "probe"))
    # Abbreviations count where they leave one name only.
    step = hits.groupBy("typed", "way", "tier", "cost").agg(F.min(F.struct((-F.col("times")).alias("t"), "key")).alias("best"), (F.min("key") == F.max("key")).alias("one"))
    step = step.groupBy("typed", "way", "tier").agg(F.min(F.struct("cost", "best", "one")).alias("r")).select("typed", "way", "tier", "r.*")
    short = F.col("tier") > F.when(F.col("way") == SINGLE, 0).otherwise(1)
    step = step.where(~short | F.col("one")).withColumn("cost", F.col("cost") + F.when(short, SHORTENED).otherwise(0.0))
    step = step.groupBy("typed", "way").agg(F.min(F.struct("tier", "cost", "best")).alias("r"))
    order = F.struct((F.col("way") == SINGLE).alias("single"), (F.col("r.cost") + F.when(F.col("way") == TURNED, TURN).otherwise(0.0)).alias("cost"), "way", F.col("r.best.key").alias("key"))
    return step.groupBy("typed").agg(F.min(order).alias("r")).select("typed", "r.key")


def request_elements(requests: DataFrame) -> DataFrame:
    """(request_id, name_pos, typed, context_name) of the elements of good requests, each request once.

    A good request fills exactly one of names and query_string; an empty list and a blank text
    fill nothing, a list of null or empty elements does. Of unlike deliveries of one
    request the one loaded last counts (ties: the larger values).
    """
    row = F.struct("loaded_at", "names", "query_string", "context_name")
    last = requests.groupBy("request_id").agg(F.max(row).alias("r")).select("request_id", "r.*")
    blanks = rf"^[{BLANKS}]+|[{BLANKS}]+$"
    names = F.when(F.size("names") > 0, F.col("names"))
    query = F.when(F.regexp_replace("query_string", blanks, "") != "", F.col("query_string"))
    good = last.where(names.isNull() != query.isNull())
    listed = F.coalesce(names, F.split(query, ","))
    out = good.select("request_id", "context_name", F.posexplode(listed).alias("name_pos", "typed"))
    return out.withColumn("typed", F.regexp_replace("typed", blanks, "")).where("typed <> ''")


def resolve_names(requests: DataFrame, canonical: DataFrame, synonyms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(request_id, name_pos, ott_id) of every non-empty element; UNMATCHED where no list has it.

    Each spelling is looked up once, however often it is asked for. Null and empty elements keep
    their position and have no row; a name in several contexts is decided by the request's
    context, else by how many names the list has for the entry, then by the smaller id. Without
    entries all is unmatched.
    """
    ids = materialize(name_ids(entries(canonical, synonyms)))
    keys = materialize(name_keys(ids))
    elements = materialize(request_elements(requests))
    spellings = materialize(elements.select("typed", "context_name").distinct())
    parsed = materialize(spellings.select("typed").distinct().repartition("typed").mapInPandas(_parsed, _PARSED))
    # At distance 0: the name as it stands, or its two words once they are parsed out.
    words = F.when(~F.col("unnamed"), F.concat_ws(" ", "w0", F.col("w1")))
    tried = parsed.select("typed", F.inline(F.array(*[F.struct(F.lit(k).alias("way"), c.alias("key")) for k, c in enumerate((F.col("key"), F.when(F.col("w1").isNotNull(), words)))])))
    same = materialize(tried.join(keys.select("key"), "key").groupBy("typed").agg(F.min_by("key", "way").alias("key")))
    other = meant(parsed.join(same.select("typed"), "typed", "left_anti"), keys, broadcast_rows)
    known = materialize(same.unionByName(other)).join(ids, "key").withColumnRenamed("context_name", "own_context")
    order = F.struct((~F.col("own_context").eqNullSafe(F.col("context_name"))).alias("elsewhere"), (-F.col("n_names")).alias("few"), "ott_id")
    answers = spellings.join(known, "typed").groupBy("typed", "context_name").agg(F.min_by("ott_id", order).alias("ott_id"))
    fits = elements["typed"].eqNullSafe(answers["typed"]) & elements["context_name"].eqNullSafe(answers["context_name"])
    out = elements.join(answers, fits, "left")
    return out.select("request_id", F.col("name_pos").cast("int").alias("name_pos"), F.coalesce("ott_id", F.lit(UNMATCHED).cast("long")).alias("ott_id"))
