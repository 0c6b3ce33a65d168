"""Personal data: patterned entities as seeds, and bootstrapped contexts that find unseen identifiers.

DataFrame operations only. Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.plans.storage import stored

# The kinds in their order and their forms. Quantifiers are possessive and matches begin at the
# first character of a run, so the matches are those of the plain forms, in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a form to match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
#: A word that holds a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Two or more words of digits and signs; a plus begins another one.
SPACED = r"(?<!\S)[+(]*+[0-9][0-9()./+-]*+(?![^\s,;:!?])(?:[\x20\t]\(*+[0-9][0-9()./+-]*+(?![^\s,;:!?]))++"
#: A word with a letter that is no candidate (group 1).
PLAIN = r"(?<!\S)(?=[^\s0-9@]++(?!\S))(?=[^\s\p{L}]*+\p{L})(\S++)"

ROUNDS = 3
#: A pattern is kept with this confidence and so much weight of known instances.
CONFIDENCE, SUPPORT = 0.8, 5.0
#: Up to so many kept patterns are broadcast; more are joined by an exchange of written tables, where AQE splits hot ones.
BROADCAST_PATTERNS = 500_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.substring(backwards, k, 1).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(backwards, k, 1).cast("int") + 1)),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


LOCATED = "array<struct<start:int,match:string,left:string,right:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], first: int, block: int = 128) -> Column:
    """``combine`` of ``first`` and the numbers (bigint) up to and with each one, in time nearly linear in their number:
    inside blocks, then of whole blocks."""
    start = F.struct(F.lit(first).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return _let(combine(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

    def joined(blocks: Column) -> Column:
        # What stands before each block: first, then all but the last of the blocks' results.
        before = F.concat(F.array(F.lit(first).cast("long")), F.aggregate(F.transform(blocks, lambda b: b["at"]), start, step)["out"])
        return _let(F.struct(before.alias("before"), blocks.alias("blocks")), lambda s: F.flatten(F.transform(
            s["blocks"], lambda b, k: _let(F.get(s["before"], k), lambda o: F.transform(b["out"], lambda x: combine(o, x))))))

    blocks = _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(v, k * block + 1, F.lit(block)), start, step)))
    return F.when(F.size(values) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<bigint>"))


def _filled(words: Column) -> Column:
    """Each word, or the last one before it that is not empty."""
    def fill(w: Column) -> Column:
        known = running(F.transform(w, lambda x, k: F.when(x != "", k).otherwise(F.lit(-1)).cast("long")), F.greatest, -1)
        return F.transform(known, lambda k: F.when(k >= 0, F.get(w, k.cast("int"))).otherwise(F.lit("")))

    return _let(words, fill)


def _located(text: Column, form: str) -> Column:
    """(start, match, left, right) of each leftmost non-overlapping match.

    The contexts are the last plain word before the match and the first one after it; where none stands between two
    matches they share what is before or after both; empty at the text's ends. All gaps are searched whole, and the
    work grows with the text.
    """
    def last(gap: Column) -> Column:
        return F.lower(F.regexp_extract(gap, rf"(?s)^.*{PLAIN}", 1))

    def first(gap: Column) -> Column:
        return F.lower(F.regexp_extract(gap, PLAIN, 1))

    def rows(s: Column) -> Column:
        n = F.size(s["found"])
        sizes = F.transform(s["found"], lambda m, k: (F.length(F.get(s["gaps"], k)) + F.length(m)).cast("long"))
        parts = F.struct(
            s["found"].alias("found"), running(sizes, lambda x, y: x + y, 0).alias("end"),
            _filled(F.transform(F.slice(s["gaps"], F.lit(1), n), last)).alias("left"),
            F.reverse(_filled(F.reverse(F.transform(F.slice(s["gaps"], F.lit(2), n), first)))).alias("right"))
        return _let(parts, lambda p: F.transform(p["found"], lambda m, k: F.struct(
            (F.get(p["end"], k) - F.length(m)).cast("int").alias("start"), m.alias("match"), F.get(p["left"], k).alias("left"), F.get(p["right"], k).alias("right"))))

    found, gaps = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    none = F.array().cast(LOCATED)
    return _let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda s: F.when(F.size(s["found"]) > 0, rows(s)).otherwise(none))


SEEDS = "array<struct<start:int,kind:int,end:int,instance:bigint,patterns:array<bigint>>>"


def seeds(text: Column) -> Column:
    """Structs (start, kind number, end, instance, patterns), sorted, of the patterned entities of a non-null text."""
    return F.array_sort(F.concat(*(_spans(text, number, kind) for number, kind in enumerate(KINDS))))


def base_spans(marked: Column) -> Column:
    """Structs (start, kind number, end) of seeds."""
    return F.transform(marked, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))


def _spans(text: Column, number: int, kind: str) -> Column:
    rows = F.filter(_located(text, FORMS[kind]), lambda r: _valid(kind, r["match"]))
    rows = F.transform(rows, lambda r: F.struct(
        r["start"].alias("start"), F.lit(number).alias("kind"), (r["start"] + F.length(r["match"])).alias("end"),
        F.xxhash64(r["match"]).alias("instance"), _patterns(r["left"], r["match"], r["right"]).alias("patterns")))
    need = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
    return F.when(need, rows).otherwise(F.array().cast(SEEDS))


def _patterns(left: Column, core: Column, right: Column) -> Column:
    """Hashes of the word before with the shape, and of the shape with the word after."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[0-9]++", "9"), "[a-z]++", "a"), "[A-Z]++", "A")
    return _let(shape, lambda x: F.array(F.xxhash64(F.lit("before"), left, x), F.xxhash64(F.lit("after"), x, right)))


def _apart(found: Column, marked: Column) -> Column:
    """The spans of ``found`` (in order, apart from each other) that no span of ``marked`` overlaps.

    As many marked spans end before one as begin before its end. Both are counted by running sums over the sorted ends
    of all spans: order at one place is marked ends, found ends, found starts, marked starts.
    """
    def event(at: Column, order: int, weight: int) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(weight).cast("long").alias("weight"))

    events = F.array_sort(F.concat(
        F.transform(marked, lambda b: event(b["end"], 0, 1)), F.transform(found, lambda c: event(c["end"], 1, 0)),
        F.transform(found, lambda c: event(c["start"], 2, 0)), F.transform(marked, lambda b: event(b["start"], 3, 1 << 32))))

    def kept(s: Column) -> Column:
        counted = F.zip_with(s["events"], running(F.transform(s["events"], lambda e: e["weight"]), lambda x, y: x + y, 0), lambda e, n: F.struct(e["order"].alias("order"), n.alias("n")))
        ended = lambda e: e["n"] % F.lit(1 << 32)
        begun = lambda e: F.shiftright(e["n"], 32)
        return _let(counted, lambda c: _let(
            F.struct(F.transform(F.filter(c, lambda e: e["order"] == 2), ended).alias("ended"), F.transform(F.filter(c, lambda e: e["order"] == 1), begun).alias("begun")),
            lambda t: F.filter(s["found"], lambda x, k: F.get(t["ended"], k) == F.get(t["begun"], k))))

    return F.when((F.size(marked) == 0) | (F.size(found) == 0), found).otherwise(_let(F.struct(events.alias("events"), found.alias("found")), kept))


def candidates(texts: DataFrame) -> DataFrame:
    """``texts`` (``body`` and its seeds ``marked``) with ``seen``, what may be an identifier: place, instance and patterns
    (contexts and shape), and its kind if it is a seed.

    Each seed is one candidate, whatever words it spans. The others are single words and runs of number words that
    no seed overlaps; a run and its words are all candidates, and the patterns tell which of them is meant.
    """
    trimmed = r"^([^A-Za-z0-9+]*+)(.*[A-Za-z0-9])"

    def row(r: Column) -> Column:
        core = F.regexp_extract(r["match"], trimmed, 2)
        begin = r["start"] + F.length(F.regexp_extract(r["match"], trimmed, 1))
        return F.struct(begin.alias("start"), (begin + F.length(core)).alias("end"), F.xxhash64(core).alias("instance"),
                        _patterns(r["left"], core, r["right"]).alias("patterns"), F.lit(None).cast("int").alias("kind"))

    known = F.transform("marked", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["instance"].alias("instance"), b["patterns"].alias("patterns"), b["kind"].alias("kind")))
    out, keep = texts, texts.columns
    for name, form in (("words", CANDIDATE), ("spaced", SPACED)):  # step by step, so that no expression is nested deeply
        out = out.withColumn(name, F.when(F.col("body").rlike("[0-9@]"), _located(F.col("body"), form)).otherwise(F.array().cast(LOCATED)))
        out = out.withColumn(name, F.filter(F.transform(name, row), lambda c: c["end"] > c["start"]))
        out = out.withColumn(name, _apart(F.col(name), F.col("marked")))
    return out.select(*keep, F.concat(known, "words", "spaced").alias("seen"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``, ``confidence`` and ``kind`` of the patterns that the seeds vouch for.

    ``edges`` are distinct (pattern, instance) with the ``kind`` of the instance if it is a seed. Each round gives a
    pattern the weight of its instances over their number plus one, and an instance the chance that some kept pattern
    is right about it; seeds weigh 1. A pattern's kind is that of most of its seeds, the first on ties. Both sides are
    grouped with map-side sums, so a pattern with a third of all rows is one row per task.
    """
    seed = F.col("kind").isNotNull()
    weighed = edges.withColumn("weight", seed.cast("double"))
    votes = [F.sum((F.col("kind") == k).cast("int")).alias(f"votes{k}") for k in range(len(KINDS))]
    kind = F.array_position(F.array(*(F.coalesce(f"votes{k}", F.lit(0)) for k in range(len(KINDS)))), F.greatest(*(F.coalesce(f"votes{k}", F.lit(0)) for k in range(len(KINDS))))) - 1
    for k in range(rounds):
        scored = weighed.groupBy("pattern").agg((F.sum("weight") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.sum("weight").alias("support"), *votes)
        kept = stored(scored.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence", kind.cast("int").alias("kind")), "patterns")
        if k < rounds - 1:
            vouched = _of_patterns(edges.select("pattern", "instance"), kept).groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("vouched"))
            weighed = edges.join(vouched, "instance", "left").withColumn("weight", F.greatest(seed.cast("double"), F.coalesce("vouched", F.lit(0.0))))
    return kept


def _of_patterns(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_PATTERNS else kept, "pattern")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Seeds and discovered identifiers of every whole text (null: empty).

    Returns ``doc_id``, ``base`` and ``found``: arrays of (start, kind, end) sorted by start and kind; kinds from
    ``len(KINDS)`` on are discovered identifiers that look like that kind (of several patterns the most confident
    tells, the first kind on ties). One row per input row (repeated rows too); an empty table gives an empty one;
    other columns are left out. Texts may be of any length. Each text is scanned once; what goes on is positions and
    hashes, never texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).withColumn("marked", seeds(F.col("body"))))
    rows = stored(scanned.select("doc_id", base_spans(F.col("marked")).alias("base"), "seen", F.monotonically_increasing_id().alias("row")), "pii")
    words = rows.select("row", F.explode("seen").alias("c")).select("row", "c.*").select("row", "start", "end", "instance", "kind", F.explode("patterns").alias("pattern"))
    edges = stored(words.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "pii-edges")
    kept = confident_patterns(edges, rounds)
    hits = _of_patterns(words.where("kind is null").drop("kind"), kept).groupBy("row", "start", "end").agg(F.min(F.struct(-F.col("confidence"), "kind")).alias("best"))
    more = hits.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("best.kind") + len(KINDS)).alias("kind"), "end")).alias("more"))
    return rows.join(more, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("found"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in (*KINDS, *(f"like_{k}" for k in KINDS))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of seeds by kind, the digest of the seeds' spans, and all spans as text."""
    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == n)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))
