"""Line dedup by pairwise alignment: shared runs of lines find overlapping documents, patience diff aligns them.

The later document (larger doc_id) of a pair loses the blocks that the earlier one holds too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.workers import give_back
from gneiss.plans.storage import arrow_rows, stored

#: A common block goes if it has at least so many words.
MIN_WORDS = 20
#: Up to so many shared runs, ids of texts or deleted lines are broadcast; more are joined by an exchange, where AQE
#: splits hot keys.
BROADCAST_RUNS, BROADCAST_IDS, BROADCAST_LINES = 300_000, 500_000, 1_000_000
#: Rows that a worker gathers before it hands them on.
FLUSH = 50_000
#: Documents whose lines a worker gets at a time.
ROWS = 1_000
#: What doesn't count at the ends of a line, and the odd factor of the hash of a run.
WHITE, FACTOR = " \t\x0b\f\r", 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Names that the join adds; they hold a character that no column of a table here does.
DEDUP_ID, DEDUP_TAG, DEDUP_GONE = "dedup\u00b7id", "dedup\u00b7tag", "dedup\u00b7gone"


def patience(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned positions of two documents' shared lines, given as (position, hash) in order.

    Lines that each side holds once are the anchors; a longest run of them in the same order on both sides
    (patience sorting) is aligned, and equal lines next to an aligned one are taken in as long as they follow on.
    """
    at_left, at_right = _once(left), _once(right)
    anchors = sorted((at_left[h], at_right[h]) for h in at_left.keys() & at_right.keys())
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, r) in enumerate(anchors):
        pile = bisect_left(tops, r)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(r)
            piles.append(k)
        else:
            tops[pile], piles[pile] = r, k
    k, chain = piles[-1] if piles else -1, []
    while k >= 0:
        chain.append(anchors[k])
        k = back[k]
    chain.reverse()
    lines_left, lines_right = dict(left), dict(right)
    aligned = dict(chain)
    used = set(aligned.values())
    for step in (1, -1):
        for a, b in chain if step == 1 else reversed(chain):
            a, b = a + step, b + step
            while a in lines_left and b in lines_right and lines_left[a] == lines_right[b] and a not in aligned and b not in used:
                aligned[a] = b
                used.add(b)
                a, b = a + step, b + step
    return sorted(aligned.items())


def _once(lines: list[tuple[int, int]]) -> dict[int, int]:
    seen: dict[int, int] = {}
    for k, h in lines:
        seen[h] = -1 if h in seen else k
    return {h: k for h, k in seen.items() if k >= 0}


def blocks(aligned: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of aligned lines that follow one another in both documents."""
    out: list[list[tuple[int, int]]] = []
    for a, b in aligned:
        if out and out[-1][-1] == (a - 1, b - 1):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def runs(lines: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(first index, last index, hash) of the shortest runs of at least ``least`` words from each line and up to each line.

    ``lines`` are (position, hash, words) in order; a run's positions follow one another. Any longer run is covered
    by those inside it, so two documents that hold a run of so many words share the hashes that cover it.
    """
    spans: set[tuple[int, int]] = set()
    start = 0
    for end in range(1, len(lines) + 1):
        if end < len(lines) and lines[end][0] == lines[end - 1][0] + 1:
            continue
        first, from_first, last, up_to_last = start, 0, start, 0
        for k in range(start, end):
            from_first += lines[k][2]
            up_to_last += lines[k][2]
            while last < k and up_to_last - lines[last][2] >= least:
                up_to_last -= lines[last][2]
                last += 1
            if up_to_last >= least:
                spans.add((last, k))
            while first <= k and from_first >= least:
                spans.add((first, k))
                from_first -= lines[first][2]
                first += 1
        start = end
    sums, powers = [0], [1]
    for _, h, _ in lines:
        sums.append((sums[-1] * FACTOR + h) & _MASK)
        powers.append(powers[-1] * FACTOR & _MASK)
    out = []
    for a, b in spans:
        h = (sums[b + 1] - sums[a] * powers[b + 1 - a]) & _MASK
        out.append((a, b, h - (1 << 64) if h >> 63 else h))
    return out


def common(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], least: int) -> set[int]:
    """Positions of the right document's lines in blocks of at least ``least`` words that the left one holds too.

    Lines are (position, hash, words). Patience alignment finds the blocks in common order; runs that it leaves,
    as their lines are repeated or in another order, are looked up in the whole left document.
    """
    words = {p: w for p, _, w in right}
    out: set[int] = set()
    for block in blocks(patience([x[:2] for x in left], [x[:2] for x in right])):
        if sum(words[b] for _, b in block) >= least:
            out.update(b for _, b in block)
    rest = [(a, b, h) for a, b, h in runs(right, least) if any(right[k][0] not in out for k in range(a, b + 1))]
    if rest:
        held = {h for _, _, h in runs(left, least)}
        for a, b, h in rest:
            if h in held:
                out.update(right[k][0] for k in range(a, b + 1))
    return out


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _tag() -> Column:
    """Tells apart texts of rows that repeat a doc_id."""
    return F.xxhash64("text").alias("tag")


def marked_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tag`` and, of the lines that are not blank, ``pos``, hash ``hs`` and number of words ``ws``."""
    full = F.filter(F.transform(_lines(F.col("text")), lambda x, k: F.struct(k.alias("pos"), F.trim(x, F.lit(WHITE)).alias("line"))), lambda x: x["line"] != "")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _tag(), full.alias("full"))
    rows = rows.select("doc_id", "tag", F.transform("full", lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h"), F.size(F.split(x["line"], r"\s+")).alias("w"))).alias("full"))
    return rows.select("doc_id", "tag", F.col("full.pos").alias("pos"), F.col("full.h").alias("hs"), F.col("full.w").alias("ws"))


def _slices(column: pa.Array) -> list[list]:
    flat, ends = column.flatten().to_pylist(), column.offsets.to_pylist()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def run_table(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, tag, h, at, upto): the first place of each of a document's runs, lines numbered without blank ones."""
    schema = "doc_id long, tag long, h long, at int, upto int"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "tag", "h", "at", "upto"])

        rows: list[tuple] = []
        for batch in batches:
            for doc, tag, hs, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _slices(batch.column(2)), _slices(batch.column(3))):
                seen: set[int] = set()
                for a, b, h in sorted(runs(list(zip(range(len(hs)), hs, ws)), min_words)):
                    if h not in seen:
                        seen.add(h)
                        rows.append((doc, tag, h, a, b))
                        if len(rows) == FLUSH:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)
        rows = []
        give_back()

    return marked_lines(docs).select("doc_id", "tag", "hs", "ws").mapInArrow(hashed, schema)


def doomed_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``tag`` (hash of the text) and the sorted positions (from 0) of the lines that alignment deletes.

    Plan: each document's runs of ``min_words`` words are hashed where it is read; one exchange finds each shared
    run's first holder (least doc_id). Later holders are paired with the first one of each of their runs: as many
    pairs as shared runs, never all pairs of a group, and each block finds its earliest holder, however frequent its
    lines are. A pair brings only the earlier document's lines inside shared runs, so what meets in one task is as
    long as the later document. Joins by run or by first holder read written tables, so AQE splits a hot one. Lines
    are compared by 64-bit hash; white space at their ends doesn't count, and lines follow one another if only
    blank ones are between.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        held = stored(run_table(docs, min_words), "runs")
    shared = stored(held.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first"), "shared")
    few = shared.count() <= BROADCAST_RUNS
    holders = stored(held.join(F.broadcast(shared) if few else shared, "h"), "holders")
    heads = stored(holders.where("doc_id = first").groupBy("h").agg(F.min(F.struct("tag", "at", "upto")).alias("s"))
                   .select("h", F.col("s.tag").alias("a_tag"), F.struct("s.at", "s.upto").alias("span")), "heads")
    later = holders.where("doc_id > first").select("h", "first", "doc_id", "tag")
    pairs = stored(later.join(F.broadcast(heads) if few else heads, "h").groupBy("first", "a_tag", "doc_id", "tag").agg(F.array_sort(F.collect_set("span")).alias("spans")), "pairs")

    ids = stored(pairs.select(F.col("first").alias("id"), F.col("a_tag").alias("id_tag")).union(pairs.select("doc_id", "tag")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sides = stored(marked_lines(docs).join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("tag") == F.col("id_tag")), "left_semi").dropDuplicates(["doc_id", "tag"]), "sides")

    left = sides.select(F.col("doc_id").alias("first"), F.col("tag").alias("a_tag"), "hs", "ws")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["upto"])))))
    lines = pairs.join(left, ["first", "a_tag"]).select("doc_id", "tag", "hs", "ws", places.alias("at"))
    lines = lines.select("doc_id", "tag", F.struct("at", F.transform("at", lambda k: F.get("hs", k)).alias("hs"), F.transform("at", lambda k: F.get("ws", k)).alias("ws")).alias("earlier"))
    joined = lines.groupBy("doc_id", "tag").agg(F.collect_list("earlier").alias("earlier")).join(sides, ["doc_id", "tag"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for earlier, pos, hs, ws in zip(batch.column(2), *(_slices(batch.column(k)) for k in (3, 4, 5))):
                where: dict[int, list[int]] = {}
                for k, h in enumerate(hs):
                    where.setdefault(h, []).append(k)
                found: set[int] = set()
                for side in earlier.as_py():
                    mine = sorted(k for h in set(side["hs"]) for k in where.get(h, ()))
                    found |= common(list(zip(side["at"], side["hs"], side["ws"])), [(k, hs[k], ws[k]) for k in mine], min_words)
                places.append([pos[k] for k in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "tag", "gone"])
        give_back()

    return joined.select("doc_id", "tag", "earlier", "pos", "hs", "ws").mapInArrow(align, "doc_id long, tag long, gone array<int>").where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with aligned common blocks deleted from the later document of each pair.

    All columns and rows are kept; ``n_chars`` (if there) is that of what is left, and ``lines_removed`` is added
    (an input column of that name is replaced). Null texts stay null, rows with a null doc_id stay as they are,
    blank lines never count and stay, ties cannot occur between different doc_ids. Rows that repeat a doc_id are
    judged text by text against documents of smaller ids, never against one another. Texts may be of any length.
    An empty table gives an empty one.
    """
    doomed = doomed_lines(docs, min_words=min_words)
    with arrow_rows(docs.sparkSession, ROWS):
        gone = stored(doomed, "doomed")
    keep = [c for c in docs.columns if c.lower() != "lines_removed"]
    lines = gone.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0]
    gone = gone.select(F.col("doc_id").alias(DEDUP_ID), F.col("tag").alias(DEDUP_TAG), F.col("gone").alias(DEDUP_GONE))
    mine = (F.col("doc_id") == F.col(DEDUP_ID)) & (F.xxhash64("text") == F.col(DEDUP_TAG))
    marked = docs.select(*keep).join(F.broadcast(gone) if lines <= BROADCAST_LINES else gone, mine, "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1), F.col(DEDUP_GONE))
    left = F.transform(F.array(F.struct(_lines(F.col("text")).alias("x"), kept.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda k: F.get(s["x"], k)), "\n"))[0]
    text = F.when(F.col(DEDUP_GONE).isNull(), F.col("text")).otherwise(left)
    out = marked.select(*(text.alias(c) if c == "text" else F.col(c) for c in keep), F.coalesce(F.size(DEDUP_GONE), F.lit(0)).cast("long").alias("lines_removed"))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out
