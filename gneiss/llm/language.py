"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language; affix, n-gram and lexicon features score words, learned transitions score
neighbours, and forward-backward gives each word's distribution. A document's language is the one with the
largest mean probability over its words, so code-switched text is judged by what it mostly is. Features are hashed to
a table of weights; words are scored many at a time. Labels are known by text only, so transitions are learned from
sequences that are put together from spans of differently labelled texts: the switching is simulated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.workers import give_back
from gneiss.plans.storage import arrow_rows, stored

UNKNOWN = "und"
#: Longer pieces between white space are cut into parts of so many letters.
LONGEST = 40
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


#: Longer texts go through forward-backward in segments of so many words.
SEGMENT = 50_000
#: Texts are split into words by so many characters at a time.
PIECE = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)  # mixing constants
_WHITE = re.compile(r"\s")
#: Texts that a worker gets at a time in ``confident``, and up to so many hashes of texts are broadcast.
ROWS, BROADCAST_TEXTS = 1_000, 500_000


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit: at most ``documents`` labelled texts, of each at most ``spans`` spans of ``span``
    words and ``span_chars`` characters, go to the driver. ``bits``: of the table of weights."""

    documents: int = 1500
    spans: int = 8
    span: int = 64
    span_chars: int = 4_096
    least_count: int = 3
    bits: int = 18
    batch: int = 192
    steps: int = 120
    rate: float = 0.3
    decay: float = 1e-5
    seed: int = 7


def letters(piece: str) -> str:
    """The piece without what is not a letter at its ends; empty if it holds none."""
    a, b = 0, len(piece)
    while a < b and not piece[a].isalpha():
        a += 1
    while b > a and not piece[b - 1].isalpha():
        b -= 1
    return piece[a:b].lower()


def chunks(piece: str) -> list[str]:
    """The words of a piece between white space: itself, or consecutive parts of one longer than ``LONGEST``."""
    word = letters(piece)
    return [w for k in range(0, len(word), LONGEST) if (w := letters(word[k : k + LONGEST]))]


def _mixed(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(_ODD[0])
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(_ODD[1])) >> np.uint64(64 - bits)).astype(np.int64)


def features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words (not empty, at most ``LONGEST`` letters) as (row of the table, word it belongs to):
    lexicon entry, prefixes and suffixes of 1 to 4 letters, 2-grams and 3-grams with the word's ends."""
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 2)
    first, last = ends - sizes - 1, ends - 2  # of each word's letters
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    odd = [np.uint64(x) for x in _ODD]
    power = np.cumprod(np.full(LONGEST + 3, odd[2]))
    place = np.arange(len(codes)) - np.repeat(first - 1, sizes + 2)
    rows = [_mixed(np.add.reduceat(codes * power[np.minimum(place, LONGEST + 2)], first - 1), 1, bits)]
    owners = [np.arange(len(words))]
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(4):
        has = np.flatnonzero(sizes > k)
        head[has] = head[has] * odd[3] + codes[first[has] + k]
        tail[has] = tail[has] * odd[3] + codes[last[has] - k]
        rows += [_mixed(head[has], 2 + k, bits), _mixed(tail[has], 6 + k, bits)]
        owners += [has, has]
    two = codes[:-1] * odd[2] + codes[1:]
    same = owner[:-1] == owner[1:]
    rows.append(_mixed(two[same], 10, bits))
    owners.append(owner[:-1][same])
    same = owner[:-2] == owner[2:]
    rows.append(_mixed((two[:-1] * odd[2] + codes[2:])[same], 11, bits))
    owners.append(owner[:-2][same])
    return np.concatenate(rows), np.concatenate(owners)


class Rows(dict):
    """The table row of each piece between white space; a piece that is new gets the next one and waits to be scored.

    Pieces without a letter are row 0. A piece of more than ``LONGEST`` letters is several words; it gets a negative
    number, ``parts[-number]`` has their rows.
    """

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []
        self.parts: list[list[int]] = [[]]
        self.used = 0

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONGEST:
            self.parts.append([self[w] for w in chunks(piece)])
            row = 1 - len(self.parts)
        elif word := piece.lower() if piece.isalpha() else letters(piece):
            if len(word) > LONGEST:  # lower case may be longer
                word = word[:LONGEST]
            self.used += 1
            row = self.used
            self.waiting.append(word)
        else:
            row = 0
        if len(piece) <= LONGEST:
            self[piece] = row
        return row


@dataclass
class Model:
    """Weights by hashed feature (a row for each), transitions by language, as log scores."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    cache: Rows = field(default_factory=Rows)
    table: np.ndarray | None = None

    #: Pieces whose scores a worker keeps; between texts it starts anew beyond this many.
    CACHED = 200_000

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores (word, language)."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        bits = len(self.weights).bit_length() - 1
        for a in range(0, len(words), 10_000):
            part = words[a : a + 10_000]
            rows, owners = features(part, bits)
            for k in range(len(self.languages)):
                out[a : a + len(part), k] = np.bincount(owners, self.weights[rows, k], len(part))
        return out

    def rows(self, text: str) -> np.ndarray:
        """The row of each word of a text."""
        found, cache, at = [], self.cache, 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                end = m.end() if (m := _WHITE.search(text, end)) else len(text)
            rows = list(map(cache.__getitem__, text[at:end].split()))
            if len(cache.parts) > 1 and rows and min(rows) < 0:
                rows = [r for k in rows for r in (cache.parts[-k] if k < 0 else (k,))]
            found.append(np.array(rows, np.int32))
            at = end
        out = np.concatenate(found) if found else np.zeros(0, np.int32)
        return out[out > 0]

    def settle(self) -> np.ndarray:
        """Score what is waiting; the table of all rows (row 0 is for padding)."""
        if self.table is None:
            self.table = np.zeros((1, len(self.languages)), np.float32)
        if self.cache.waiting:
            self.table = np.concatenate([self.table, self.scores(self.cache.waiting)])
            self.cache.waiting = []
        return self.table

    def forget(self) -> None:
        self.cache, self.table = Rows(), None


def posteriors(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over padded sequences in falling order of length.

    ``emissions`` (time, sequence, language) are log scores; the result holds each word's probabilities, zero
    beyond a sequence's end.
    """
    steps = emissions.shape[0]
    local = np.exp(emissions - emissions.max(2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    alpha = np.zeros_like(local)
    state = local[0] / local[0].sum(1, keepdims=True)
    alpha[0] = state
    for t in range(1, steps):
        n = active[t]
        state = (state[:n] @ move) * local[t, :n]
        state /= state.sum(1, keepdims=True)
        alpha[t, :n] = state
    beta = np.ones_like(local[0])
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        alpha[t + 1, :n] *= beta[:n]
        back = (local[t + 1, :n] * beta[:n]) @ move.T
        beta[:n] = back / back.sum(1, keepdims=True)
    alpha[0] *= beta
    total = alpha.sum(2, keepdims=True)
    return np.divide(alpha, total, out=alpha, where=total > 0)


def segmented_means(table: np.ndarray, rows: np.ndarray, transitions: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Mean probabilities over one long text's words, exact, in memory for one segment: the forward pass keeps its
    message at each segment's begin, the backward pass goes through each segment's forward messages again."""
    move = np.exp(transitions - transitions.max()).astype(np.float64)

    def local(a: int) -> np.ndarray:
        scores = table[rows[a : a + segment]].astype(np.float64)
        return np.exp(scores - scores.max(1, keepdims=True))

    def forward(state: np.ndarray | None, part: np.ndarray) -> np.ndarray:
        out = np.empty_like(part)
        for t, x in enumerate(part):
            state = x if state is None else (state @ move) * x
            state = state / state.sum()
            out[t] = state
        return out

    starts, kept, state = list(range(0, len(rows), segment)), [], None
    for a in starts:
        kept.append(state)
        state = forward(state, local(a))[-1]
    beta, total = np.ones(len(move)), np.zeros(len(move))
    for a, state in zip(reversed(starts), reversed(kept)):
        part = local(a)
        alpha, betas = forward(state, part), np.empty_like(part)
        for t in range(len(part) - 1, -1, -1):
            betas[t] = beta
            beta = move @ (part[t] * beta)
            beta = beta / beta.sum()
        gamma = alpha * betas
        total += (gamma / gamma.sum(1, keepdims=True)).sum(0)
    return total / len(rows)


def fit(texts: list[str], labels: list[str], settings: Training = Training()) -> Model | None:
    """Learn weights and transitions by gradient ascent on the likelihood of code-switched word sequences.

    Sequences are spans of the given texts set one after another; a word's language is its text's label. None if
    there is no labelled word.
    """
    rng = np.random.default_rng(settings.seed)
    languages = sorted(set(labels))
    by_language: list[list[list[str]]] = [[] for _ in languages]
    counts: dict[str, int] = {}
    for text, label in sorted(zip(texts, labels)):
        words = [w for p in text.split() for w in chunks(p)]
        if words:
            by_language[languages.index(label)].append(words)
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    keep = [k for k, d in enumerate(by_language) if d]
    if not keep:
        return None
    languages, by_language = [languages[k] for k in keep], [by_language[k] for k in keep]
    n, buckets = len(languages), 1 << settings.bits
    model = Model(languages, np.zeros((buckets, n), np.float32), np.zeros((n, n), np.float32))
    if n == 1:
        return model
    known = sorted(counts)
    rows, owner = features(known, settings.bits)
    often = np.bincount(rows, np.array([counts[w] for w in known], float)[owner], buckets) >= settings.least_count
    squares, squares_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    for _ in range(settings.steps):
        words, gold = [], np.zeros((settings.span, settings.batch), np.int64)
        for b in range(settings.batch):
            sequence: list[str] = []
            while len(sequence) < settings.span:
                k = int(rng.integers(n))
                doc = by_language[k][int(rng.integers(len(by_language[k])))]
                size = min(int(rng.geometric(1 / 20)), settings.span - len(sequence), len(doc))
                begin = int(rng.integers(len(doc) - size + 1))
                gold[len(sequence) : len(sequence) + size, b] = k
                sequence += doc[begin : begin + size]
            words.append(sequence)
        flat = [w for t in zip(*words) for w in t]
        rows, owner = features(flat, settings.bits)
        emissions = np.stack([np.bincount(owner, model.weights[rows, k], len(flat)) for k in range(n)], 1).reshape(settings.span, settings.batch, n)
        local = np.exp(emissions - emissions.max(2, keepdims=True))
        move = np.exp(model.transitions)
        gamma = posteriors(emissions, np.full(settings.batch, settings.span), model.transitions)
        # expected transitions need both passes; with forward messages and posteriors: xi = a_t M (g_{t+1} / (a_t M))
        alpha = local[0] / local[0].sum(1, keepdims=True)
        expected = np.zeros((n, n))
        for t in range(settings.span - 1):
            ahead = alpha @ move
            expected += np.einsum("bi,ij,bj->ij", alpha, move, gamma[t + 1] / np.maximum(ahead, 1e-12))
            alpha = ahead * local[t + 1]
            alpha /= alpha.sum(1, keepdims=True)
        seen = np.zeros((n, n))
        np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        residual = (np.eye(n)[gold] - gamma).reshape(-1, n).astype(np.float32) / settings.batch
        gradient = np.stack([np.bincount(rows, residual[owner, k], buckets) * often for k in range(n)], 1) - settings.decay * model.weights
        squares += gradient**2
        model.weights += (settings.rate * gradient / np.sqrt(squares)).astype(np.float32)
        gradient_t = (seen - expected) / settings.batch
        squares_t += gradient_t**2
        model.transitions += (settings.rate * gradient_t / np.sqrt(squares_t)).astype(np.float32)
    return model


def held_out() -> F.Column:
    """Documents that no fit may see: crc32 of the doc_id as text leaves remainder 1 by 3 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _spans(settings: Training) -> F.Column:
    """Spans of a text's words, one from each of equal parts, as many as it has spans; short texts go whole."""
    words, n = F.split("text", r"\s+"), F.size(F.split("text", r"\s+"))
    parts = F.least(F.lit(settings.spans), F.ceil(n / settings.span).cast("int"))

    def span(s: F.Column, j: F.Column) -> F.Column:
        part = F.floor(s["n"] / s["parts"])
        begin = (F.floor(j * s["n"] / s["parts"]) + F.pmod(F.xxhash64("doc_id", j), F.greatest(part - settings.span + 1, F.lit(1)))).cast("int")
        return F.substring(F.array_join(F.slice(s["words"], begin + 1, F.lit(settings.span)), " "), 1, settings.span_chars)

    return F.transform(F.array(F.struct(words.alias("words"), n.alias("n"), parts.alias("parts"))), lambda s: F.transform(F.sequence(F.lit(0), s["parts"] - 1), lambda j: span(s, j)))[0]


def train(docs: DataFrame, settings: Training = Training()) -> Model | None:
    """Fit on at most ``settings.documents`` labelled documents outside the held-out third, chosen by hash of doc_id, of
    which bounded spans go to the driver. Rows that repeat a doc_id count once (the least)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = [r[0] for r in labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.documents).collect()]
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(sorted(set(chosen)), pa.int64())}))  # from Arrow: no Python workers
    sample = (labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", _spans(settings).alias("spans"))
              .groupBy("doc_id").agg(F.min(F.struct("lang", "spans")).alias("row")).select("row.*"))
    rows = [(span, r.lang) for r in sample.collect() for span in r.spans]
    return fit([x for x, _ in rows], [x for _, x in rows], settings)


def label_texts(model: Model, texts: list[str | None], cells: int = 400_000) -> list[tuple[str, float]]:
    """Language and mean probability of each whole text; ``und`` and 0 if it is null or has no letter."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    group: list[tuple[int, np.ndarray]] = []

    def put(k: int, mean: np.ndarray) -> None:
        best = int(mean.argmax())
        out[k] = (model.languages[best], float(min(1.0, max(0.0, mean[best]))))

    def score(part: list[tuple[int, np.ndarray]]) -> None:
        lengths = np.array([len(r) for _, r in part])
        where = np.zeros((int(lengths[0]), len(part)), np.int32)
        for b, (_, rows) in enumerate(part):
            where[: len(rows), b] = rows
        means = posteriors(model.table[where], lengths, model.transitions).sum(0) / lengths[:, None]
        for (k, _), mean in zip(part, means):
            put(k, mean)

    def drain() -> None:
        table = model.settle()
        group.sort(key=lambda x: -len(x[1]))
        begin = 0
        while begin < len(group):
            k, rows = group[begin]
            if len(rows) > SEGMENT:
                put(k, segmented_means(table, rows, model.transitions))
                begin += 1
                continue
            count = max(1, cells // len(rows))
            score(group[begin : begin + count])
            begin += count
        group.clear()

    held = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(model.cache) > model.CACHED:
            drain()
            model.forget()
            held = 0
        rows = model.rows(text)
        if len(rows):
            group.append((k, rows))
            held += len(rows)
        if held > 1_500_000:
            drain()
            held = 0
    drain()
    return out


def _plain(model: Model | None) -> dict:
    """What goes to executors: plain data, from which a worker process builds its model once."""
    return {} if model is None else {"languages": model.languages, "weights": model.weights, "transitions": model.transitions}


def _fitted(shared: dict) -> Model | None:
    """The worker process's model; its table of words is kept in the broadcast value between tasks."""
    if shared and "model" not in shared:
        shared["model"] = Model(shared["languages"], shared["weights"], shared["transitions"])
    return shared.get("model")


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of every whole text: no shuffle, words scored where they are read.

    Without a model (no labelled text) every row is ``und``. Repeated rows give repeated rows; an empty table gives an
    empty one; other columns are left out, and lang, source and doc_id play no part in a prediction. Of languages with
    equal probability the first by name is taken. Texts of any length are scored whole, in bounded memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = _fitted(shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = label_texts(fitted, texts) if fitted else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )
        if fitted:
            fitted.forget()  # an idle worker keeps weights alone
        give_back()

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, RESULT)


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (input columns of these names are replaced).

    Rows keep all their columns; the texts pass through Arrow once and nothing is shuffled.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(_plain(model))
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = _fitted(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = label_texts(fitted, texts) if fitted else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*keep, "lang_pred", "lang_score"])
        if fitted:
            fitted.forget()
        give_back()

    return docs.select(*keep).mapInArrow(run, schema)


def confident(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a known language with a score of at least ``least``, all columns kept.

    Texts go to workers ``ROWS`` at a time and only hashes (128 bits) of those to be left out come back; they are
    written here, and left out by a broadcast up to ``BROADCAST_TEXTS``, by an exchange beyond. Null texts and those
    without letters go, repeated rows stay or go together.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_plain(model))
    hashes = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = _fitted(shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = label_texts(fitted, texts) if fitted else [(UNKNOWN, 0.0)] * len(texts)
            yield batch.select([0, 1]).filter(pa.array([lang == UNKNOWN or score < least for lang, score in found], pa.bool_()))
        if fitted:
            fitted.forget()
        batch = texts = found = None
        give_back()

    with arrow_rows(spark, ROWS):
        unsure = stored(docs.select(hashes[0].alias("h"), hashes[1].alias("h2"), "text").mapInArrow(run, "h long, h2 long").distinct(), "unsure")
    few = unsure.count() <= BROADCAST_TEXTS
    return docs.join(F.broadcast(unsure) if few else unsure, (hashes[0] == unsure["h"]) & (hashes[1] == unsure["h2"]), "left_anti")
