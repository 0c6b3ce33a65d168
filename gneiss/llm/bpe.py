"""Exact byte-level BPE by backtracking over longest matches, and decoding by an offset table.

The encoder walks a word with an Aho-Corasick automaton over the vocabulary: ``longest[i]`` is the longest token
that ends at byte i. A sequence of tokens is what merging by rank gives exactly when each neighbouring pair is
compatible, that is, when merging the pair's own bytes gives the pair back; so a word's tokens are found by
taking longest tokens from the left and backing up to a token's longest proper prefix token where a pair fails.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.workers import give_back

#: The pattern of the byte-level pre-tokenizer (fixed by the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words longer than this are encoded but not remembered, and a worker forgets its words beyond this many.
CACHED_CHARS, CACHED_WORDS = 40, 400_000
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, merge ranks and the special tokens of a ``tokenizers`` JSON file."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        letters, model = byte_letters(), data["model"]
        as_bytes = lambda text: bytes(letters[c] for c in text)
        self.ids = {as_bytes(k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for k, v in self.ids.items():
            self.tokens[v] = k
        for k, v in self.special.items():
            self.tokens[v] = k.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges.setdefault((left, right), (rank, made))
            self.parts.setdefault(made, (left, right))
        self.rank = {made: rank for (rank, made) in sorted(self.merges.values(), reverse=True)}


class Pairs(dict):
    """Whether two tokens (``left << 32 | right``) stay apart when their bytes are merged by rank."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary

    def __missing__(self, key: int) -> bool:
        known = self.apart(key >> 32, key & 0xFFFFFFFF, 1 << 60)
        if len(self) < PAIRS:
            self[key] = known
        return known

    def apart(self, left: int, right: int, limit: int) -> bool:
        """Undo merges from both sides of the seam, the later one first, and look for a merge across the seam
        that would have come before what was undone (before ``limit`` at first)."""
        merges, parts, rank = self.v.merges, self.v.parts, self.v.rank
        while (seam := merges.get((left, right))) is None or seam[0] >= limit:
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # equal ranks go from the left, so a seam merge must come strictly before left's last one
                limit, left = a, parts[left][1]
            else:  # and a seam merge of the rank of right's last one still comes before it
                limit, right = b + 1, parts[right][0]
        return False


class Encoder:
    """Encodes one word (pre-token) at a time."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.v, self.pairs = vocabulary, Pairs(vocabulary)
        self.size = [len(t) for t in vocabulary.tokens]
        #: Tokens that merging their own bytes ends in; only these can occur.
        self.reachable: set[int] = {k for t, k in vocabulary.ids.items() if len(t) == 1}
        for made in sorted(vocabulary.rank, key=vocabulary.rank.get):
            left, right = vocabulary.parts[made]
            if left in self.reachable and right in self.reachable and self.pairs.apart(left, right, vocabulary.rank[made]):
                self.reachable.add(made)
        self.automaton = ahocorasick.Automaton()
        for token, k in vocabulary.ids.items():
            if k in self.reachable:
                self.automaton.add_word(token.decode("latin-1"), k)
        self.automaton.make_automaton()
        #: A token's longest proper prefix that is a token, -1 for single bytes.
        self.shorter: dict[int, int] = {}

    def prefix(self, token: int) -> int:
        if (found := self.shorter.get(token)) is None:
            data, ids, found = self.v.tokens[token], self.v.ids, -1
            for n in range(len(data) - 1, 0, -1):
                if (k := ids.get(data[:n], -1)) in self.reachable:
                    found = k
                    break
            self.shorter[token] = found
        return found

    def word(self, data: bytes) -> list[int]:
        """Token ids of a word: leftmost-longest matches while all pairs fit, then backtracking."""
        whole = self.v.ids.get(data, -1)
        if whole in self.reachable:
            return [whole]
        pairs, text = self.pairs, data.decode("latin-1")
        greedy = [k for _, k in self.automaton.iter_long(text)]
        last = greedy[0]
        for n in range(1, len(greedy)):
            if not pairs[last << 32 | greedy[n]]:
                return self.backtrack(text, greedy, n)
            last = greedy[n]
        return greedy

    def backtrack(self, text: str, greedy: list[int], n: int) -> list[int]:
        """Go on from ``greedy[:n]``, which ``greedy[n]`` doesn't fit. Positions after which nothing fits are dead,
        so each is left at most once and the work stays linear in the word."""
        size, pairs = self.size, self.pairs
        out, token = greedy[:n], greedy[n]
        at, stop = sum(map(size.__getitem__, out)), len(text)
        longest = {end - size[k]: k for end, k in self.automaton.iter(text)}  # by begin - 1; later ends are longer
        dead: set[int] = set()
        while True:
            end = at + size[token]
            if end not in dead and (not out or pairs[out[-1] << 32 | token]):
                out.append(token)
                at = end
                if at == stop:
                    return out
                token = longest[at - 1]
            elif (shorter := self.prefix(token)) >= 0:
                token = shorter
            else:  # nothing fits here: the token before must end elsewhere
                dead.add(at)
                token = out.pop()
                at -= size[token]


class Words(dict):
    """Little-endian ids of each word, made when first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder
        self.little = [k.to_bytes(4, "little") for k in range(len(encoder.size))]

    def __missing__(self, word: str) -> bytes:
        data = word.encode("utf-8")
        return remembered(self, word, b"".join([self.little[k] for k in self.encoder.word(data)]))


class Pieces(dict):
    """Ids of a space and what follows it up to the next space; None where white space follows."""

    def __init__(self, words: Words, find) -> None:
        super().__init__()
        self.words, self.find = words, find

    def __missing__(self, piece: str) -> bytes | None:
        words = self.words
        if not piece or piece[0].isspace():
            return None
        return remembered(self, piece, b"".join([words[w] for w in self.find(" " + piece)]))


def remembered(cache: dict, key: str, ids: bytes) -> bytes:
    if len(key) <= CACHED_CHARS:
        if len(cache) >= CACHED_WORDS:
            cache.clear()
        cache[key] = ids
    return ids


class Codec:
    """``encode`` text to little-endian unsigned 32-bit ids, ``decode`` them to bytes."""

    def __init__(self, spec: str) -> None:
        import numpy as np
        import regex

        self.v = Vocabulary(spec)
        self.words = Words(Encoder(self.v))
        self.find = regex.compile(PATTERN).findall
        self.pieces = Pieces(self.words, self.find)
        special = sorted(self.v.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.offsets = np.zeros(len(self.v.tokens) + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(t) for t in self.v.tokens])
        self.bytes = np.frombuffer(b"".join(self.v.tokens), np.uint8)

    def encode(self, text: str) -> bytes:
        if self.split is None or not any(x in text for x in self.v.special):
            return self._plain(text)
        return b"".join([self.v.special[x].to_bytes(4, "little") if k % 2 else self._plain(x) for k, x in enumerate(self.split(text))])

    def _plain(self, text: str) -> bytes:
        words, pieces = self.words, self.pieces
        first, *rest = text.split(" ")
        try:
            return b"".join([words[w] for w in self.find(first)] + [pieces[x] for x in rest])
        except TypeError:  # a space with white space after it: what it belongs to depends on what is before it
            return b"".join([words[w] for w in self.find(text)])

    def decode(self, ids: bytes, step: int = 1 << 18) -> bytes:
        """Copy each token's bytes from the offset table, ``step`` tokens at a time."""
        import numpy as np

        every, out = np.frombuffer(ids, np.dtype("<u4")), []
        for k in range(0, len(every), step):
            part = every[k : k + step]
            begin = self.offsets[part]
            size = self.offsets[part + 1] - begin
            ends = np.cumsum(size)
            at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_vocabulary(spark: SparkSession, path: str) -> str:
    """The tokenizer file's text; the driver reads it (a few MB whatever the corpus) and tasks get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _codec(shared: dict) -> Codec:
    """The worker process's codec: built once, kept in the broadcast value for its later tasks."""
    if "codec" not in shared:
        shared["codec"] = Codec(shared["spec"])
    return shared["codec"]


def _over_texts(docs: DataFrame, spec: str, made: str, one) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast({"spec": spec})
    names = [x.split()[0] for x in made.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            rows = [one(codec, doc_id.as_py(), text.as_py()) for doc_id, text in zip(batch.column(0), batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        batch = rows = None
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, made)


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """Encode each whole text (null: empty), decode the ids, and return counts and digests per row.

    Special tokens' strings in a text become their ids, as the library does by default. Repeated rows give
    repeated rows; an empty table gives an empty one; other columns are left out; equal texts have equal digests, and
    merges of equal rank go from the left, so there are no ties. Texts of any length are encoded whole. No shuffle:
    each Arrow batch is encoded where it is read.
    """

    def one(codec: Codec, doc_id, text):
        ids = codec.encode(text or "")
        decoded = codec.decode(ids).decode("utf-8", "replace").encode()
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _over_texts(docs, spec, RESULT, one)


def encode(docs: DataFrame, spec: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of each whole text."""

    def one(codec: Codec, doc_id, text):
        ids = codec.encode(text or "")
        return doc_id, len(ids) // 4, ids

    return _over_texts(docs, spec, "doc_id long, n_tokens long, ids binary", one)


def decode(tokens: DataFrame, spec: str) -> DataFrame:
    """The texts of ``encode``'s rows (``doc_id``, ``ids``); null ids give the empty text."""

    def one(codec: Codec, doc_id, ids):
        return doc_id, codec.decode(ids or b"").decode("utf-8", "replace")

    return _over_texts(tokens.selectExpr("doc_id", "ids text"), spec, "doc_id long, text string", one)
