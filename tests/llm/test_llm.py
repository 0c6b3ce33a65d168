"""The training-data operators against brute force, exact round trips and hand-made edge cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gneiss.llm import bpe, components, html_text, language, licenses, line_dedup, media, mixing, neighbours, ngram_join, pii

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 2}", None if t is None else len(t)) for k, t in texts], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long text, repeated rows, a null id, clashing extra columns."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 30000), (5, "same text here today"), (5, "same text here today"), (6, "same text here today"), (None, "no id"), (7, "漢字 🙂 é"), (8, "1" * 5000)]
    df = make(spark, rows)
    for c in ("node", "h", "n", "label", "gone", "mix_key", "set", "lang_pred"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# mixing

def test_mixing_counts_follow_the_rates(spark):
    rows = [(k, "t", "en", "big" if k % 3 else "small", 10) for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.source: r["count"] for r in mixing.replicate(docs).groupBy("source").count().collect()}
    assert abs(got["big"] - 1500) < 160 and abs(got["small"] - 1500) < 160


def test_mixing_counts_are_poisson_quantiles(spark):
    docs = spark.createDataFrame([(k, "t", "en", "a", 1) for k in range(400)] + [(k + 400, "t", "en", "b", 3) for k in range(400)], SCHEMA)
    got = collections.Counter(r.doc_id for r in mixing.replicate(docs, {"a": 3.0, "b": 1.0}, seed=5).select("doc_id").collect())
    for k in range(800):
        rate = 0.75 * 1600 / 400 if k < 400 else 0.25 * 1600 / 1200
        u = int(hashlib.md5(f"5|{k}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, np.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        assert got[k] == n


def test_mixing_odd_rows(odd, none):
    out = mixing.replicate(odd)
    assert set(out.columns) >= {"doc_id", "text", "node", "mix_copy", "mix_key"}
    names = [r.doc_id for r in out.select("doc_id").distinct().collect()]
    assert set(names) <= {r.doc_id for r in odd.select("doc_id").collect()} and out.count() >= len(names) and mixing.replicate(none).count() == 0
    clash = odd.withColumn("mix_source", F.lit("kept")).withColumn("mix_copy", F.lit(99))
    again = mixing.replicate(clash)
    assert again.columns.count("mix_copy") == 1 and again.where("mix_source <> 'kept'").count() == 0 and again.count() == out.count()
    assert mixing.replicate(odd, {"s9": 1.0}).count() == 0


# media

def test_png_round_trip():
    for data in (b"", b"a", b"x" * 64, bytes(range(256)) * 3, os.urandom(1000)):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and payload and media.decode_png(media.encode_png(payload)) == (64, len(payload) // 64, payload)


def test_media_archives(spark, odd, none, tmp_path):
    folder = f"file://{tmp_path}/a"
    media.write_archives(odd, folder)
    rows = media.features(media.read_archives(spark, folder, range_bytes=500)).collect()
    def plain(doc_id, text):
        data = (text or "").encode()
        payload = data + b"\0" * (64 * max(1, -(-len(data) // 64)) - len(data))
        stored = media.encode_png(payload)
        counts = collections.Counter(payload)
        mode = min(counts, key=lambda x: (-counts[x], x))
        feature = f"png8:64x{len(payload) // 64}:mean={sum(payload) * 1000 // len(payload)}:distinct={len(counts)}:mode={mode}"
        return (doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]) & 0xFFFFFFFF, len(stored), hashlib.sha256(stored).hexdigest(), feature)

    assert collections.Counter(tuple(r) for r in rows) == collections.Counter(plain(r.doc_id, r.text) for r in odd.collect())
    media.write_archives(none, f"file://{tmp_path}/b")
    assert media.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_media_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    media.write_archives(make(spark, [(1, "hello")]), folder)
    path = next(p for p in os.listdir(tmp_path / "c") if p.endswith(".zip"))
    data = bytearray((tmp_path / "c" / path).read_bytes())
    data[60] ^= 255
    (tmp_path / "c" / path).write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder).collect()


def test_media_members_are_retried_alone(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/d"
    media.write_archives(make(spark, [(1, "hello"), (2, "there")]).coalesce(1), folder)
    reader = media.ArchiveReader({"path": folder})
    monkeypatch.setattr(media, "_block", lambda *a: b"")
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["doc_id"] for r in rows] == [1, 2] and all(media.decode_png(r["media"]) for r in rows)


# tokens

def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(TOKENIZER), bpe.Codec(open(TOKENIZER, encoding="utf-8").read())
    rng = random.Random(2)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 900, " " * 500, "a  b   c \n d", "don't we'll", "\n \n\n x", "é" * 99, "=-" * 300, "a  b", "\x00\x01"]
    texts += ["".join(rng.choice("abcdehinorst THE  \n\t'1234.,é漢🙂ß") for _ in range(rng.randrange(80))) for _ in range(1500)]
    for t in texts:
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids
        assert mine.decode(ids).decode("utf-8", "replace") == theirs.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_bpe_queries(spark, odd, none):
    spec = bpe.load_vocabulary(spark, TOKENIZER)
    rows = {r.doc_id: r for r in bpe.digests(odd, spec).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[7].decoded_sha256 == hashlib.sha256("漢字 🙂 é".encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd, spec), spec).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.collect()}
    assert bpe.digests(none, spec).count() == 0


# near duplicates

def brute_components(rows, size, percent):
    table = str.maketrans(ngram_join.UPPER, ngram_join.LOWER)
    sets = {}
    for doc, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if x]
        sets[doc] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize(("size", "percent", "frequent"), [(3, 90, 32), (5, 80, 4), (3, 90, 2)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = random.Random(size * percent + frequent)
    words = [f"w{k}" for k in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.choice([2, 8, 30, 60, 90]))] for _ in range(12)]
    texts = []
    for _ in range(110):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(["A", "new", "B", "w1"])
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t"), (903, "A"), (904, "a")]
    docs = make(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, size=size, percent=percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_components_of_long_sets_of_frequent_shingles(spark, monkeypatch):
    """Sizes on both sides of powers of two, similarities around the threshold, nothing but frequent shingles."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rng = random.Random(21)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (128, 250, 262, 520)]
    texts = []
    for base in bases:
        for _ in range(24):
            cut = rng.randrange(0, max(1, len(base) // 9))
            t = base[cut:] if rng.random() < 0.5 else base[: len(base) - cut]
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "x"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    for size, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(make(spark, rows), size=size, percent=percent).collect()}
        assert got == brute_components(rows, size, percent)


def test_index_of_frequent_shingles_grows_with_the_length(spark):
    made = []
    for n in (1000, 2000, 4000):
        whole = spark.createDataFrame([(k, n, list(range(n))) for k in range(40)], "node long, n int, `set` array<bigint>")
        made.append(ngram_join._stubborn_index(whole, 90).count())
    assert made[0] < 40 * 5 * 1000 and made[1] < 2.3 * made[0] and made[2] < 2.3 * made[1]


def test_pairs_of_a_family_below_the_threshold(spark, monkeypatch):
    """Documents that each change 3 of the same 200 words: rows written between the steps grow with their number."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    sizes = {}
    real = ngram_join.stored
    for m in (100, 400):
        rows = []
        for doc in range(m):
            t = list(base)
            for k in rng.sample(range(200), 3):
                t[k] = f"c{doc}.{k}"
            rows.append((doc, " ".join(t)))
        counts = sizes[m] = collections.Counter()

        def counted(df, name, counts=counts):
            out = real(df, name)
            counts[name] += out.count()
            return out

        monkeypatch.setattr(ngram_join, "stored", counted)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(make(spark, rows)).collect()}
        if m == 100:
            assert got == brute_components(rows, 3, 90)
    for name in ("index", "tried", "open", "rest"):
        assert sizes[400][name] <= 6 * max(sizes[100][name], 100), (name, sizes)


def test_pairs_that_share_many_keys_leave_the_join_at_few(spark, monkeypatch):
    """Long documents with a tenth of the same 1,500 words changed: their sketches allow links, and each two share many keys."""
    rng = random.Random(8)
    rows = []
    for doc in range(14):
        t = [f"b{k}" for k in range(1500)]
        at = rng.randrange(1350)
        t[at : at + 150] = [f"c{doc}.{k}" for k in range(150)]
        rows.append((doc, " ".join(t)))
    docs, made = make(spark, rows), []
    real = type(docs).distinct

    def counted(df):
        if df.columns == ["a", "b"]:
            made.append((df.count(), real(df).count()))
        return real(df)

    monkeypatch.setattr(type(docs), "distinct", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows, 3, 90)
    (left, pairs), = (x for x in made[1:] if x[0])
    assert pairs > 30 and left <= 3 * pairs, made


@pytest.mark.parametrize("recent", [1, 8])
def test_recent_keys_lose_no_pair(spark, monkeypatch, recent):
    """Any reach at any key, keys that a node has twice, with and without ``before``."""
    rng = random.Random(recent)
    n = {node: rng.choice([18, 20, 22]) for node in range(40)}
    rows = []
    for node in n:
        for key in rng.choices(range(30), k=12):
            before = rng.choice([None, None, None, [], rng.sample(range(9), 2)])
            rows.append((key, node, n[node], rng.choice([n[node], n[node], 19, 16]), before))
    index = spark.createDataFrame(rows, "key long, node long, n int, reach long, before array<bigint>")
    labels = spark.createDataFrame([(1, 0), (0, 0)], "node long, label long")
    tried = spark.createDataFrame([(2, 3)], "a long, b long")
    parities = spark.createDataFrame([(k, *(0 for _ in range(ngram_join.SKETCH))) for k in n], "node long, " + ", ".join(f"s{k} long" for k in range(ngram_join.SKETCH)))
    want = set()
    for ka, a, na, ra, fa in rows:
        for kb, b, nb, rb, fb in rows:
            need = -(-(na + nb) * 90 // 190)
            if ka == kb and a < b and (a, b) not in {(0, 1), (2, 3)} and min(ra, rb) >= need and min(na, nb) * 100 >= max(na, nb) * 90 and not set(fa or []) & set(fb or []):
                want.add((a, b))
    monkeypatch.setattr(ngram_join, "MANY", 2)
    monkeypatch.setattr(ngram_join, "RECENT", recent)
    assert {(r.a, r.b) for r in ngram_join._rest(index, labels, tried, parities, 90).collect()} == want and want


def test_components_of_one_id_with_several_texts(spark):
    docs = make(spark, [(1, LONG + " a"), (2, LONG + " b"), (2, "short one"), (3, "short one"), (4, LONG + " b")])
    got = collections.defaultdict(set)
    for r in ngram_join.jaccard_components(docs).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    n = len(LONG.split()) - 1
    assert got == {1: {(n, 1)}, 2: {(1, 2)}, 3: {(1, 2)}, 4: {(n, 1)}}


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError, match="settled"):
        components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"), rounds=2)


def test_components_of_odd_rows(odd, none):
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == 10
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.n_copies))
    assert by[1] == {(0, 1, 1)} and by[6] == by[5] == {(2, 5, 3)} and by[None] == {(1, None, 1)} and by[4] == {(1, 4, 1)}
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("split", [0, 500_000])
def test_connected_components_of_chains_and_stars(spark, monkeypatch, split):
    monkeypatch.setattr(components, "SPLIT", split)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)}


# licenses

def test_licenses_equal_all_windows(spark, odd, none):
    bands = licenses.Bands()
    filler = "lorem ipsum dolor sit amet " * 4
    texts = [filler + t + " " + filler for _, _, t in licenses.TEMPLATES] + [filler, "Licensed under the Apache License, Version 3.1.", "licensed UNDER the apache license version 2.0", "the license of the general public is licensed", "Released under the MIT"]
    docs = make(spark, list(enumerate(texts)))
    got = {(r.doc_id, r.family): (r.license, r.containment, r.place) for r in licenses.scan(docs).collect()}

    def shingles(run):
        return {tuple(run[k : k + 2]) for k in range(len(run) - 1)} if len(run) >= 2 else {tuple(run)}

    want = {}
    for doc, text in enumerate(texts):
        run = licenses.template_words(text)
        for name, family, template in licenses.TEMPLATES:
            wanted = licenses.template_words(template)
            n, stride, size = len(wanted), max(1, len(wanted) // bands.stride), len(shingles(wanted))
            for k in range(0, len(run), stride):
                matched = len(shingles(wanted) & shingles(run[max(0, k - stride) : k + n + stride]))
                if matched >= bands.contained * size:
                    found = (-matched, -round(matched / size, 6), k, name)
                    want[doc, family] = min(want.get((doc, family), found), found)
    assert {key: license for key, (license, _, _) in got.items()} == {key: x[3] for key, x in want.items()}
    assert all(got[key][1] == -want[key][1] for key in want)
    named = {(k, family): name for k, (name, family, _) in enumerate(licenses.TEMPLATES)}
    assert all(got[key][0] == name or licenses.TEMPLATES[key[0]][2] == licenses.NOTICES[21][2] for key, name in named.items())
    assert bands.miss() < 1e-5
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_licenses_in_comments_and_long_texts(spark):
    full = {name: text for name, _, text in licenses.TEMPLATES if len(text) > 700}
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    texts = [wrap(t, mark) for t in full.values() for mark in ("# ", " * ", "// ", "-- ")]
    texts.append("int main() { return 0; }\n" * 20_000 + wrap(full["MIT"], "/// ") + "\nx = 1" * 20_000)
    texts.append(full["BSD-3-Clause"].replace("copyright holder", "regents of the university"))
    texts.append("MIT or BSD, as you like, without warranty")
    got = collections.defaultdict(set)
    for r in licenses.scan(make(spark, list(enumerate(texts)))).collect():
        got[r.doc_id].add(r.license)
    for k, name in enumerate(n for n in full for _ in range(4)):
        assert got[k] == {name}, (k, name, got[k])
    assert got[4 * len(full)] == {"MIT"} and got[4 * len(full) + 1] == {"BSD-3-Clause"} and not got[4 * len(full) + 2]


# personal data

def brute_spans(text):
    out = []
    forms = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, form in enumerate(forms):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 14 <= len(d) <= 19 and luhn or kind == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_regex(spark, odd, none):
    rng = random.Random(8)
    texts = ["a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (017) 555-7713.", "1.2.3.4.5.6.7.8 999.1.1.1 000.0255.1.1", "🙂 a@b.co +12345678901", "@" * 50, "9" * 3000, "1 " * 3000]
    texts += ["".join(rng.choice("01234567890123 -+().@a_é🙂") for _ in range(rng.randrange(80))) for _ in range(1500)]
    rows = pii.find_personal_data(make(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(x) for x in r.base] == brute_spans(texts[r.doc_id])
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.found}
    assert len(pii.digests(pii.find_personal_data(odd)).collect()) == 10 and pii.find_personal_data(none).count() == 0


def seen_of(spark, text):
    frame = spark.createDataFrame([(text,)], "body string").withColumn("marked", pii.seeds(F.col("body")))
    return pii.candidates(frame).first().seen


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"our host: 10.0.{k}.7 is up" for k in range(40)] + ["our host: 10.0.399.7 is up", "we saw 10.0.399.8 there"]
    rows = {r.doc_id: [tuple(x) for x in r.found] for r in pii.find_personal_data(make(spark, list(enumerate(texts)))).collect()}
    assert rows[40] == [(10, 5, 20)] and rows[41] == [] and all(len(rows[k]) == 1 for k in range(40))


def test_contexts_of_all_kinds_find_unseen_identifiers(spark):
    texts = [f"please phone +1 (0{k}) 555-77{k} today" for k in range(10, 40)] + [f"my mail user.{k}@mail7.example.com works" for k in range(30)]
    texts += [f"the ids: 10.0.{k}.7 or so" for k in range(30)] + [f"call {k}: 3{k}5 555" for k in range(30)]
    n = len(texts)
    texts += ["please phone +1 (017) 555-77 today", "the ids: 10.0.399.7 10.0.398.7", "the ids: 1.2.3.999"]
    rows = {r.doc_id: [tuple(x) for x in r.found] for r in pii.find_personal_data(make(spark, list(enumerate(texts)))).collect()}
    assert rows[n] == [(13, 7, 28)] and rows[n + 1] == [(9, 5, 19), (20, 5, 30)] and rows[n + 2] == [(9, 5, 18)]
    assert all(len(rows[k]) == (k < 90) for k in range(n))
    kinds = seen_of(spark, "mail user.3@mail.example.com and phone +1 (017) 555-7713")
    assert [(c.start, c.end) for c in kinds ] == [(5, 28), (39, 56)] and [c.kind for c in kinds] == [0, 3]


def test_contexts_after_an_identifier_and_mails_without_digits(spark):
    texts = [f"{a}{k} wrote to me ann.{a}@host.example.org yesterday" for k, a in enumerate("bcdefghijklmnopqrstuvw")] + ["nobody wrote to eve@host", "x eve@host.local. yesterday", "the eve@host works"]
    rows = {r.doc_id: [tuple(x) for x in r.found] for r in pii.find_personal_data(make(spark, list(enumerate(texts)))).collect()}
    assert rows[22] == [] and rows[24] == [] and all(len(rows[k]) == 1 for k in range(22))
    odd = "user@mail and user@mail.org 5 or 10.0.0.1x10.0.0.2 @ 7"
    got = seen_of(spark, odd)
    want = [(s, e) for s, _, e in brute_spans(odd)]
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", odd) if re.search("[0-9@]", m[0])]
    assert [(c.start, c.end) for c in got if c.kind is not None] == want
    assert [(c.start, c.end) for c in got if c.kind is None] == [(0, 9), (28, 29), (53, 54)] and all(any(a <= s and e <= b for a, b in words) for s, e in want)


def test_spans_apart_equal_pairwise_comparison(spark):
    rng = random.Random(9)

    def spans(n):
        cuts = sorted(rng.sample(range(400), 2 * n))
        return list(zip(cuts[::2], cuts[1::2]))

    cases = []
    for _ in range(40):
        marked = sorted(spans(rng.randrange(12)) + spans(rng.randrange(4)))
        cases.append((spans(rng.randrange(30)), marked))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k int, a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    for r in df.select("k", pii._apart(F.col("a"), F.col("b")).alias("x")).collect():
        a, b = cases[r.k]
        assert [tuple(x) for x in r.x] == [x for x in a if not any(s < x[1] and e > x[0] for s, e in b)]


def test_patterns_equal_a_plain_loop(spark):
    rng = random.Random(12)
    edges = {(rng.randrange(40), rng.randrange(300)): None for _ in range(1500)}
    kinds = {i: rng.randrange(4) for i in range(300) if rng.random() < 0.85}
    rows = [(p, i, kinds.get(i)) for p, i in edges]
    by_pattern = collections.defaultdict(list)
    for p, i, _ in rows:
        by_pattern[p].append(i)
    for rounds in (1, 2, 4):
        weight = {i: float(i in kinds) for i in range(300)}
        for k in range(rounds):
            kept = {}
            for p, members in by_pattern.items():
                support = sum(weight[i] for i in members)
                if support >= pii.SUPPORT and support / (len(members) + 1) >= pii.CONFIDENCE:
                    votes = [sum(kinds.get(i) == n for i in members) for n in range(4)]
                    kept[p] = (support / (len(members) + 1), votes.index(max(votes)))
            for i in weight:
                wrong = np.prod([1 - min(kept[p][0], 0.99) for p in kept if (p, i) in edges] or [1.0])
                weight[i] = max(float(i in kinds), 1 - wrong)
        got = {r.pattern: (r.confidence, r.kind) for r in pii.confident_patterns(spark.createDataFrame(rows, "pattern long, instance long, kind int"), rounds).collect()}
        assert set(got) == set(kept) and (0 < len(kept) < 40 if rounds == 1 else kept)
        assert all(got[p][1] == kept[p][1] and got[p][0] == pytest.approx(kept[p][0]) for p in kept)


def test_personal_data_of_a_long_text_in_time(spark):
    """A text of 2 MB with a numbered word every few characters and many seeds; work that grows with its square would not end."""
    import time

    text = " ".join(f"word{k} at 10.0.{k % 250}.{k % 200} or" if k % 3 == 0 else f"x{k} some words" for k in range(100_000))
    began = time.time()
    (row,) = pii.find_personal_data(make(spark, [(1, text)])).select(F.size("base").alias("n"), F.slice("base", 1000, 1).alias("b")).collect()
    spans = brute_spans(text)
    assert row.n == len(spans) and tuple(row.b[0]) == spans[999] and time.time() - began < 90


# pages

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
<article><h1>Head &amp; tail</h1><p><b>One   two<br><p>Three &lt;b&gt;</p><p>4</p><aside>side words</aside><form>Name<input></form><div class="comments"><article class="comment">so true</article></div><p>End</p></article><footer>&copy; z</footer></body></html>"""


def test_main_text_of_pages(spark, none):
    assert html_text.main_text(PAGE) == "Head & tail\nOne two\nThree <b>\n4\nEnd"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> </p><script>x") == ""
    assert html_text.main_text("plain") == "plain"
    assert html_text.main_text("<div class=menu><a href=x>Home</a></div><div><h2>Title</h2><p>" + "long words " * 30 + "</p><p>Short.</p></div><div id=footer>c</div>").startswith("Title\nlong words")
    assert html_text.main_text("<p>" + "<" * 20000 + "</p>") == "<" * 20000
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c")], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, r.n_chars) for r in html_text.extract(pages).collect())
    assert rows == [(1, 35), (1, 35), (2, 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_main_text_of_uneven_pages():
    usual = ["ordinary words " * 13 + str(k) for k in range(40)]
    page = "<p>" + "</p><p>".join(["very long " * 3000, *usual, "so long " * 4000, *usual]) + "</p>"
    assert html_text.main_text(page).split("\n")[1:41] == usual and html_text.main_text(page).split("\n")[42:] == usual
    text = f"<p>{usual[0]}</p><p><a href=x>all of it a link</a></p><p>{usual[1]}</p>"
    want = f"{usual[0]}\nall of it a link\n{usual[1]}"
    assert html_text.main_text(text + "<p><a href=y>next page</a></p>") == want
    assert html_text.main_text(f"<div class='page with-sidebar'>{text}<div class='sidebar left'><p>{usual[2]}</p></div></div>") == want


def test_main_text_beside_an_article():
    usual = ["ordinary words " * 13 + str(k) for k in range(5)]
    body = "<div><p>" + "</p><p>".join(usual) + "</p></div>"
    assert html_text.main_text(f"{body}<article><p>A teaser.</p></article>") == "\n".join([*usual, "A teaser."])
    assert html_text.main_text(f"<div>Skip</div><article>{body}<p><a href=x>linked</a></p><p>4</p></article><div>Top</div>") == "\n".join([*usual, "linked", "4"])


def plain_line_blocks(page, window=html_text.WINDOW):
    """Line blocks by definition: every window's sum is worked out anew, every line asks whether it lies in a kept stretch."""
    found = [x for x in html_text.lines(page) if x[2] >= 0]
    weight = [min(w, 200) + 30 * p for _, w, p in found]

    def total(k):
        out = 0
        for j in range(k, min(k + window, len(found))):
            if any(found[i][2] != found[k][2] for i in range(k, j + 1)):
                break
            out += weight[j]
        return out

    sums = [total(k) for k in range(len(found))]
    floor = [0.15 * min(max([s for s, f in zip(sums, found) if f[2] >= p], default=0), 200 * window) for p in (0, 1)]
    heavy = [s > floor[f[2]] for s, f in zip(sums, found)]
    out, k = [], 0
    while k < len(found):
        if heavy[k] and weight[k]:
            stretch = [k]
            while stretch[-1] + 1 < len(found) and found[stretch[-1] + 1][2] == found[k][2] and any(heavy[j] for j in range(max(k, stretch[-1] + 2 - window), stretch[-1] + 2)):
                stretch.append(stretch[-1] + 1)
            # a dive ends the stretch: what follows is a new one
            first_dive = next((j for j in stretch if not heavy[j]), None)
            if first_dive is not None:
                stretch = [j for j in stretch if j < first_dive + window - 1]
            k = stretch[-1] + 1
            while not weight[stretch[-1]]:
                stretch.pop()
            out += [found[j][0] for j in stretch]
        else:
            k += 1
    return "\n".join(out)


def random_page(rng):
    def block(depth=0):
        kind = rng.random()
        if kind < 0.35:
            return f"<p>{'word ' * rng.choice([1, 1, 3, 8, 60])}</p>"
        if kind < 0.5:
            return f"<p><a href=x>{'link ' * rng.choice([1, 4])}</a></p>"
        if kind < 0.6:
            return "<br>short<div>x</div>"
        if kind < 0.7:
            return "<div class='ad'>Buy it</div>" + f"<p class='notice'>{'n ' * 5}</p>"
        name = rng.choice(["div", "article", "main", "section", "aside", "ul"])
        return f"<{name}>" + "".join(block(depth + 1) for _ in range(rng.randrange(4) if depth < 3 else 0)) + f"</{name}>"

    return "".join(block() for _ in range(rng.randrange(12)))


def test_main_text_equals_plain_line_blocks(spark):
    rng = random.Random(14)
    pages = [random_page(rng) for _ in range(1500)]
    if os.path.exists("/root/testdata/sf0.001/pages.parquet"):
        pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    other = 0
    for page in pages:
        assert html_text.main_text(page) == plain_line_blocks(page or ""), page
        other += html_text.main_text(page) != plain_line_blocks(page or "", 1)
    assert other > 30  # the window decides


def test_main_text_keeps_what_an_article_holds():
    assert html_text.main_text("<article><p>One line here.</p><p><a>A paragraph that is one link.</a></p><p>Last.</p></article>") == "One line here.\nA paragraph that is one link.\nLast."
    assert html_text.main_text("<article><div class='header'><h1>Title</h1></div><p>text</p><p class='notice'>Mind this</p>" + "<p>4</p>" * 50 + "</article><p>" + "x" * 300) .startswith("Title\ntext\nMind this\n4\n4")
    assert html_text.main_text("<article><p title='a > b'>in</p><p>two</article><!-- never closed <p>gone</p>") == "in\ntwo"


def test_main_text_of_broken_pages_in_time():
    import time

    began = time.time()
    for part, n in (("<div class='", 100_000), ("<p title=\"x>", 100_000), ("<a>", 300_000), ("<!--", 200_000), ("<script>", 50_000), ("<", 500_000), ("<tr><td>1</td></tr>", 50_000), ("&", 200_000)):
        html_text.main_text("<p>text</p>" + part * n)
        html_text.main_text("<p>text</p>" + part * n + ">")
    assert time.time() - began < 20


# languages

def test_language_held_out_accuracy(spark, odd, none):
    lex = {"en": ["the", "house", "water", "thing", "which"], "de": ["der", "haus", "wasser", "dinge", "welche"], "fr": ["la", "maison", "eau", "chose", "laquelle"]}
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(lex[lang]) + rng.choice(["", "s", "x"]) for _ in range(rng.randrange(3, 40))), lang, "s", 1) for k in range(600) for lang in [rng.choice(sorted(lex))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs, language.Training(documents=200, steps=30))
    out = language.identify(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)
    mixed = spark.createDataFrame([(1, "the house water which thing der haus", "en", "s", 1)], SCHEMA)
    assert language.identify(mixed, model).first().lang_pred == "en"
    strange = language.identify(odd, model).collect()
    assert len(strange) == 10 and {r.doc_id for r in strange if r.lang_pred == "und"} == {1, 2, 3, 8}
    assert language.identify(none, model).count() == 0 and language.train(none) is None
    assert language.identify(odd, None).first().lang_pred == "und"
    assert language.annotate(odd, model).columns.count("lang_pred") == 1


def test_language_of_text_without_spaces():
    rng = random.Random(2)
    make_word = {"aa": lambda: "".join(rng.choice("abcd") for _ in range(6)), "zz": lambda: "".join(rng.choice("wxyz") for _ in range(6))}
    texts = [(" ".join(make_word[lang]() for _ in range(30)), lang) for _ in range(40) for lang in make_word]
    model = language.fit([t for t, _ in texts], [lang for _, lang in texts], language.Training(steps=30))
    ends, middle = "".join(make_word["aa"]() for _ in range(7)), "".join(make_word["zz"]() for _ in range(60))
    (found, score), = language.label_texts(model, [ends + middle + ends])
    assert found == "zz" and 0.6 < score < 0.95
    assert language.chunks("ab" + "1" * 100 + "cd") == ["ab", "cd"] and "".join(language.chunks("é" * 95)) == "é" * 95


def test_segments_equal_one_pass():
    rng = np.random.default_rng(2)
    table, transitions = rng.normal(size=(50, 3)).astype(np.float32) * 3, rng.normal(size=(3, 3)).astype(np.float32)
    rows = rng.integers(1, 50, 1000)
    want = language.posteriors(table[rows][:, None], np.array([1000]), transitions).sum(0)[0] / 1000
    for segment in (1, 7, 333, 1000, 5000):
        assert np.allclose(language.segmented_means(table, rows, transitions, segment), want, atol=1e-5)


def test_features_are_those_of_each_word_alone():
    words = ["a", "ab", "straße", "x" * 40, "漢字", "ab"]
    rows, owner = language.features(words, 20)
    alone = [sorted(language.features([w], 20)[0].tolist()) for w in words]
    assert [sorted(rows[owner == k].tolist()) for k in range(len(words))] == alone and alone[1] == alone[5]
    assert [len(x) for x in alone] == [1 + 2 * min(4, len(w)) + (len(w) + 1) + len(w) for w in words]


def test_language_of_a_very_long_text(spark, monkeypatch):
    model = language.fit(["the house of water " * 20, "der haus von wasser " * 20], ["en", "de"], language.Training(steps=20))
    long = "the house of water " * 20_000 + "der haus von wasser " * 9_000
    whole = language.label_texts(model, [long])
    monkeypatch.setattr(language, "SEGMENT", 1000)
    monkeypatch.setattr(language, "PIECE", 777)
    cut = language.label_texts(model, [long, None, "der"])
    assert cut[0][0] == whole[0][0] == "en" and cut[0][1] == pytest.approx(whole[0][1], abs=1e-5) and cut[1] == ("und", 0.0) and cut[2][0] == "de"


def test_spans_are_bounded(spark):
    docs = make(spark, [(k, "word " * 5000 + "x" * 100_000) for k in range(4)] + [(9, "one two three")])
    rows = docs.select("doc_id", language._spans(language.Training()).alias("s")).collect()
    assert all(len(r.s) <= 8 and max(map(len, r.s)) <= 4096 for r in rows) and rows[4].s == ["one two three"]


def test_posteriors_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    emissions, transitions = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    emissions[2:, 1] = 0
    got = language.posteriors(emissions, lengths, transitions)
    for b, n in enumerate(lengths):
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(emissions[t, b, s] for t, s in enumerate(path)) + sum(transitions[a, c] for a, c in zip(path, path[1:])))
            for t, s in enumerate(path):
                total[t, s] += w
        assert np.allclose(got[:n, b], total / total.sum(1, keepdims=True)) and not got[n:, b].any()


# lines

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def test_line_dedup_keeps_the_first(spark, odd, none):
    docs = make(spark, [(1, f"a\n{LONG}\nb"), (2, f"x\n{LONG}\ny"), (3, f"{LONG}\n{LONG} again\nz"), (4, "a\nb"), (5, "only")])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"a\n{LONG}\nb", 2: "x\ny", 3: f"{LONG} again\nz", 4: "a\nb", 5: "only"}
    strange = line_dedup.dedup_lines(odd, min_words=3)
    assert strange.count() == 10 and {r.text for r in strange.where("doc_id = 6").collect()} == {""}
    assert {r.text for r in strange.where("doc_id = 5").collect()} == {"same text here today"}
    assert line_dedup.dedup_lines(none).count() == 0


def test_frequent_lines_leave_all_later_documents(spark):
    docs = make(spark, [(k, f"own {k}\n{LONG}") for k in range(60)])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: f"own 0\n{LONG}"} | {k: f"own {k}" for k in range(1, 60)}


def test_patience_takes_the_longest_common_order():
    left = list(enumerate([1, 2, 3, 9, 9, 4, 5]))
    assert line_dedup.patience(left, list(enumerate([4, 1, 2, 3, 9, 5]))) == [(0, 1), (1, 2), (2, 3), (3, 4), (6, 5)]
    assert line_dedup.patience([], left) == []


def test_blocks_of_frequent_lines_find_their_holder(spark):
    """Two short lines in many documents, together in two only; neither line's first holder holds the block."""
    a, b = LONG[:41], LONG[42:]
    docs = make(spark, [(k, f"{a if k < 20 else b}\nown {k}") for k in range(40)] + [(k, f"x{k}\n{a}\n{b}\ny{k}") for k in (40, 41)])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).where("doc_id >= 39").collect()}
    assert got == {39: f"{b}\nown 39", 40: f"x40\n{a}\n{b}\ny40", 41: "x41\ny41"}


def test_line_dedup_equals_all_pairs(spark):
    """Blocks whose lines have other first holders, repeated lines, swapped passages: against every earlier document."""
    rng = random.Random(11)
    texts = ["\n".join("\n" * (rng.random() < 0.1) + f"w{rng.randrange(9)} " * rng.choice([2, 5, 5, 9, 20]) for _ in range(rng.randrange(14))) for _ in range(150)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(spark, list(enumerate(texts)))).collect()}
    full = [[(k, x.strip()) for k, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    seen = set()
    for doc, rows in enumerate(full):
        spans = [(a, b) for a in range(len(rows)) for b in range(a, len(rows)) if sum(len(x.split()) for _, x in rows[a : b + 1]) >= 20]
        gone = {rows[k][0] for a, b in spans if tuple(x for _, x in rows[a : b + 1]) in seen for k in range(a, b + 1)}
        assert got[doc] == "\n".join(x for k, x in enumerate(texts[doc].split("\n")) if k not in gone), doc
        seen |= {tuple(x for _, x in rows[a : b + 1]) for a, b in spans}
    assert sum(len(got[k]) for k in got) < 0.9 * sum(map(len, texts))


def test_line_dedup_of_repeated_and_double_spaced_passages(spark):
    short = [f"{a} one two three four five six" for a in "abcdef"]
    passage = "\n".join(short)
    docs = make(spark, [(1, f"{passage}\nmiddle\n{passage}"), (2, f"own\n{passage}\nend"), (3, f"{passage}\n\nthree\n{passage}"), (4, "\r\n \t\n".join(short)), (5, "\n\n".join(short) + "\nfive")])
    got = {r.doc_id: r.text.split() for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"{passage} middle {passage}".split(), 2: ["own", "end"], 3: ["three"], 4: [], 5: ["five"]}


def test_line_dedup_of_long_texts_and_repeated_ids(spark):
    """A document of 30,000 short lines twice, one of them with the halves swapped; two texts of one id."""
    many = [f"line {k} of it" for k in range(30_000)]
    swapped = many[15_000:] + many[:15_000]
    docs = make(spark, [(1, "\n".join(many)), (2, "\n".join(["new", *swapped])), (3, f"{LONG}\na"), (4, f"{LONG}\nb"), (4, f"c\n{LONG}\nd"), (4, "other")])
    got = collections.defaultdict(set)
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id].add(r.text)
    assert got[2] == {"new"} and got[1] == {"\n".join(many)} and got[4] == {"b", "c\nd", "other"} and got[3] == {f"{LONG}\na"}


def test_line_dedup_of_lines_in_twenty_other_documents(spark):
    """A block of three lines, each of which also stands in 20 other documents without the others."""
    block = [LONG[:24], LONG[25:70], LONG[71:]]
    rows = [(3 * k + j, f"{line}\nown {k}") for k in range(20) for j, line in enumerate(block)] + [(k, "\n".join([f"x{k}", *block])) for k in (100, 101)]
    got = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(make(spark, rows)).where("doc_id >= 100").collect()}
    assert got == {100: 0, 101: 3}


# neighbours

def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    rows = [(k, [float(v) for v in x[k]]) for k in range(900)] + [(1000 + k, [float(v) for v in x[0]]) for k in range(60)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15), (2080, [None] + [1.0] * 15), (2100, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("clash"))
    settings = neighbours.Settings(books=7, words=32, sample=600, list_size=64, iterations=3)
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20, settings).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    usable = {k: np.array(v) for k, v in rows[:960]}
    ids = np.array(sorted(usable))
    matrix = np.stack([usable[k] for k in ids])
    hits = total = 0
    for q in (k for k in usable if k % 20 == 0):
        scores = matrix @ usable[q]
        order = [k for k in np.lexsort((ids, -np.round(scores, 9))) if ids[k] != q][:20]
        assert len(got[q]) == 20 and q not in dict(got[q])
        hits += len({int(ids[k]) for k in order} & set(dict(got[q])))
        total += 20
        for k, s in got[q]:
            assert s == pytest.approx(float(usable[k] @ usable[q]), rel=1e-12)
    assert set(got) == {k for k in usable if k % 20 == 0} and hits >= 0.9 * total
    assert neighbours.nearest(vectors.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors.where("vec_id in (2000, 2020)"), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """A vec_id with two vectors: each is a candidate with its own score, and 9 has its own, not that of an equal id."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    rows = [(k, x[k].tolist()) for k in range(300)] + [(5, x[9].tolist()), (40, x[41].tolist()), (40, x[40].tolist())]
    settings = neighbours.Settings(books=6, words=32, sample=300, list_size=32, iterations=3, list_recall=1.0, rerank=300)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, settings).collect()
    vectors = collections.defaultdict(list)
    for k, v in rows:
        if v not in vectors[k]:
            vectors[k].append(v)
    lists = collections.defaultdict(list)
    for r in got:
        assert any(r.score == pytest.approx(float(np.dot(a, b)), rel=1e-12) for a in vectors[r.query_id] for b in vectors[r.vec_id]) and r.query_id != r.vec_id
        lists[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 300, 20):
        want = [sorted(((-float(np.dot(v, w)), k) for k in vectors for w in vectors[k] if k != q))[:20] for v in vectors[q]]
        assert sorted((rank, round(s, 9)) for rank, _, s in lists[q]) == sorted((rank, round(-s, 9)) for w in want for rank, (s, _) in enumerate(w, 1))
    assert len(lists[40]) == 40


def test_neighbours_recall_with_the_querys_settings(spark):
    """The small table's vectors, the settings that the query runs with, all queries against brute force."""
    if not os.path.exists("/root/testdata/sf0.01/embeddings.parquet"):
        pytest.skip("no tables here")
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.select("vec_id", "embedding").collect() if r.embedding]
    rows = [(k, v) for k, v in rows if np.isfinite(v).all() and v.any()]
    ids, matrix = np.array([k for k, _ in rows]), np.stack([v for _, v in rows])
    got = collections.defaultdict(set)
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q, v in rows:
        if q % 20 == 0:
            order = [int(ids[k]) for k in np.argsort(-(matrix @ v)) if ids[k] != q][:20]
            hits, total = hits + len(set(order) & got[q]), total + len(order)
    assert total and hits >= 0.9 * total


# pipeline

def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice("the of and to in that water stone river light green over under".split()) + rng.choice(["", "ly", "s"]) for _ in range(n))
    base = prose(60)
    rows = [(k, prose(40), "en", f"s{k % 3}", 1) for k in range(40)] + [(100, base, "en", "s0", 1), (101, base + " tail", "en", "s1", 1), (102, "12345 !!", "en", "s1", 1), (103, None, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = p.language_stage(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {102, 103} and tuple(kept.columns) == p.COLUMNS
    lined = p.line_stage(spark, kept, "")
    assert tuple(lined.columns) == p.COLUMNS and lined.count() == 42
    single = p.near_duplicate_stage(spark, lined, "")
    want = brute_components([(r.doc_id, r.text) for r in lined.collect()], p.SHINGLE, p.PERCENT)
    assert {r.doc_id for r in single.collect()} == {c for _, c in want.values()} and 101 not in {r.doc_id for r in single.collect()}
    mixed = p.mixing_stage(spark, single, "")
    assert tuple(mixed.columns) == p.COLUMNS
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    codec, kept = bpe.Codec(open(TOKENIZER, encoding="utf-8").read()), {r.doc_id: r.text for r in single.collect()}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert collections.Counter(r.doc_id for r in out) == copies and set(copies) <= set(kept)
    for r in out:
        ids = codec.encode(kept[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(kept[r.doc_id].encode()).hexdigest())


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline as p

    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = p.run(spark, f"{tmp_path}/odd")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} <= {4, 5, None, 7}
    assert sorted(r.doc_id or 0 for r in p.near_duplicate_stage(spark, odd, "").collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_workers_get_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    plain = type(spark.range(0)).mapInArrow

    def counted(self, run, schema, *rest):
        def noted(batches):
            for batch in run(recorded(batches)):
                yield batch

        def recorded(batches):
            for batch in batches:
                with open(f"{tmp_path}/rows", "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        return plain(self, noted, schema, *rest)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["water", "stone", "river", "light", "green"]) + str(rng.randrange(50)) for _ in range(12)), "en", "s0", 1) for k in range(2600)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == len(rows)
    seen = [int(x) for x in open(f"{tmp_path}/rows")]
    assert sum(seen) >= 4 * len(rows) and max(seen) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_confident_texts_equal_annotated_ones(spark, odd, monkeypatch):
    rng = random.Random(9)
    tongues = {"en": "the of and water stone".split(), "de": "der und wasser nicht stein".split()}
    rows = [(k, " ".join(rng.choice(tongues[x]) for _ in range(20)), x, "s", 1) for k in range(120) for x in [rng.choice(["en", "de"])]]
    rows += [(200 + k, " ".join(rng.choice(tongues["en"] + tongues["de"]) for _ in range(9)), "en", "s", 1) for k in range(40)] + [(300, "12 !!", "en", "s", 1), (301, None, None, "s", 1)]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA)
    model = language.train(docs)
    for bound in (500_000, 0):
        monkeypatch.setattr(language, "BROADCAST_TEXTS", bound)
        for table in (docs, odd):
            for least in (0.5, 0.9):
                want = language.annotate(table, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= least)).select("doc_id", "text")
                got = language.confident(table, model, least)
                assert got.columns == table.columns and collections.Counter(got.select("doc_id", "text").collect()) == collections.Counter(want.collect())
    assert 0 < language.confident(docs, model, 0.9).count() < language.confident(docs, model, 0.5).count() < docs.count()
    assert language.confident(docs, None, 0.5).isEmpty()
