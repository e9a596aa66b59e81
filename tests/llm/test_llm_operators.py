"""Each operator against a brute-force version on a small fixture: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from riskweave.llm import _text, ann, bpe, langid, licenses, lm, mixing, neardup, pii, topk, urls

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, near string, word string, label string"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix potent brews near old stone bridges".split()


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    base = sentence(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    long = sentence(9, 30_000) + " Released under the MIT License."
    texts = [
        base, base, near, sentence(2, 80), None, "", "   \n\t", "é漢字🙂 naïve", "!!!", long,
        "Contact a.b@x.example.com or +1 (555) 123-4567 from 10.0.0.1\nReleased under the MIT License.\ncard 4111 1111 1111 1111",
        "This work is licensed under the GNU General Public License, version 3.", "one two", "one two",
    ]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), "x", "y", "z", "w", "v") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id here at all today", None, "a", 3, "x", "y", "z", "w", "v")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_reference_library_and_round_trips(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN, offsets=True), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows())
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["decoded_text"] == text
        assert r["n_tokens"] == len(r["ids"]) == len(r["starts"])
        assert not r["ids"] or (r["starts"][0] == 0 and r["ends"][-1] == len(text))
    digests = {r["doc_id"]: r for r in bpe.digests(bpe.round_trip(docs, PATH, public_tokenizers.PATTERN)).collect()}
    for i, text, *_ in rows():
        packed = np.array(own.encode_ordinary(text or ""), "<u4").tobytes()
        assert digests[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest() and digests[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_odd_strings():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, model = random.Random(4), bpe.codec(PATH, public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(r.choice(r.choice(["ab ", "a \n", "=-_ ", "01", "\n\t ", "é漢字🙂 ", "*#'s"])) for _ in range(r.randrange(60)))
        assert model.encode(text).tolist() == own.encode_ordinary(text)
    with pytest.raises(ValueError):
        model.decode(np.array([10**6]))


def test_bpe_cuts_where_the_pattern_does(monkeypatch):
    """U+001C to U+001F are white space to Python's re, not to the pattern."""
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    model, r = bpe.codec(PATH, public_tokenizers.PATTERN), random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["!!", "\x1c", "\x1f", "ab", " ", "\n", "7", "\u2003"]) for _ in range(200))
        assert [w for part in bpe._parts(text) for w in model.words(part)] == model.words(text)


def test_bpe_keeps_bounded_bytes_of_words(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 50_000)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 1000)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model, r = bpe.BytePairCodec(PATH, public_tokenizers.PATTERN), random.Random(7)
    for _ in range(20):
        text = " ".join("".join(r.choice("漢字語文天地") for _ in range(400)) for _ in range(20))
        assert model.encode(text).tolist() == own.encode_ordinary(text)
        held = sum(len(w.encode()) + len(x) for w, x in model.kept.items())
        assert held < 100_000 and sum(map(len, model.kept.values())) <= model.held


def test_bpe_null_ids(spark):
    table = spark.createDataFrame([(1, [5, None]), (2, None), (3, []), (4, [5])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(table, PATH, public_tokenizers.PATTERN).collect()}
    assert got[1] is None and got[2] is None and bytes(got[3]) == b"" and len(got[4]) > 0


def test_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, "one `two` three", "x", 7)], "doc_id long, text string, `a``b` string, `c.d` int")
    kept = neardup.deduplicate(table)
    assert kept.columns == table.columns and kept.collect() == table.collect()


def brute_classes(records, similarity=0.8, floor=neardup.FLOOR):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in records:
        w = pattern.findall((text or "").translate(low))
        sets.append(collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    n = sum(map(bool, sets))
    df = collections.Counter(k for s in sets for k in s)
    idf = {k: 1 + math.log((1 + n) / (1 + max(v, floor * n))) for k, v in df.items()}
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = sum(min(sets[i][k], sets[j][k]) * idf[k] for k in sets[i].keys() & sets[j].keys())
                total = sum(v * idf[k] for s in (sets[i], sets[j]) for k, v in s.items())
                if common / (total - common) >= similarity:
                    parent[root(i)] = root(j)
    out = collections.defaultdict(list)
    for i in range(len(sets)):
        out[root(i)].append(i)
    return out


@pytest.mark.parametrize("small", [neardup.SMALL_BUCKET, 1])
def test_near_duplicates_equal_all_pairs(spark, docs, none, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 2 if small == 1 else 256)
    base = sentence(50, 100).split()
    chain = [(200 + i, " ".join(base[: 100 - 4 * i] + sentence(60 + i, 4 * i).split())) for i in range(6)]
    more = spark.createDataFrame(chain, "doc_id long, text string")
    table = docs.select("doc_id", "text").where("doc_id IS NOT NULL").unionByName(more)
    records = [(r[0], r[1]) for r in rows() if r[0] is not None] + chain
    want = {records[i][0]: min(records[k][0] for k in group) for group in brute_classes(records).values() for i in group}
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table).collect()}
    assert got == want
    if small > 1:
        kept = neardup.deduplicate(docs)
        assert kept.columns == docs.columns
        ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
        assert ids == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
        assert neardup.classes(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_near_duplicate_classes_of_repeated_ids(spark):
    """Two classes whose least id is the same have different keys."""
    one, two = sentence(70, 60), sentence(71, 60)
    data = [(1, one), (1, two), (2, one), (3, two), (None, one + " end"), (None, ""), (1, None)]
    got = neardup.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    keys = {}
    for r in got:
        keys.setdefault(r["class_key"], []).append((r["doc_id"], r["class_id"], r["class_size"]))
    assert sorted(len(x) for k, x in keys.items() if k is not None) == [2, 3] and len(keys[None]) == 2
    assert all(size == len(rows) for k, rows in keys.items() if k is not None for _, _, size in rows)
    assert {c for rows in keys.values() for _, c, _ in rows} == {1, None}


def test_consistent_samples_agree_as_often_as_texts_are_similar():
    r = np.random.default_rng(3)
    a = np.sort(r.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:300], r.integers(0, 1 << 63, 100).astype(np.uint64)]))
    w = lambda x: np.ones(len(x), np.float32) * 2
    sampler = neardup.Sampler(2000)
    x, y = (sampler.sign(np.zeros(len(s), np.int64), s, w(s), 1)[0] for s in (a, b))
    assert abs((x == y).mean() - 300 / 500) < 0.05


def test_language_of_held_out_texts(spark, none):
    vocab = {"en": "the and of to in that with", "de": "der die und das nicht ein mit", "fr": "le la les des est une dans", "es": "el los una por que con para"}
    data = []
    for i in range(400):
        lang = list(vocab)[i % 4]
        r = random.Random(i)
        data.append((i, " ".join(r.choice(vocab[lang].split()) for _ in range(40)), lang, "s", "k"))
    data += [(1000, None, "en", "s", "k"), (1001, "12 !?", "en", "s", "k"), (1002, "", None, "s", "k")]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score string")
    got = langid.identify(table).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if r["doc_id"] >= 1000 else r["lang"])
    assert langid.identify(none).count() == 0
    alone = langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in alone] == ["und"]


def test_languages_are_learned_from_rows_without_ids(spark):
    vocab = {"en": "the and of to in that with", "de": "der die und das nicht ein mit"}
    for distinct in (True, False):  # texts apart, and all rows of a language alike
        data = [(None, vocab[lang] + (f" {vocab[lang].split()[i % 7]} {i}" if distinct else ""), lang) for lang in vocab for i in range(400)]
        table = spark.createDataFrame(data, "doc_id long, text string, lang string")
        got = langid.identify(table, folds=7, fold=3, per_language=20).select("lang", "lang_pred", "held_out").collect()
        assert len(got) == 800 and all(r["lang_pred"] == r["lang"] and not r["held_out"] for r in got)


def test_language_equals_a_direct_fit(spark, monkeypatch):
    """Features counted one by one, and a model fitted on them here, predict the same; texts longer than a piece are counted whole."""
    vocab = {"en": "the and of to in that with", "de": "der die und das nicht ein mit", "fr": "le la les des est une dans"}
    r = random.Random(4)
    data = [(i, " ".join(r.choice(vocab[lang].split()) for _ in range(r.randrange(1, 60))), lang) for i in range(120) for lang in [list(vocab)[i % 3]]]
    data.append((500, " ".join(r.choice(vocab["fr"].split()) for _ in range(4000)), "fr"))

    def direct(text):
        x = np.zeros(langid.DIMENSIONS, np.float32)
        body = text.encode()
        for k in langid.ORDERS:
            for a in range(len(body) - k + 1):
                code = np.array([int.from_bytes(body[a : a + k], "big")], np.uint64)
                x[int(_text.mix(code, k)[0] % np.uint64(langid.DIMENSIONS))] += 1
        x = np.log1p(x)
        return x / np.sqrt((x * x).sum())

    table = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(table).collect()}
    xs = {i: direct(t) for i, t, _ in data}
    learned = sorted(((lang, hashlib.md5(f"{len(str(i))}:{i}{t}".encode()).hexdigest(), i) for i, t, lang in data if zlib.crc32(str(i).encode()) % 4 != 2))
    model = langid.Model(np.stack([xs[i].astype(np.float16).astype(np.float32) for _, _, i in learned]), [lang for lang, _, _ in learned])
    names, scores = model.predict(np.stack([xs[i] for i, _, _ in data]))
    for (i, _, _), name, score in zip(data, names, scores):
        assert got[i][0] == name and got[i][1] == pytest.approx(score, abs=1e-3)
    whole = [x for _, _, x in langid.features(pa.array([t for _, t, _ in data]))]
    monkeypatch.setattr(langid, "PIECE_BYTES", 50)
    assert np.allclose(np.concatenate(whole), np.concatenate([x for _, _, x in langid.features(pa.array([t for _, t, _ in data]))]), atol=1e-6)


def plain_svm(x, y):
    """Averaged subgradient steps on the balanced hinge loss, component by component in double precision."""
    x = [[*map(float, row), 1.0] for row in x]
    positive = sum(v > 0 for v in y)
    share = {1: len(y) / 2 / max(1, positive), -1: len(y) / 2 / max(1, len(y) - positive)}
    r, w, total, t = np.random.default_rng(1), [0.0] * len(x[0]), [0.0] * len(x[0]), 0
    for epoch in range(langid.EPOCHS):
        order = r.permutation(len(y))
        for a in range(0, len(y), 32):
            batch, t = order[a : a + 32], t + 1
            rate = 1 / (langid.REGULAR * (t + 100))
            step = [0.0] * len(w)
            for i in batch:
                if y[i] * sum(p * q for p, q in zip(x[i], w)) < 1:
                    step = [s + share[y[i]] * y[i] * p for s, p in zip(step, x[i])]
            w = [(1 - rate * langid.REGULAR) * p + rate / len(batch) * s for p, s in zip(w, step)]
            norm = math.sqrt(sum(p * p for p in w) * langid.REGULAR)
            w = [p / max(1.0, norm) for p in w]
            if epoch >= langid.EPOCHS // 2:
                total = [p + q for p, q in zip(total, w)]
    size = math.sqrt(sum(p * p for p in total))
    return [p / size for p in total]


def test_language_machines_and_votes_equal_plain_ones():
    """Machines, families, votes and scores computed here without the model's code."""
    r, langs = np.random.default_rng(5), ["en", "de", "nl", "fr", "es", "xx"]
    centre = r.normal(size=(len(langs), 12))
    own = [langs[i % len(langs)] for i in range(90)]
    x = np.stack([centre[langs.index(z)] + r.normal(size=12) * 0.6 for z in own]).astype(np.float32)
    model = langid.Model(x, own)
    family = {"en": "g", "de": "g", "nl": "g", "fr": "r", "es": "r", "xx": "x"}
    first = {f: plain_svm(x, [1 if family[z] == f else -1 for z in own]) for f in "grx"}
    pairs = {}
    for a, b in (("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")):
        rows = [i for i, z in enumerate(own) if z in (a, b)]
        pairs[a, b] = plain_svm(x[rows], [1 if own[i] == a else -1 for i in rows])
    def margin(w, v):
        return sum(p * float(q) for p, q in zip(w, v)) + w[-1]

    sizes = [abs(margin(w, v)) for w in [*first.values(), *pairs.values()] for v in x]
    sure = lambda m: 1 / (1 + math.exp(-2 / float(np.median(sizes)) * m))
    names, scores = model.predict(x)
    for v, name, score in zip(x, names, scores):
        best = max(first, key=lambda f: margin(first[f], v))
        votes = {z: (0, 0.0, 1.0) for z in langs if family[z] == best}
        for (a, b), w in pairs.items():
            if a in votes:
                m = margin(w, v)
                for z, s in ((a, m), (b, -m)):
                    n, total, least = votes[z]
                    votes[z] = (n + (s > 0), total + s, min(least, sure(s)))
        want = max(votes, key=lambda z: votes[z][:2])
        assert name == want and score == pytest.approx(sure(margin(first[best], v)) * votes[want][2], rel=1e-3)


def test_no_language_is_left_out_of_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 4)
    data = [(str(i), lang * 5, lang) for i, lang in enumerate(["en"] * 9 + ["de"] * 3 + ["fr"])]
    assert langid.fit(spark.createDataFrame(data, "_key string, text string, lang string")).langs == ["de", "en", "fr"]


def test_long_texts_take_bounded_memory():
    table = _text.WordTable(_text.SPACES)
    run = pa.array(["a" * 50_000_000])
    tracemalloc.start()
    hashes, *_ = table.words(*_text.utf8_parts(run))
    upto = tracemalloc.get_traced_memory()[1]
    for _ in langid.features(pa.array(["ab " * 3_000_000])):
        pass
    after = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 1 and upto < 8 * 50_000_000 and after < 8 * 50_000_000
    swapped = bytearray(b"x" * 4096 + b"y" * 4096)
    other = bytearray(swapped)
    other[7], other[7 + 4096] = other[7 + 4096], other[7]
    one, two = (table.words(np.frombuffer(bytes(x), np.uint8), np.array([0, len(x)]))[0] for x in (swapped, other))
    assert one != two


def test_licenses_keep_all_cases(docs, none):
    got = {r["doc_id"]: r for r in licenses.scan(docs.where("doc_id IS NOT NULL")).collect()}
    assert got[4]["n_words"] == 0 and got[4]["first_word"] is None and got[4]["labels"] == "" and got[4]["score"] == 0
    assert got[9]["base_labels"] == "mit" and got[9]["first_word"] == 30_003
    assert got[11]["base_labels"] == got[11]["labels"] == "gpl" and got[11]["score"] == 1.0
    assert licenses.scan(docs).count() == len(rows()) and licenses.scan(none).count() == 0
    assert "word" in licenses.scan(docs).columns


def test_license_filters_lose_nothing(spark):
    words = sorted({w for _, body in licenses.TEMPLATES for w in licenses._tokens(body)}) + ["x", "y", "z"]
    r = random.Random(5)
    lines = [" ".join(r.sample(licenses._tokens(body), r.randint(1, len(set(licenses._tokens(body))))) + r.sample(words, 3)) for _, body in licenses.TEMPLATES for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))), r["score"]) for r in licenses.scan(table).collect()}
    for i, line in enumerate(lines):
        held = set(licenses._tokens(line))
        found = [(label, len(held & set(t)) / len(set(t))) for label, body in licenses.TEMPLATES for t in [licenses._tokens(body)] if len(held & set(t)) >= math.ceil(0.8 * len(set(t)) - 1e-9)]
        base = {label for p, label in licenses.PHRASES if f" {p} " in " " + " ".join(licenses._tokens(line)) + " "}
        assert got[i] == ({x for x, _ in found} - base, max([s for _, s in found], default=0.0))


def test_licenses_in_wrapped_and_long_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions"
    gap = " ".join(f"w{i}" for i in range(70))
    scattered = f" {gap} ".join("released under mit notlicense license".split())
    inside = [f"{' '.join(['x'] * n)} {licenses.TEMPLATES[4][1]} {gap}" for n in range(60, 130)]
    gpl = licenses.TEMPLATES[10][1].replace(" modify it", "\n# modify it").replace(" the Free", "\n# the Free")
    texts = [mit, bsd, scattered, *inside, gpl]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(table).collect()}
    assert got[0] == ("mit", 1.0) and got[1] == ("bsd", 1.0) and got[2] == ("", 0.0)
    assert all(got[i] == ("bsd", 1.0) for i in range(3, len(texts) - 1)) and got[len(texts) - 1] == ("gpl", 1.0)


def test_mixture_meets_its_targets(docs, none):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows())
    by = collections.defaultdict(list)
    for r in mixed:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1 and rs[0]["target"] <= 2 * rs[0]["source_size"]
    total = sum(rs[0]["source_size"] for rs in by.values())
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6
    again = sorted(map(str, mixing.mix(docs).select("doc_id", "taken", "starts").collect()))
    assert again == sorted(str(r) for r in mixing.mix(docs).select("doc_id", "taken", "starts").collect())
    assert mixing.mix(none).count() == 0
    order = mixing.training_order(mixing.mix(docs), ["doc_id"]).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and all(0 <= r["position"] <= 1 for r in order)


def test_inverted_schedule(spark):
    t = spark.range(0, 11).select((F.col("id") / 10).alias("y"))
    for g in (-1.0, -0.5, 0.0, 0.5, 1.0):
        for r in t.withColumn("t", mixing.inverted(F.col("y"), F.lit(g))).collect():
            assert abs(r["t"] + g * (r["t"] ** 2 - r["t"]) - r["y"]) < 1e-9


@pytest.mark.parametrize("most, chunk, split", [(lm.BROADCAST_BYTES, lm.LOOKUP_BYTES, lm.SPLIT_BITS), (0, 40_000, 2)])
def test_lm_scores(docs, none, most, chunk, split, monkeypatch):
    """Broadcast, and looked up in parts by chunks of documents: both score as brute force with exact counts given the same levels."""
    for name, value in (("BROADCAST_BYTES", most), ("LOOKUP_BYTES", chunk), ("SPLIT_BITS", split)):
        monkeypatch.setattr(lm, name, value)
    got = lm.score(docs).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [([*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\0"], zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, i) for i, t, *_ in rows()]
    ones, twos = collections.Counter(), collections.Counter()
    for t, out, _ in tokens:
        if not out:
            ones.update(t)
            twos.update(zip(["\0", *t[:-1]], t))
    n, v = sum(ones.values()), len(ones)
    want = {}
    for t, out, i in tokens:
        base = sum(math.log10((ones[w] + 1) / (n + v + 1)) for w in t)
        model = 0.0
        for h, w in zip(["\0", *t[:-1]], t):
            c = twos[h, w]
            q = 1 + int(math.log2(c)) if c else 0
            k = (2 ** (q - 1) + 2**q - 1) / 2 if q else 0
            model += math.log10(0.4 * min(1, k / max(1, ones[h])) + 0.6 * (ones[w] + 1) / (n + v + 1))
        want[i] = (out, len(t), sum(ones[w] > 0 for w in t), n, base, model)
    assert len(got) == len(rows())
    for r in got:
        out, size, known, total, base, model = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, size, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(model, rel=0.05)
    assert lm.score(none).count() == 0


def test_lm_counts_of_a_byte_and_more(spark):
    texts = [" ".join(["often"] * 300 + ["some"] * 255 + ["few"] * 254 + ["once"])] * 3
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    trained = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(3))
    n = trained * (300 + 255 + 254 + 1 + 1)
    want = sum(k * math.log10((trained * k + 1) / (n + 6)) for k in (300, 255, 254, 1, 1))
    assert all(r["base_score"] == pytest.approx(want, rel=1e-12) and r["n_known"] == 811 for r in lm.score(table).collect())


def test_lm_query_knows_bigrams_seen_once(spark, tmp_path):
    from riskweave.llm import entry

    texts = ["a b c d", "a c b d", "b a d c", "d c b a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {i: ([*t.split(), "\0"], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(texts)}
    ones, twos = collections.Counter(), collections.Counter()
    for t, out in tokens.values():
        if not out:
            ones.update(t)
            twos.update(zip(["\0", *t[:-1]], t))
    n, v = sum(ones.values()), len(ones)
    middle = {0: 0, 1: 1, 2: 2.5, 3: 2.5}
    for r in entry.op8_lm_scores(spark, str(tmp_path)).collect():
        t = tokens[r["doc_id"]][0]
        want = sum(math.log10(0.4 * min(1, middle[twos[h, w]] / max(1, ones[h])) + 0.6 * (ones[w] + 1) / (n + v + 1)) for h, w in zip(["\0", *t[:-1]], t))
        assert r["score"] == pytest.approx(want, rel=0.05)


def plain_spans(text):
    """Spans by the patterns as they are stated, for texts that are short enough for them."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, ["email", "ip", "card", "phone"][k]) for a, k, b in sorted(out)]


def test_pii_spans_equal_the_stated_patterns(spark):
    r, cards = random.Random(3), ["4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "6011000990139424"]
    texts = ["".join(r.choice(a) for _ in range(r.randrange(40))) for a in ("ab@.%- ", "01.2 -", "+1 ().2-", "a@b.c1+ -2.", "@@a.b", "é1.@+") for _ in range(4000)]
    texts += [" ".join([r.choice(cards), "x", r.choice(["+44 (20) 7946-0958", "10.20.30.256", "me@x.y.z"])]) for _ in range(50)]
    assert all(pii.find(t) == plain_spans(t) for t in texts)
    some = texts[:200] + texts[-50:]
    got = pii.digests(pii.detect(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), support=10**6)).collect()
    for row in got:
        spans = plain_spans(some[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == x for *_, x in spans) for k in ("email", "ip", "card", "phone")]


def test_pii_takes_time_in_proportion_to_long_runs():
    n = 5_000_000
    began = time.process_time()
    for text in ("a" * n + "@", "1" * n + ".", "1." * (n // 2), "a@" * (n // 2), "+1" * (n // 2), "1 " * (n // 2), "+1" + " " * n):
        pii.find(text)
    assert time.process_time() - began < 90


def test_pii_disclosure_equals_a_recount(spark):
    r = random.Random(11)
    people = [f"p{c}@corp.example.com" for c in "abcdef"]
    nouns = "zan bor kel mip tuv rax lod fen".split()
    texts = []
    for i in range(300):
        words = [r.choice(WORDS) for _ in range(12)]
        if i % 3 == 0:
            k = r.randrange(6)
            words[5:6] = [nouns[k], people[k]] + ([nouns[6]] if r.random() < 0.5 else [])
        if r.random() < 0.1:
            words.append(r.choice(nouns))
        texts.append(" ".join(words))
    got = {x["term"]: x["disclosure"] for x in pii.revealing(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    # contexts and documents counted over again
    n, docs_of, total = collections.Counter(), collections.Counter(), 0
    near, beside, within, holding = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        tokens = t.split()
        plain = [w for w in tokens if "@" not in w]
        n.update(plain)
        n.update(x for w in tokens if "@" in w for x in re.findall("[a-z]{2,}", w))
        docs_of.update(set(plain) | {x for w in tokens if "@" in w for x in re.findall("[a-z]{2,}", w)})
        for i, w in enumerate(tokens):
            if "@" in w:
                around = tokens[max(0, i - 4) : i] + tokens[i + 1 : i + 5]
                near.update((w, x) for x in around)
                beside[w] += len(around)
                holding[w] += 1
                within.update((w, x) for x in set(plain))
    total = sum(n.values())
    want = {}
    for joint, of, entity, whole in ((near, n, beside, total), (within, docs_of, holding, len(texts))):
        for (e, term), j in joint.items():
            given = min(1, j / max(of[term], j))
            if j >= pii.SUPPORT and given >= 0.5:
                d = max(0.0, 1 + math.log(given) / -math.log(entity[e] / whole))
                if d >= pii.GENERALISE:
                    want[term] = max(d, want.get(term, 0))
    assert set(got) == set(want) and len(want) >= 4
    assert all(got[t] == pytest.approx(want[t], rel=1e-9) for t in want)


def test_pii_spans_and_sanitised_texts(docs, none, spark):
    got = {r["doc_id"]: r for r in pii.digests(pii.detect(docs)).collect()}
    r = got[10]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    base = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(rows()[10][1]))
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(got) == len({x[0] for x in rows()}) and pii.detect(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, text, *_ in rows():
        assert clean[i] == text or i == 10
    assert "[EMAIL]" in clean[10] and "[CARD]" in clean[10] and "4111" not in clean[10]
    assert pii.sanitise(none).count() == 0
    # a word that stands only near one address gives it away; a word that is everywhere does not
    texts = [f"zanzibar boss@corp.example.com common word{i}" for i in range(6)] + ["common words only here"] * 30
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cleaned = [r["text"] for r in pii.sanitise(table).where("doc_id < 6").collect()]
    assert all("zanzibar" not in t and "common" in t for t in cleaned)
    assert pii.sanitise(table).where("text = 'common words only here'").count() == 30


@pytest.mark.parametrize("broadcast", [pii.BROADCAST_TERMS, 0])
def test_pii_terms_go_wherever_they_stand(spark, broadcast, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", broadcast)
    far = " ".join(["filler"] * 10)
    texts = [f"zanzibar Li boss@corp.example.com {far} and Zanzibar again {far} quokka word{i}" for i in range(6)]
    texts += ["we met ZANZIBAR, and Li too", "a quokka alone"] + [f"{far} again and word"] * 30 + [None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    for i in range(6):  # beside the address, far from it, and by document alone
        assert not re.search("zanzibar|quokka|\\bLi\\b", clean[i], re.I) and clean[i].count("filler") == 20
    assert not re.search("zanzibar|\\bLi\\b", clean[6], re.I) and clean[6].startswith("we met ") and "quokka" not in clean[7] and clean[7].endswith("alone")
    assert all(clean[i] == texts[i] for i in range(8, len(texts)))
    found = {r["doc_id"]: [(t["start"], t["end"]) for t in r["terms"]] for r in pii.detect(table).collect()}
    assert found[6] == [(7, 15), (21, 23)] and found[7] == [(2, 8)] and not any(found[i] for i in range(8, len(texts)))


def test_pii_patterns():
    assert pii.find("x 256.1.1.1 y 1.2.3.4") == [(14, 21, "ip")]
    assert pii.find("n 4111 1111 1111 1112") == []
    assert pii.find("call +12345 or +44 (20) 7946-0958") == [(15, 33, "phone")]
    assert pii.cleaned("ab cd", [(0, 2, "ip")], [(1, 5, 0.9)]) == "[IP]"


def vectors(spark, n=260, d=8, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32) * r.uniform(0.2, 3, (n, 1)).astype(np.float32)
    x[40:60] = x[40]
    data = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    data += [(9000, None, 1), (9050, [1.0, None] * (d // 2), 1), (9100, [float("nan")] * d, 1), (9150, [float("inf")] * d, 1), (9200, [0.0] * d, 1), (9250, [], 1), data[5]]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3), data


@pytest.mark.parametrize("found", [lambda t: topk.top_k(t, F.col("vec_id") % 50 == 0, 5, 256.0), lambda t: ann.nearest(t, F.col("vec_id") % 20 == 0, 5)])
def test_blocks_meet_without_broadcast(spark, found):
    r = random.Random(5)
    table = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(200)], "vec_id long, embedding array<double>")
    out = found(table)  # small files, of which explode makes many rows: their size must not lead to a broadcast
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count() == 5 * out.select("query_id").distinct().count() > 0


def test_top_k_seeds_of_repeated_ids(spark):
    rows = [(7, [float(i), 1.0]) for i in range(1500)] + [(50, [1.0, 0.0]), (50, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = [(r["score"], r["vec_id"]) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, 2, 256.0).collect()]
    assert sorted(got) == sorted([(256 * 256 * 1499, 7), (256 * 256 * 1498, 7), (65536, 7), (65536, 7)])


def test_exact_top_k(spark):
    table, data = vectors(spark)
    sound = [(i, np.floor(np.array(v, np.float64) * 256)) for i, v, _ in data if v and all(a is not None and math.isfinite(a) for a in v)]
    got = collections.defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0, 5, 256.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i, q in sound:
        if i % 50 == 0:
            scores = sorted(((int(q @ v), j) for j, v in sound if j != i), key=lambda s: (-s[0], s[1]))[:5]
            assert got.pop(i) == [(j, s) for s, j in scores]
    assert not got
    assert topk.top_k(table.where("vec_id < 0"), F.col("vec_id") % 50 == 0, 5, 256.0).count() == 0
    few = topk.top_k(table.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0, 5, 256.0)
    assert few.count() == 2


def test_coordinate_ranges_hold():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (x / np.sqrt(x @ x) for x in r.normal(size=(2, 6)))
        low, high = topk.allowed(a, float(a @ b))
        assert (b >= low - 1e-9).all() and (b <= high + 1e-9).all()


def test_nearest_recall(spark):
    table, data = vectors(spark, 900, 16)
    sound = [(i, np.array(v, np.float64)) for i, v, _ in data if v and all(a is not None and math.isfinite(a) for a in v) and any(v)]
    got = collections.defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for i, q in sound:
        if i % 20 == 0:
            scores = {j: float((np.float64(q) * v).sum()) for j, v in sound if j != i}
            best = sorted(scores, key=lambda j: (-scores[j], j))[:20]
            hits += len(set(best) & {j for j, _ in got[i]})
            total += 20
            assert [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)
            assert all(abs(scores[j] - s) < 1e-9 for j, s in got[i])
    assert hits / total >= 0.9
    assert ann.nearest(table.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_nearest_of_more_numbers_of_components_than_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(ann, "KINDS", 1)
    data = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(60)] + [(100 + i, [1.0, float(i)]) for i in range(30)]
    found = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).where("query_id >= 100").collect()
    assert {r["query_id"] for r in found} == {100, 120} and [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 120] == [129, 128, 127, 126, 125]


@pytest.mark.parametrize("copies", [2, 50])
def test_nearest_of_repeated_queries(spark, copies):
    x = np.random.default_rng(6).normal(size=(100, 8))
    data = [(i, [float(v) for v in x[i]]) for i in range(100)]
    table = spark.createDataFrame([(0, [float(v) for v in 9 * x[0]])] * copies + data[1:], "vec_id long, embedding array<float>")
    scores = x @ (9 * x[0])
    want = sorted(range(1, 100), key=lambda j: -scores[j])[:20]
    got = collections.Counter(r["vec_id"] for r in ann.nearest(table, F.col("vec_id") == 0, 20, share=1.0).collect())
    assert got == {j: copies for j in want}


def test_walk_visits_pairs_by_sum_of_distances():
    r = np.random.default_rng(8)
    a, b = r.random(7), r.random(5)
    sums = (a[:, None] + b[None]).reshape(-1)
    order = ann.walk(a, b, np.ones((7, 5), np.int64), 35)
    assert sorted(order.tolist()) == list(range(35)) and (np.diff(sums[order]) >= -1e-12).all()


def test_url_rules_and_list(spark):
    data = [
        (1, "https://EXAMPLE.com/en/a"), (2, "https://www.example.com/en/a"), (3, "http://a.b.net/es/x?utm_source=f"), (4, None), (5, "no scheme"), (6, "https://spam-farm.org/p/?ref=x#y"),
        (7, "http://www.spam-farm.org/p"), (8, "https://x.org/q?b=2&a=1"), (9, "https://com"), (10, "https://com/"), (10, "https://com/"), (11, "https://other.org/p?q=://z"),
    ]
    table = spark.createDataFrame([(*r, "h", "r") for r in data], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.judge(table, urls.RULES, urls.canonical_on_hosts(table, urls.LABELS)).collect()}
    want = {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"), 7: (None, "block"), 8: (None, "allow"), 9: (None, "allow"), 10: ("com/", "allow"), 11: (None, "allow")}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == want
    assert got[8]["canonical"] == "x.org/q?a=1&b=2" and got[4]["host"] == got[4]["path"] == ""
    judged = urls.judge(table, urls.RULES, urls.canonical_on_hosts(table, urls.LABELS))
    assert judged.count() == len(data)
    assert urls.judge(table, urls.RULES, urls.canonical_on_hosts(table.limit(0), urls.LABELS)).where("listed").count() == 0
    assert urls.judge(table.limit(0), urls.RULES, urls.canonical_on_hosts(table, urls.LABELS)).count() == 0


def test_filter_passes_all_listed(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical"))
    asked = spark.range(2000, 8000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical"))
    out = urls.flag_listed(asked, listed)
    row = out.agg(F.count_if("listed"), F.count_if("maybe"), F.count(F.lit(1))).first()
    assert row[0] == 1000 and 1000 <= row[1] < 1100 and row[2] == 6000


def test_long_listed_urls_are_not_broadcast(spark, monkeypatch):
    listed = spark.range(50).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical"))
    asked = spark.range(20, 90).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical"))
    want = sorted(map(tuple, urls.flag_listed(asked, listed).collect()))
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 10)
    assert sorted(map(tuple, urls.flag_listed(asked, listed).collect())) == want and sum(x[2] for x in want) == 30
