"""Operators on texts against brute-force versions, over fixtures with nulls, ties and repeats."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import license_scan, nbsvm, packing, quality_rules, sharding, simhash, substring_dedup, trie_bpe, warc
from lodestone.llm.queries import held_out, table, vocabulary

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeghilmnorst") for _ in range(RNG.randint(1, 9))) for _ in range(800)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts():
    shared = prose(60)
    base = prose(300)
    near = base.split()
    near[150] = "changed"
    return [
        None, "", " \t\n ", "one", "two words", prose(20), prose(34), prose(35), base, base, " ".join(near), shared + " " + prose(40),
        prose(30) + "\n" + shared, "ab " * 80, "ABC abc Abc abc " * 20, "x\x00y\x1cz\x7f", "é́ İstanbul ΣΑΣ ﬁ ½ 日本語 😀👍🏽 　x y", "a<|endoftext|>b  double  space \n\n end ",
        "# * $ % & | < > " * 10, "line one\nline one\n\n \nline two\nline one", prose(6000), "z" * 5000, "don't I'll WE'VE 1234 ''' ...", base, None, "",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 24 else None, t, ["en", "de", None, "xx"][i % 4], f"s{i % 3}", len(t or ""), "clash", 1) for i, t in enumerate(texts())]
    rows.append(rows[8])  # a row that is repeated as it is
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key1 string, __spans int").repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return (text or "").encode().split()


def test_quality_rules(docs, empty):
    found = quality_rules.measure(docs, vocabulary("piece_bpe_32k.model"))
    assert found.columns == [*docs.columns, "rules"]
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        t, w, m = r["text"] or "", words(r["text"]), r["rules"]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        assert (m.n_words, m.word_chars, m.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t))
        assert (m.n_dup_lines, m.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert m.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (m.base_failed and m.kept)
        if not w:
            assert m.n_tokens == 0 and m.chars_per_token is None and not m.kept
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    r = next(x for x in rows if x["doc_id"] == 16)
    ids = [i for w in words(r["text"]) for i in model.encode(w.decode())]
    n = Counter(ids)
    assert r["rules"].n_tokens == len(ids)
    assert math.isclose(r["rules"].fallback_share, sum(model.is_byte(i) for i in ids) / len(ids))
    assert math.isclose(r["rules"].token_entropy, -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()))
    assert quality_rules.measure(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_bands_reject(spark):
    junk = spark.createDataFrame([("en", " ".join("日本" * 3 + chr(0x4E00 + i) for i in range(60))), ("xx", " ".join(["qqq%d" % (i % 10) for i in range(60)]))], "lang string, text string")
    kept = [r["rules"]["kept"] for r in quality_rules.measure(junk, vocabulary("piece_bpe_32k.model"), bands={"*": quality_rules.Band(1.0, 3.0, fallback=0.1)}).collect()]
    assert kept == [False, False]


def test_quality_rules_keep_clean_documents(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    rules = quality_rules.measure(labelled, vocabulary("piece_bpe_32k.model")).where("not rules.base_failed")
    assert rules.where("not rules.kept").count() <= 0.01 * rules.count()


def test_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nbsvm.fit(docs, labels.where(~held_out()))
    scored = nbsvm.score(docs, model).join(labels.where(held_out()), "doc_id").collect()
    assert len(scored) > 50
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)
    assert right >= 0.93 * len(scored)


def test_classifier_edges(docs, empty, spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (18, 0), (13, 0), (13, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    scores = nbsvm.score(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in scores)
    by_text = {}
    for r in scores:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    none = nbsvm.fit(docs, labels.limit(0))
    assert {r["score"] for r in nbsvm.score(docs, none).collect()} == {0.5}
    one = nbsvm.fit(docs, labels.where("doc_id in (5, 6)"))
    assert {r["score"] for r in nbsvm.score(docs, one).collect()} == {1.0}
    assert nbsvm.fit(empty, labels).default == 0.5
    assert nbsvm.score(empty, model).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0)
    w = nbsvm.dual_descent([(np.arange(3), v) for v in x], y, np.full(60, 10.0), 3, 200)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95


def library(name):
    import tokenizers

    return tokenizers.Tokenizer.from_file(vocabulary(name))


def test_trie_bpe(docs, empty):
    path = vocabulary("word_bpe_49k.json")
    lib = library("word_bpe_49k.json")
    found = trie_bpe.encode(docs, path)
    for r in found.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["bpe"]["ids"] == ids, r["text"]
        assert r["bpe"]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert trie_bpe.encode(empty, path).count() == 0


def test_trie_bpe_random_words():
    with open(vocabulary("word_bpe_49k.json")) as f:
        ours = trie_bpe.Tokenizer(f.read())
    lib = library("word_bpe_49k.json")
    rng = random.Random(3)
    letters = "aaabcdeeeethinngrs'sS12!?.,éßñ́ΩЖ中İſͅ|<>"
    for _ in range(400):
        text = "".join(rng.choice(letters + " ") for _ in range(rng.randint(1, 60)))
        chunks = text.encode().split()
        ours.table.admit([chunks])
        ids = [i for c in chunks for i in np.frombuffer(ours.table[c], "<i4").tolist()]
        assert ids == lib.encode(text, add_special_tokens=False).ids, text


def test_packing(docs, empty):
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    lib = library("byte_bpe_50k.json")
    rows = packing.pack(docs, *paths).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[r["doc_id"], at, zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)] += 1
    got = Counter((r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"])), r["doc_tokens"]) for r in rows)
    assert got == want
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 1024
    assert sum(n <= 512 for n in sequences.values()) <= 1  # leftovers of the partitions are merged
    assert packing.pack(empty, *paths).count() == 0


def test_open_windows_are_bounded():
    windows, rng, sent = packing.OpenWindows(100, 4), random.Random(1), 0
    for i in range(500):
        sent += len(windows.place(rng.randint(1, 100), (i,)))
        assert len(windows.rooms) <= 4 and len(windows.pieces) == len(windows.rooms)
    assert sent > 200


def reference_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    import xxhash

    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def test_simhash(docs, empty):
    found = simhash.components_of(simhash.fingerprints(docs)).collect()
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [(r["doc_id"], r["lanes"][0] % (1 << 64)) for r in found]
    assert len(found) == docs.count()
    assert all(p == reference_fingerprint(by_id[i]) for i, p in prints)
    for r, (_, p) in zip(found, prints, strict=True):
        reach, grown = {p}, True
        while grown:
            more = {y for _, y in prints if any((x ^ y).bit_count() <= 2 for x in reach)}
            grown, reach = more != reach, more
        assert r["component_id"] == min(i for i, y in prints if y in reach and i is not None)
    assert simhash.components_of(simhash.fingerprints(empty)).count() == 0


def test_simhash_flips(spark):
    """Every pair of fingerprints that differ in one or two bits is found, wherever the bits are."""
    rng = random.Random(2)
    rows, expected = [], {}
    for g in range(200):
        p = rng.getrandbits(64)
        bits = rng.sample(range(64), rng.choice([1, 2, 3]))
        q = p
        for b in bits:
            q ^= 1 << b
        rows += [(2 * g, [p - (1 << 64) if p >> 63 else p]), (2 * g + 1, [q - (1 << 64) if q >> 63 else q])]
        expected[2 * g + 1] = 2 * g if len(bits) <= 2 else 2 * g + 1
    df = spark.createDataFrame(rows, "doc_id long, lanes array<long>")
    found = {r["doc_id"]: r["component_id"] for r in simhash.components_of(df).collect()}
    assert all(found[i] == c for i, c in expected.items())


def brute_substring(rows, width=35):
    counts = Counter(tuple(w[i : i + width]) for w in rows for i in range(len(w) - width + 1))
    kept = []
    for w in rows:
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept.append([x for j, x in enumerate(w) if j not in gone])
    return kept


@pytest.mark.parametrize("held,cells", [(1 << 20, 1 << 30), (50, 1 << 30), (1 << 20, 64), (50, 64)])
def test_substring_dedup(docs, empty, held, cells, monkeypatch):
    """With the sketch, and with the grams of a corpus that is too large for it dealt by their hash."""
    monkeypatch.setattr(substring_dedup, "HELD", held)
    found = substring_dedup.dedup(docs, most_cells=cells).collect()
    assert set(found[0].asDict()) == {*docs.columns, "stripped"}
    rows = [words(r["text"]) for r in found]
    for r, w, kept in zip(found, rows, brute_substring(rows), strict=True):
        s = r["stripped"]
        assert (s.n_words, s.n_removed, s.kept_text) == (len(w), len(w) - len(kept), b" ".join(kept).decode())
    assert substring_dedup.dedup(empty).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    grams = np.concatenate([grams, grams[:1000]])
    sketch = substring_dedup.Sketch(16)
    for part in np.array_split(grams, 7):
        sketch.add(part)
    assert substring_dedup.estimated_repeated(sketch.twice, 16, grams[:1000]).all()
    block = sketch.once[0][:8192]
    assert (substring_dedup.opened(substring_dedup.shut(block), 8192) == block).all()


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc(spark):
    tricky = ["", None, "a\r\n\r\nb", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "ends\r\n", "ends\r", "\r\n\r\n", "\r\n\r\n\r\n\r\n", "\n\n", "é" * 3000, "same", "same", "same", "x\r\n\r", "once"]
    rows = [(100 - i, f"http://h{i}.example/p?q={i}#f", t) for i, t in enumerate(tricky)] + [(7, None, "same"), (None, "http://n/", "same"), (8, "u\r\nWARC-Type: x", "once more")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).withColumn("n", warc.payload_bytes()).collect()
    assert len(got) == len(rows)
    record_of = {r["metadata"]["page_id"]: r["response"]["record_id"] for r in got}
    assert len({r["response"]["record_id"] for r in got}) == len(got)
    bodies = {i: (t or "").encode() for i, _, t in rows}
    for r in got:
        i = None if r["metadata"]["page_id"] is None else int(r["metadata"]["page_id"])
        body = bodies[i]
        first = min(k for k, b in bodies.items() if k is not None and b == body)
        assert r["response"]["payload_digest"] == "sha1:" + base32(body) and r["n"] == len(body)
        if i == first:
            assert r["response"]["record_type"] == "response" and bytes(r["response"]["payload"]) == body
        else:
            assert r["response"]["record_type"] == "revisit" and not r["response"]["payload"] and int(r["metadata"]["refers_to_page"]) == first
            assert r["response"]["refers_to"] == record_of[str(first)]
        assert r["request"]["http_head"].startswith("GET /") and r["request"]["record_id"] != r["response"]["record_id"]
    assert warc.round_trip(pages.limit(0)).count() == 0
    long_ones = warc.round_trip(pages, least_bytes=5).where("response.record_type = 'revisit'").count()
    assert long_ones == 0


def test_warc_parser_cuts():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 6\r\n\r\nab\r\n\r\n\r\n\r\n"
    pieces = (record * 2).split(b"\r\n\r\n")
    assert [r[-1] for r in warc.parse(iter(pieces))] == [b"ab\r\n\r\n"] * 2
    assert list(warc.parse(iter([]))) == []


@pytest.mark.parametrize("n,hot", [(97, 0), (400, 150), (3, 0)])
def test_sharding(spark, n, hot):
    rng = random.Random(n)
    rows = [(i, "hot" if i < hot else None if i % 50 == 49 else f"t{rng.randint(0, n // 3)}") for i in range(n)]
    rows.append(rows[0])
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    sizes = Counter(r["shard"] for r in found)
    counts = [sizes.get(s, 0) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    text = dict(rows)
    groups = {}
    for r in found:
        t = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        groups.setdefault(t, Counter())[r["shard"]] += 1
    apart = sum(sum(c.values()) - max(c.values()) for t, c in groups.items() if t != b"hot")
    assert apart <= max(2, 0.1 * len(rows))
    if hot:
        assert sum(n for _, n in groups[b"hot"].most_common(4)) >= 0.85 * hot


def test_sharding_empty(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        ("a/b/LICENSE", apache, 1), ("a/b/c/x.py", "import os", 1), ("a/y.py", prose(50), 1), ("a/b/z.py", prose(100) + "\nReleased under the MIT License.", 1),
        (None, prose(10), 1), ("q.txt", None, 1), ("q.txt", None, 1), ("", "", 1), ("d/e/f/g.txt", prose(5), 1), ("d/NOTICE", "This work is licensed under the GNU General Public License, version 3.", 1),
    ]
    files = spark.createDataFrame(rows, "path string, text string, folder int")
    found = license_scan.inherit(license_scan.own_licenses(files, "text", rare=0.5), "path").collect()
    assert len(found) == len(rows)
    by_path = {r["path"]: r for r in found}
    assert by_path["a/b/LICENSE"]["license"] == "Apache-2.0" and by_path["a/b/LICENSE"]["inherited_from"] is None
    assert (by_path["a/b/c/x.py"]["license"], by_path["a/b/c/x.py"]["inherited_from"]) == ("Apache-2.0", "a/b")
    assert by_path["a/y.py"]["license"] is None and by_path["a/b/z.py"]["license"] == "MIT"
    assert (by_path["d/e/f/g.txt"]["license"], by_path["d/e/f/g.txt"]["inherited_from"]) == ("GPL-3.0", "d")
    assert by_path[None]["license"] is None and by_path["q.txt"]["license"] is None
    assert license_scan.inherit(license_scan.own_licenses(files.limit(0), "text"), "path").count() == 0


def test_license_cosine_brute():
    frequency, files = {b"the": 50, b"license": 3}, 100
    m = license_scan.Matcher(license_scan.TEMPLATES, frequency, files, 0.1)
    line = license_scan.terms(b"Licensed under the Apache License, Version 2.0. Enjoy")
    idf = lambda t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1
    best = {}
    for name, template in license_scan.TEMPLATES.items():
        a, b = Counter(line), Counter(license_scan.terms(template.encode()))
        dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a)
        best[name] = dot / math.sqrt(sum((n * idf(t)) ** 2 for t, n in a.items()) * sum((n * idf(t)) ** 2 for t, n in b.items()))
    score, at = m.best(line)
    assert math.isclose(score, max(best.values())) and m.names[-at] == "Apache-2.0"
