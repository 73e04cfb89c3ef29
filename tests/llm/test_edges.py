"""Clashing column names, very long texts, ties and repeated rows for every operator; placements and margins by brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import license_scan, minhash, nbsvm, packing, quality_rules, sharding, simhash, substring_dedup, trie_bpe, warc
from lodestone.llm.queries import vocabulary
from tests.llm.test_text_operators import library, prose, words

#: Names that the operators use for results or in between.
CLASHING = ("rules", "score", "bpe", "own", "license", "inherited_from", "inherited_depth", "lanes", "stripped", "node", "sketch", "key", "__key1", "key1", "__spans", "spans", "size", "shard", "slot", "bucket", "g", "u", "n", "start", "ids", "sequence_id", "offset", "payload", "digest", "refers_to", "seq", "component_id", "__id", "__text", "__folder")
LONG = prose(250_000, random.Random(11))


@pytest.fixture(scope="module")
def plain(spark):
    rng = random.Random(8)
    shared = prose(50, rng)
    rows = [(i, prose(rng.randint(1, 300), rng) + " " + shared, "en", f"d{i % 3}/f{i}.txt") for i in range(30)]
    rows += [(40, rows[3][1], "en", "x.txt"), (40, rows[3][1], "en", "x.txt"), (41, None, None, None), (42, "", "de", "a/b"), (43, LONG, "en", "long/l.txt"), (44, "Released under the MIT License.", "en", "d1/LICENSE")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, path string").repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({c: F.lit(-7) for c in CLASHING})


MODEL = nbsvm.train([np.arange(5, dtype=np.uint64) << np.uint64(50), np.arange(9, dtype=np.uint64) << np.uint64(50)] * 3, np.array([0, 1] * 3), least=1)

OPERATORS = {
    "op1": lambda d: quality_rules.measure(d, vocabulary("piece_bpe_32k.model")).select("doc_id", "rules.*"),
    "op2": lambda d: warc.round_trip(d, "doc_id", "path", "text").select("metadata.page_id", "response.payload_digest", "response.record_type", "metadata.refers_to_page", warc.payload_bytes().alias("bytes")),
    "op3": lambda d: sharding.assign(d).groupBy("shard").agg(F.count(F.lit(1)).alias("rows")),
    "op4": lambda d: nbsvm.score(d, MODEL).select("doc_id", F.round("score", 9)),
    "op5": lambda d: trie_bpe.encode(d, vocabulary("word_bpe_49k.json")).select("doc_id", F.crc32(F.col("bpe.decoded").cast("binary")), F.size("bpe.ids")),
    "op6": lambda d: license_scan.inherit(license_scan.own_licenses(d, "text"), "path").select("doc_id", "own.license", "license", "inherited_from", "inherited_depth"),
    "op7": lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens"),
    "op8": lambda d: simhash.components_of(simhash.fingerprints(d)).select("doc_id", "lanes", "component_id"),
    "op9": lambda d: substring_dedup.dedup(d).select("doc_id", "stripped.n_words", "stripped.n_removed", F.crc32(F.col("stripped.kept_text").cast("binary"))),
    "near": lambda d: minhash.groups(minhash.marks(d.dropDuplicates(["doc_id"]), node="m1", sketch="m2"), "doc_id", node="m1", sketch="m2").select("doc_id", "component_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(plain, clashing, name):
    """A column that has a result's name gives way to it; all others are just not there for the operator."""
    f = OPERATORS[name]
    rows = [sorted(map(str, f(d).collect())) for d in (plain, clashing)]
    assert rows[0] == rows[1] and rows[0]


def test_very_long_texts_are_read_whole(plain):
    n = len(LONG.split())
    row = lambda name: next(r for r in OPERATORS[name](plain).collect() if r[0] in (43, "43"))
    assert row("op1")["n_words"] == n and row("op1")["word_chars"] == n + sum(len(w) - 1 for w in LONG.split())
    assert row("op2")["bytes"] == len(LONG.encode())
    assert row("op5")[2] == len(library("word_bpe_49k.json").encode(LONG, add_special_tokens=False).ids)
    pieces = [r for r in OPERATORS["op7"](plain).collect() if r["doc_id"] == 43]
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] == len(library("byte_bpe_50k.json").encode(LONG, add_special_tokens=False).ids) + 1
    assert row("op9")["n_words"] == n and row("op9")["n_removed"] == 0


def test_shapes_are_of_whole_words():
    long = b"a" * 70
    assert nbsvm.shape(long + b"9") == b"a0" != nbsvm.shape(long)
    assert nbsvm.shape(b"Ab" * 50) != nbsvm.shape(b"Ab" * 50 + b"!")


def test_verdicts_follow_the_bands(plain):
    """kept, from the measures alone."""
    for r in quality_rules.measure(plain, vocabulary("piece_bpe_32k.model")).collect():
        m = r["rules"]
        if not m.n_tokens:
            assert not m.kept
            continue
        band = quality_rules.BANDS[r["lang"]]
        inside = band.low - band.slack / math.sqrt(m.n_tokens) <= m.word_chars / m.n_tokens <= band.high + band.slack / math.sqrt(m.n_tokens)
        enough = m.token_entropy >= min(band.entropy_floor, band.entropy_slope * math.log2(m.n_tokens))
        assert m.kept == (inside and enough and m.fallback_share <= band.fallback and not m.base_failed)
        assert math.isclose(m.chars_per_token, m.word_chars / m.n_tokens)


def test_best_fit_by_brute_force():
    """Each piece goes to the fullest window that holds it; if none does and all are in use, the fullest leaves."""
    rng, size, most = random.Random(4), 64, 5
    windows = packing.OpenWindows(size, most)
    open_, left = {}, []
    for i in range(800):
        length = rng.choice([rng.randint(1, 10), rng.randint(1, size)])
        got = windows.place(length, (i,))
        fits = [w for w, room in open_.items() if room >= length]
        want = []
        if fits:
            chosen = min(fits, key=lambda w: (open_[w], w))
        else:
            if len(open_) == most:
                fullest = min(open_, key=lambda w: (open_[w], w))
                want.append(fullest)
                del open_[fullest]
            chosen = len(left) + len(open_) + len(want)
            open_[chosen] = size
        open_[chosen] -= length
        if not open_[chosen]:
            want.append(chosen)
            del open_[chosen]
        left += want
        assert [w for w, _ in got] == want
        assert sorted((room, w) for w, room in open_.items()) == windows.rooms


def test_leftovers_by_brute_force():
    import pandas as pd

    rng = random.Random(5)
    fills = [rng.randint(1, 100) for _ in range(120)]
    frame = packing.merge_windows(pd.DataFrame({"sequence_id": range(120), "fill": fills}), 100)
    rooms, want = {}, {}
    for w in sorted(range(120), key=lambda w: (-fills[w], w)):
        fits = [s for s in rooms if rooms[s] >= fills[w]]
        s = min(fits, key=lambda s: (rooms[s], s)) if fits else w
        want[w] = (s, 100 - rooms.get(s, 100))
        rooms[s] = rooms.get(s, 100) - fills[w]
    assert {r.sequence_id: (r.to_sequence, r.to_offset) for r in frame.itertuples()} == want


def test_margins_reach_the_optimum():
    """Dual coordinate descent against the primal objective: no small step from its weights lowers it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    y = np.where(x @ rng.normal(size=6) + rng.normal(0, 0.7, 80) > 0, 1.0, -1.0)
    costs = np.full(80, 0.7)
    w = nbsvm.dual_descent([(np.arange(6), v) for v in x], y, costs, 6, 3000)
    objective = lambda w: 0.5 * w @ w + (costs * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()
    best = objective(w)
    assert all(objective(w + step * d) >= best - 1e-3 for d in [*np.eye(7), *rng.normal(size=(50, 7))] for step in (-0.05, -0.005, 0.005, 0.05))


def test_ratios_are_of_class_counts():
    docs = [np.unique(np.array(d, np.uint64) << np.uint64(45)) for d in ([1, 2, 3], [1, 2], [1, 4, 5], [4, 5])]
    model = nbsvm.train(docs, np.array([1, 1, 0, 0]), least=1)
    seen = {int(k >> np.uint64(45)): r for k, r in zip(model.keys, model.ratios) if k}
    ones, zeros = Counter([1, 2, 3, 1, 2]), Counter([1, 4, 5, 4, 5])
    slots = 1 << nbsvm.SLOT_BITS
    for f, r in seen.items():
        assert math.isclose(r, math.log((ones[f] + 1) / (5 + slots)) - math.log((zeros[f] + 1) / (5 + slots)), abs_tol=1e-9)


@pytest.mark.parametrize("seed", [1])
def test_cut_edges(spark, seed):
    """Documents apart from most of their group, with and without the rounds: never more than a shard's border splits."""
    rng = random.Random(seed)
    texts = [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(600)] + [f"own{i}" for i in range(200)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "t1"), (None, None)], "doc_id long, text string")

    def cut(rounds):
        groups = {}
        for r in sharding.assign(df, rounds=rounds).select("text_crc32", "shard").collect():
            groups.setdefault(r["text_crc32"], Counter())[r["shard"]] += 1
        assert sum(sum(c.values()) for c in groups.values()) == 802
        return sum(sum(c.values()) - max(c.values()) for c in groups.values()), groups

    before, after = cut(0), cut(8)
    assert after[0] <= before[0]
    room = math.ceil(802 / 8)
    forced = sum(max(0, sum(c.values()) - room) for c in after[1].values())  # a group larger than a shard is split whatever one does
    assert after[0] <= forced + 0.05 * 802
    assert zlib.crc32(b"t1") in after[1]


def test_headers_of_the_gpl(spark):
    """Versions are told apart in the usual file headers, wrapped over lines."""
    head = "This {what} is free software{sign} you can redistribute it and/or modify\nit under the terms of the GNU {less}General Public License as published by\nthe Free Software Foundation{sign} either version {v} of the License, or\n(at your option) any later version."
    cases = [("program", ":", "", "3", "GPL-3.0"), ("program", ";", "", "2", "GPL-2.0"), ("library", ";", "Lesser ", "2.1", "LGPL-2.1")]
    rows = [(i, "\n".join(f"# {x}" for x in head.format(what=w, sign=s, less=g, v=v).split("\n")) + "\n" + prose(200)) for i, (w, s, g, v, _) in enumerate(cases)]
    rows += [(i, prose(100)) for i in range(10, 40)]
    found = {r["doc_id"]: r["own"]["license"] for r in license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert [found[i] for i in range(3)] == [c[-1] for c in cases] and all(found[i] is None for i in range(10, 40))


def test_words_are_the_contracts():
    assert words("a\x1cb c\x0bd e") == [b"a\x1cb", b"c", "d e".encode()]


def test_a_cluster_needs_a_shared_folder():
    from lodestone.llm import common

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Sc

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
