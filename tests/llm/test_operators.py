"""The operators against plain Python, on small tables with awkward rows."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rolefunnel.llm import backoff, common, decontaminate, language, packing, pieces, quality, repeats, simhash, spotsigs, toxicity

WORDS = "river stone winter garden market yellow thunder lantern pocket mirror candle wooden silver bridge harbor meadow forest copper".split()
SCHEMA = "doc_id bigint, text string, lang string, id int, score string, ids string, fp string, h string"
SQL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 80)
    out = {1: base, 2: base, 3: base.replace("river", "River", 1), 4: None, 5: "", 6: " \n\t ", 7: "!!! ???", 8: "one", 9: "Übergrößen straße " * 30}
    out[10] = base + " " + prose(rng, 60)
    out[11] = prose(rng, 40) + "\n" + base[:300] + "\n" + prose(rng, 40)
    out[12] = "ab" * 400
    out[13] = prose(rng, 6000)
    out[14] = "x" * 30_000
    out[15] = "日本語のテキスト。" * 40 + "▁ literal \U0010fffd 🎉"
    out[16] = out[11][::-1]
    for k in range(17, 40):
        out[k] = prose(rng, rng.randint(3, 120)) + (" " + base[50:260] if k % 3 == 0 else "")
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else "de", -k, "s", "i", "f", "h") for k, t in texts.items()]
    rows += [(2, texts[2], "en", 0, "s", "i", "f", "h")]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- shared numpy helpers


def test_spans_and_hashes():
    column = pa.array(["ab cd", None, "", "cd", "x" * 10])
    data, off = common.flat(column.slice(0))
    starts, ends = common.spans(data, off, common.WORD)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"cd", b"x" * 10]
    assert common.row_of(off, starts).tolist() == [0, 0, 3, 4]
    h = common.PrefixHash(data).of(starts, ends)
    assert h[1] == h[2] != h[0]
    assert [b.num_rows for b in common.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t", 7)] == [4, 1]


# --- 1 packing


def test_best_fit_decreasing():
    rng = random.Random(1)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    rows = packing.best_fit_decreasing(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(300))
    # The same by search through all rows.
    room, plain = [], []
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fit = [r for r in range(len(room)) if room[r] >= sizes[i]]
        best = min((room[r] for r in fit), default=None)
        if best is None:
            room.append(50 - sizes[i])
            plain.append(1)
        else:
            room[next(r for r in fit if room[r] == best)] -= sizes[i]
    assert len(rows) == len(plain)
    assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_pack_round_trip(docs, empty, texts):
    assert packing.pack(empty).count() == 0
    encoding = packing.tokenizer(packing.DEFAULT_RANKS).encoding
    got = {}
    for r in packing.pack(docs, length=256, block_tokens=4000).collect():
        ids, positions = packing.id_matrix([r.ids], 256)[0], packing.id_matrix([r.positions], 256)[0]
        assert r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert positions[a:b].tolist() == list(range(b - a))
            got.setdefault((doc, start), []).append(ids[a:b].tolist())
    for doc, text in texts.items():
        want = encoding.encode_ordinary(text or "") + [50256]
        parts = sorted((s, p) for (d, s), p in got.items() if d == doc)
        assert all(len(p) == (2 if doc == 2 else 1) for _, p in parts)
        assert [i for _, p in parts for i in p[0]] == want


# --- 2 quality


def test_rules_column_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((800, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    assert 0 < len(model.rules) < 120
    frame = spark.createDataFrame(x.tolist(), list(quality.FEATURES)).select(model.column().alias("s"))
    got = np.array([r.s for r in frame.collect()])
    margin = model.intercept + sum(w * quality._holds(x, c) for c, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))
    assert ((got > 0.5) == (y == 1)).mean() > 0.97


def test_statistics_of_awkward_texts(texts):
    s = quality.statistics_of(pa.array(list(texts.values())))
    assert all(np.isfinite(v).all() for v in s.values())
    k = list(texts).index(12)
    assert s["n_words"][k] == 1 and s["longest"][k] == 800
    assert all(s[f][list(texts).index(5)] == 0 for f in quality.FEATURES)


def test_quality_scores(spark, docs, empty):
    labels = spark.createDataFrame([(k, 0 if k in (12, 14) else 1) for k in range(1, 40)] + [(3, None), (99, 1)], "doc_id bigint, quality int")
    got = {r.id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 39 and all(0 <= v <= 1 for v in got.values())
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


# --- 3 backoff


def test_backoff_by_plain_python(docs, empty, texts):
    every = [*texts.values(), texts[2]]
    words = [SQL_WORD.findall(lower(t)) for t in every]
    flatten = [w for ws in words for w in ws]
    ones = {w: flatten.count(w) for w in set(flatten)}
    for size in (10**6, 12):  # with and without an unknown word
        ranked = sorted(ones.values(), reverse=True)
        least = 0 if len(ranked) <= size else next(c for c in ranked if sum(n >= c for n in ranked) <= size)
        if len(ranked) > size:
            least = min(c for c in ranked if sum(n >= c for n in ranked) <= size)
        name = lambda w: w if ones[w] >= least else "?"
        uni = {}
        for w in flatten:
            uni[name(w)] = uni.get(name(w), 0) + 1
        uni["<s>"] = sum(bool(ws) for ws in words)
        pairs = [list(zip(["<s>", *map(name, ws)], map(name, ws))) for ws in words]
        two = {}
        for p in itertools.chain(*pairs):
            two[p] = two.get(p, 0) + 1
        for hot, rare in ((0, 2), (10, 1), (10**6, 2), (10**6, 1)):
            score = lambda p: np.log(two[p] / uni[p[0]] if two[p] >= rare else 0.4 * uni[p[1]] / len(flatten))  # noqa: B023, E731
            got = {r.id: (r.n_words, r.total) for r in backoff.backoff_scores(docs, vocabulary=size, hot=hot, min_count=rare).collect()}
            for doc, ps in zip(texts, pairs):
                times = 2 if doc == 2 else 1
                assert got[doc][0] == times * len(ps)
                assert got[doc][1] == pytest.approx(times * sum(map(score, ps)), rel=1e-9, abs=1e-9)
    assert backoff.backoff_scores(empty).count() == 0


@pytest.mark.parametrize("common, hot", [(0, 0), (12, 10), (12, 10**6), (10**6, 10)])
def test_backoff_keeps_all_words(docs, texts, common, hot):
    """However few words are sent to all tasks, every word scores by its own count."""
    words = [SQL_WORD.findall(lower(t)) for t in [*texts.values(), texts[2]]]
    flatten = [w for ws in words for w in ws]
    uni = {w: flatten.count(w) for w in set(flatten)} | {"": sum(bool(ws) for ws in words)}
    pairs = [list(zip(["", *ws], ws)) for ws in words]
    for min_count in (1, 2):
        two = {}
        for p in itertools.chain(*pairs):
            two[p] = two.get(p, 0) + 1
        score = lambda p: np.log(two[p] / uni[p[0]] if two[p] >= min_count else 0.4 * uni[p[1]] / len(flatten))
        got = {r.id: (r.n_words, r.total) for r in backoff.backoff_scores(docs, min_count=min_count, hot=hot, common=common).collect()}
        for doc, ps in zip(texts, pairs):
            times = 2 if doc == 2 else 1
            assert got[doc][0] == times * len(ps)
            assert got[doc][1] == pytest.approx(times * sum(map(score, ps)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("common, hot", [(0, 10), (12, 0), (12, 5), (10**6, 10**6)])
def test_backoff_shuffles_each_bigram_once(spark, monkeypatch, common, hot):
    """Rows are counted where they are scored: no table of bigrams is joined.  Rows without an id count, frequent bigrams too."""
    monkeypatch.setattr(backoff, "HOT_SHARE", 1, raising=False)
    monkeypatch.setattr(backoff, "HOT_SEEN", 2, raising=False)
    rng = random.Random(5)
    rows = [(i % 50 if i % 9 else None, " ".join(rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))) for i in range(90)]
    rows += [(50, None), (51, " .,"), (52, "only"), (None, "only a b")]
    words = [(i, SQL_WORD.findall(t or "")) for i, t in rows]
    uni, two, want = {}, {}, {}
    for _, ws in words:
        for v, w in zip(["", *ws], ws):
            uni[w] = uni.get(w, 0) + 1
            two[v, w] = two.get((v, w), 0) + 1
    uni[""] = sum(bool(ws) for _, ws in words)
    for i, ws in words:
        if i is not None:
            n, total = want.get(i, (0, 0.0))
            want[i] = n + len(ws), total + sum(np.log(two[p] / uni[p[0]]) for p in zip(["", *ws], ws))
    found = backoff.backoff_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), common=common, hot=hot)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.n_words, r.total) for r in found.collect()}
    assert got.keys() == want.keys()
    for i, (n, total) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(total, rel=1e-9, abs=1e-9)


# --- 4 decontamination


def brute_hits(text, items, window):
    words = SQL_WORD.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        w = SQL_WORD.findall(lower(item))
        k = min(len(w), window)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            for at in range(len(words) - k + 1):
                if words[at : at + k] == w[i : i + k]:
                    hit.update(range(at, at + k))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [10**6, 7])
def test_contamination(spark, docs, empty, texts, most):
    items = [(10, texts[1][20:220]), (9, "one"), (3, None), (4, "..."), (5, texts[13][3000:3200]), (6, "never seen words at all in here please stop now ok"), (7, texts[11][-150:])]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    got = decontaminate.contamination(docs, bench, most=most).select("doc_id", "n_words", decontaminate.n_hit().alias("hit"), "items").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.hit, r["items"]) == brute_hits(texts[r.doc_id], items, 10)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.hit for r in decontaminate.contamination(docs, bench.where("false")).select(decontaminate.n_hit().alias("hit")).collect()} == {0}


def test_proximity():
    column = pa.array(["a b c d e f", "c x x a", "f a z b"])
    part = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), column], ["id", "text"])
    terms, rows, n = decontaminate._words(column)
    count = np.bincount(rows, minlength=n)
    place = np.arange(len(terms)) + rows * 10
    order = np.argsort(terms, kind="stable")
    last = np.flatnonzero(np.append(terms[order][1:] != terms[order][:-1], True))
    cells = [np.array([1, 2, 3]), count.astype(np.int64), terms[order][last], (last + 1).astype(np.int32), place[order].astype(np.int32)]
    segment = decontaminate.Segment([c.tobytes() for c in cells])
    ca = np.array([[terms[2], terms[0]]])
    for within, docs_hit in ((2, []), (3, [1]), (4, [1, 2])):
        _, at = segment.near(ca, within)
        assert [int(segment.ids[d]) for d in segment.document(at)] == docs_hit
    assert part.num_rows == 3


# --- 5 simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    least = {n: n for n in nodes}
    while True:
        new = {n: min([least[n], *(least[m] for m in nodes if linked(n, m))]) for n in nodes}
        if new == least:
            return least
        least = new


def test_near_duplicates(docs, empty, texts):
    got = simhash.near_duplicates(docs).collect()
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    root = closure(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.fp % (1 << 64), r.component) == (prints[r.id], root[r.id])
    assert simhash.near_duplicates(empty).count() == 0


def brute_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("common", [simhash.COMMON, 0])
def test_similar_against_brute_force(spark, docs, empty, texts, monkeypatch, common):
    """Edited copies down to Jaccard 0.7 of five-word shingles: linked from 0.8 on, all of them and no others."""
    monkeypatch.setattr(simhash, "COMMON", common or 1)
    rng = random.Random(11)
    rows = dict(texts)
    for k in range(12):
        # Words of their own, and one passage that all have.
        words = [f"w{k}x{rng.randrange(900)}" for _ in range(rng.choice([7, 40, 100, 300]))] + [f"same{i}" for i in range(12)]
        rows[1000 + 20 * k] = " ".join(words)
        for j in range(1, 9):
            copy = list(words)
            for at in rng.sample(range(len(words)), min(len(words), 1 + j * len(words) // 300)):
                copy[at] = f"new{rng.randrange(10**6)}"
            rows[1000 + 20 * k + j] = " ".join(copy[: len(copy) - (j % 3)])
    sets = {i: brute_shingles(t) for i, t in rows.items()}
    like = lambda a, b: sets[a] == sets[b] or (len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]))
    want = closure(list(rows), like)
    table = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    assert {r.id: r.component for r in simhash.similar(table).collect()} == want
    assert sum(want[i] != i for i in rows) > 40
    assert simhash.similar(empty).count() == 0
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()}
    assert kept == set(want.values())


def test_sets_are_brought_together_where_they_meet_first(spark):
    """Forty sets with thirty shingles in common in one order are all pairs once, not thirty times; who meets first too late cannot be similar."""
    rows = [(1000 + k, node, 300, k, node) for node in range(40) for k in range(30)]
    rows += [(1, node, 300, 0, node) for node in (100, 101)] + [(2, node, 300, 40, node) for node in (200, 201)]
    rows += [(3, node, size, 0, node) for node, size in ((300, 300), (301, 241), (302, 239))]
    # A key of its own before each shared one does not hide the earlier meeting.
    rows += [(key, node, 300, at, node) for node in (400, 401) for at, key in enumerate((node * 10, 7, node * 10 + 1, 8, 9))]
    apart = spark.createDataFrame(rows, "key bigint, node bigint, size bigint, place bigint, root bigint")
    got = sorted((r.a, r.b) for r in simhash._first_meetings(simhash._with_earlier(apart, 0.8), 0.8).collect())
    assert got == [*itertools.combinations(range(40), 2), (100, 101), (300, 301), (301, 302), (400, 401)]


def test_differences_from_a_centre_bring_few_together(spark):
    """Sixty sets with 130 of 150 shingles of one text, each less than 0.8 like any other, make no pairs; two with the same edits meet."""
    rng = random.Random(6)
    base = set(range(1, 151))
    sets = {n: base - set(rng.sample(sorted(base), 20)) | {1000 * (n + 1) + k for k in range(20)} for n in range(60)}
    sets[100] = base - set(range(1, 21)) | set(range(500, 520))
    sets[101] = base - set(range(1, 21)) | set(range(502, 522))
    members = spark.createDataFrame([(7, n, len(v)) for n, v in sets.items()], "g bigint, node bigint, size bigint")
    table = spark.createDataFrame([(n, sorted(v)) for n, v in sets.items()], "node bigint, set array<bigint>")
    held = simhash._differences(members, table, 0.8).cache()
    assert {r.node: set(r.own) for r in held.collect()} == {n: v ^ base for n, v in sets.items()}
    assert simhash._around_centre(held).collect() == []
    pairs = simhash._met_in_crowds(simhash._entries(held.withColumn("root", held["node"])), 0.8).collect()
    assert [(r.a, r.b) for r in pairs] == [(100, 101)]


@pytest.mark.parametrize(("crowd", "centre"), [(simhash.CROWD, simhash.CENTRE), (2, 1), (2, 15)])
def test_a_crowd_of_near_copies_makes_few_pairs(spark, monkeypatch, crowd, centre):
    """Copies of one text, edited in different places and mostly below Jaccard 0.8 of each other, and texts around one passage: linked as by brute force,
    without comparing nearly all of them."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "CENTRE", centre)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = {}
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randrange(8)):
            copy[at] = f"new{rng.randrange(10**6)}"
        rows[i] = " ".join(copy[: len(copy) - rng.randrange(4)])
    # Edited in few places, of which two have some in common.
    for i in range(200, 240):
        rows[i] = " ".join(w if at not in (20 + i % 4 * 25, 30 + i % 3 * 25, 120, 130) else f"at{at}x{i % 2}" for at, w in enumerate(base))
        rows[i] += f" end{i % 7}"
    for i in range(300, 330):
        rows[i] = " ".join(base[40:80] + [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(20))])
    tried = []
    inner = simhash._near_enough
    monkeypatch.setattr(simhash, "_near_enough", lambda pairs, *a: tried.append(pairs.count()) or inner(pairs, *a))
    table = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    sets = {i: brute_shingles(t) for i, t in rows.items()}
    want = closure(list(rows), lambda a, b: len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]))
    assert {r.id: r.component for r in simhash.similar(table).collect()} == want
    assert len(set(want.values())) > 20 and sum(want[i] != i for i in rows) > 40
    assert sum(tried) < 5 * len(rows)


def test_fingerprints_propose_pairs_of_the_stage(spark, monkeypatch):
    """Close copies reach the exact check as pairs of fingerprints; a pair that fails it is not linked."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    rows = {1: " ".join(base), 2: " ".join(base[:-1] + ["end"]), 3: " ".join(base + ["more"]), 4: "a b", 5: "c d e", 6: "", 7: None}
    proposed = []
    inner = simhash.met_by_fingerprint
    monkeypatch.setattr(simhash, "met_by_fingerprint", lambda *a, **k: proposed.append(inner(*a, **k).count()) or inner(*a, **k))
    monkeypatch.setattr(simhash, "STAR_ROUNDS", ())
    table = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    assert {r.id: r.component for r in simhash.similar(table).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    assert proposed[0] >= 2
    nodes = [(10, 0), (11, 0), (12, 0), (20, 3), (30, 1 << 40 | 1 << 41 | 1 << 42), (31, 1 << 40), (40, -1)]
    found = inner(spark.createDataFrame(nodes, "node bigint, fp bigint"))
    got = {r.node: r.root for r in simhash.components(found).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 20: 10, 30: 10, 31: 10}


def test_no_join_holds_the_values_around_fingerprints(spark):
    # Many in one cell: the exploded values were the side of a join that the planner takes to be small, and went through the driver.
    fps = spark.createDataFrame([(0,)] + [(1 << k,) for k in range(40)], "fp bigint")
    found = simhash.links(fps)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and "Join" not in plan
    assert {r.root for r in simhash.components(found).collect()} == {0}


def test_filters_arrive_in_parts_and_are_recalled(spark, monkeypatch):
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: pytest.fail("a whole filter at once"))
    values = [random.Random(5).getrandbits(64) - (1 << 63) for _ in range(500)]
    found = common.Filter.of(spark.createDataFrame([(v,) for v in values], "v bigint"), 16)
    want = np.zeros(1 << 10, np.uint64)
    for v in values:
        for p in ((v % (1 << 64)) >> 48, v & 0xFFFF):
            want[p >> 6] |= np.uint64(1 << (p & 63))
    assert (found.words == want).all()
    monkeypatch.undo()
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    text = " ".join(f"w{i}" for i in range(60))
    table = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id bigint, text string")
    assert {r.id: r.component for r in simhash.similar(table).collect()} == {1: 1, 2: 1, 3: 3}
    assert len(sent) > 2 and not any(os.path.exists(b._path) for b in sent)


@pytest.mark.parametrize("segments", [8, 16])
def test_links_of_clouds_and_chains(spark, segments):
    rng = random.Random(2)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    chain = rng.getrandbits(64)
    for k in range(0, 60, 2):
        chain ^= 3 << k
        values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 1 << 63}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), segments)
    rows = pairs.collect()
    assert all((((r.a ^ r.b) % (1 << 64)).bit_count() <= 2) and r.a < r.b for r in rows)
    near = {v: {w for w in signed if ((v ^ w) % (1 << 64)).bit_count() <= 2} for v in signed}
    want = closure(signed, lambda a, b: b in near[a])
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert {v: got.get(v, v) for v in signed} == want
    assert len(rows) < 6 * len(values)


# --- 6 toxicity


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    words = rng.integers(10, 30, 500).astype(np.uint64)
    before = np.roll(words, 1)
    stems = words // np.uint64(5)
    keys, at = np.unique(np.stack([before, words, stems, stems // np.uint64(2)]), axis=1, return_inverse=True)
    y = rng.integers(0, 2, 500)
    counts = np.stack([np.bincount(at.ravel()[y == c], minlength=keys.shape[1]) for c in (0, 1)])
    per = lambda row, values: np.stack([[x[keys[row] == k].sum() for k in np.unique(keys[row])] for x in values])
    kinds, where = np.unique(keys[1], return_index=True)
    for least in (1, 2):
        some = counts.sum(0) >= least
        model = toxicity.kneser_ney((keys[1:, where], per(1, counts > 0)), (np.unique(keys[0]), per(0, counts)), (keys[:2, some], counts[:, some]))
        assert np.allclose(model.base.sum(1), 1)
        for v in np.unique(before):
            total = model.left[:, np.searchsorted(model.contexts, v)] * 1.0
            for w in kinds:
                p, found = toxicity._find(model.pairs, toxicity.pair_hash(np.array([v]), np.array([w])))
                total = total + np.where(found, model.part[:, p], 0).ravel()
            assert np.allclose(total, 1, atol=1e-5)


def test_toxicity_scores(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        words = prose(rng, rng.randint(20, 200)).split(" ")
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbler", "nastyfolk", "nastyling", "scoundrel"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.id: r.score for r in toxicity.toxicity_scores(docs, truth, common.fold_of("id", 4) != 2).collect()}
    assert len(got) == 304 and all(0 <= v <= 1 for v in got.values())
    right = [(got[k] >= 0.3) == bool(y) for k, y in labels if k in got]
    assert sum(right) / len(right) > 0.95
    one = toxicity.toxicity_scores(docs, truth.where("toxic = 0")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score < 0.1
    assert toxicity.toxicity_scores(empty, truth).count() == 0


# --- 7 language


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    scores, transitions = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    count = np.array([4, 0, 5])
    old = language.STRETCH
    try:
        for stretch in (2, 32):
            language.STRETCH = stretch
            post, _ = language.marginals(scores, transitions, count)
            for low, high in ((0, 4), (4, 9)):
                want, total = np.zeros((high - low, 3)), 0.0
                for path in itertools.product(range(3), repeat=high - low):
                    start = np.exp(transitions)[:, path[0]].mean()
                    p = start * np.exp(sum(scores[low + i, s] for i, s in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
                    total += p
                    for i, s in enumerate(path):
                        want[i, s] += p
                assert np.allclose(post[low:high], want / total)
    finally:
        language.STRETCH = old


def test_languages(spark, empty):
    rng = random.Random(8)
    kinds = {"aa": "katu mira solo tani vero luma".split(), "bb": "schrug pfelk drumb knatz wolgt brunf".split()}
    rows = [(k, " ".join(rng.choice(kinds[lang]) + rng.choice("aeiou") for _ in range(rng.randint(5, 80))), lang) for k in range(200) for lang in [("aa", "bb")[k % 2]]]
    rows += [(500, None, None), (501, "", "aa"), (502, "12 !! 34", None), (503, "schrugo " * 30_000, None), (504, "🎉", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.id: (r.lang_pred, r.score) for r in language.document_languages(docs, common.fold_of("id", 3) != 1).collect()}
    assert sum(got[k][0] == lang for k, _, lang in rows[:200]) >= 198
    assert all(got[k] == ("und", 0.0) for k in (500, 501, 502, 504)) and got[503][0] == "bb"
    mixed = language.fit_texts([t for _, t, _ in rows[:200]], [lang for _, _, lang in rows[:200]])
    post, _, _ = mixed.label_words(pa.array(["katua mirae solou schrugi pfelka knatzo"]))
    assert [mixed.labels[k] for k in post.argmax(1)] == ["aa"] * 3 + ["bb"] * 3
    assert {r.lang_pred for r in language.document_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.document_languages(empty).count() == 0


# --- 8 pieces


def library(path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, searched by Viterbi
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces_equal_the_library(texts):
    voc, lib = pieces.vocabulary(pieces.DEFAULT_MODEL), library(pieces.DEFAULT_MODEL)
    score = {i: s for i, s in voc.pieces.values()}
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    same = []
    for text in filter(None, texts.values()):
        for part in re.findall(r"[^▁]{1,60}", text)[:40]:  # short parts: the library adds in single precision
            ours, theirs = voc.encode(part), lib.encode(part)
            same.append(ours == theirs)
            assert ours == theirs or total(ours) >= total(theirs)
    assert np.mean(same) > 0.99


def test_streaming_equals_whole_search():
    rng = random.Random(3)
    toy = pieces.Vocabulary({p: (i, -float(rng.randint(1, 9))) for i, p in enumerate(["a", "b", "ab", "ba", "aab", "bab", "abba", "c", "bc", "cab"])}, list(range(20, 276)), 276)
    for n in (1, 5, 40, 400):
        text = "".join(rng.choice("abcd") for _ in range(n))
        best = [(0.0, ())] + [None] * n
        for end in range(1, n + 1):  # plain search over all piece ends, earlier starts first
            for start in range(max(0, end - 4), end):
                found = toy.pieces.get(text[start:end])
                found = found or ((-1, toy.unknown) if end - start == 1 and text[start:end] not in toy.pieces else None)
                if found and (best[end] is None or best[start][0] + found[1] > best[end][0]):
                    best[end] = (best[start][0] + found[1], best[start][1] + ((found[0],) if found[0] >= 0 else tuple(20 + b for b in text[start:end].encode())))
        assert [i for run in toy.stream(text) for i in run] == list(best[n][1])
        assert toy._short(text) == list(best[n][1])
    runs = list(toy.stream("abba" * 500))
    assert sum(map(len, runs)) and max(map(len, runs)) < 100  # committed on the way


def test_words_side_by_side(monkeypatch):
    """Words of a slice are searched together, with the ids of one search each."""
    monkeypatch.setattr(pieces, "_ABREAST", 7)
    rng = random.Random(3)
    real = pieces.Vocabulary.load(pieces.DEFAULT_MODEL)
    toy = pieces.Vocabulary({p: (i, -float(rng.randint(1, 9))) for i, p in enumerate(["a", "b", "ab", "ba", "aab", "bab", "abba", "c", "bc", "cab"])}, list(range(20, 276)), 276)
    bare = pieces.Vocabulary({}, list(range(256)), 256)
    for voc, letters in ((real, "▁theraionué.,中文\x07"), (toy, "abcabcx"), (bare, "ab")):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 20, 70, 150]))) for _ in range(150)]
        words += words[:5]
        want = [voc._short(w) for w in words]
        monkeypatch.setattr(pieces, "KEPT_WORDS", 40)
        for _ in range(2):
            assert [np.frombuffer(ids, np.int32).tolist() for ids in voc.words(words)] == want
        assert max(map(len, voc.kept), default=0) <= 64
    assert np.frombuffer(real.words([""])[0], np.int32).tolist() == [real.byte_ids[b] for b in "▁".encode()]
    assert real.words([]) == []


def test_pieces_round_trip(docs, empty, texts):
    found = pieces.encode_and_decode(docs).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert r.decoded == (texts[r.id] or "")
    back = pieces.decode(pieces.encode(docs)).collect()
    assert {r.id: r.text for r in back} == {k: t or "" for k, t in texts.items()}
    assert pieces.encode_and_decode(empty).count() == 0


# --- 9 spotsigs


@pytest.mark.parametrize("rows", [4096, 5, 1])
def test_next_document(spark, docs, empty, texts, rows):
    single = docs.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    got = {r.id: r.next for r in spotsigs.with_next(single, rows).collect()}
    order = sorted(texts, reverse=True)
    assert got == {a: texts[b] or "" for a, b in zip(order, [*order[1:], order[0]])}


def test_fingerprints(docs, empty, texts):
    got = spotsigs.fingerprints(docs).select("id", "own", "changed", spotsigs.likeness(F.col("own"), F.col("own")).alias("self")).collect()
    assert len(got) == len(texts) + 1 and {r.self for r in got} == {1.0}
    sets = {r.id: r.own for r in got}
    assert sets[1] == sets[2] == sets[3] and sets[4] == sets[5] == sets[7] == []
    assert spotsigs.fingerprints(empty).count() == 0


def test_signature_chains(spark):
    row = spark.createDataFrame([("The cat and the dog sat, of it",)], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).first()
    want = sorted(hashlib.md5(c.encode()).hexdigest()[:8] for c in ("the_cat dog", "the_dog sat"))
    assert row.s == want


def test_near_pairs(spark, empty):
    rng = random.Random(6)
    sets = []
    for k in range(60):
        base = rng.sample(range(400), rng.randint(5, 60)) if k % 4 == 0 else [x if rng.random() > 0.06 else rng.randrange(400) for x in sets[-1][1]]
        sets.append((k, sorted(set(base))))
    sets += [(100, sets[3][1]), (101, []), (102, [])]
    frame = spark.createDataFrame([(k, [f"{x:08x}" for x in s]) for k, s in sets], "id bigint, sigs array<string>")
    pairs, members = spotsigs.near_pairs(frame, 0.8)
    classes = {}
    for k, s in sets:
        classes.setdefault(tuple(s), k)
    want = {(a, b) for (s, a), (t, b) in itertools.combinations(classes.items(), 2) if s and t and len({*s} & {*t}) / len({*s} | {*t}) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == {tuple(sorted(p)) for p in want} and len(want) > 10
    assert {r.id: r["class"] for r in members.collect()} == {k: classes[tuple(s)] for k, s in sets}


# --- 10 repeats


def brute_repeats(texts, length):
    seen, out = set(), {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("most", [64, 2])
def test_repeats(docs, empty, texts, most):
    got = repeats.remove_repeats(docs, most_contexts=most, index_bytes=4000).collect()
    want = brute_repeats(texts, 100)
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.id]
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_in_stretches(docs, texts, monkeypatch):
    data = np.frombuffer((texts[13] + texts[13][:500]).encode(), np.uint8)
    whole = repeats.contexts_of(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeats, "STRETCH", 5000)
    part = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([bytes(data).decode()])], ["id", "text"])
    covered = set()
    for _, piece, off, shift in repeats._stretches(part, 100):
        _, low, high, *_ = repeats.contexts_of(piece, off)
        covered |= {shift + s for a, b in zip(low, high) for s in range(a, b + 1)}
    assert covered == {s for a, b in zip(whole[1], whole[2]) for s in range(a, b + 1)} == set(range(len(data) - 99))


def test_matching_statistics():
    rng = random.Random(4)
    for letters in ("ab", "abcdefgh"):
        text = "".join(rng.choice(letters) for _ in range(300)) + "\0" + "".join(rng.choice(letters) for _ in range(150)) + "\0"
        index = repeats.RunIndex(np.array([0 if c == "\0" else ord(c) for c in text]))
        pats = [text[20:90] + "".join(rng.choice(letters + "z") for _ in range(30)), "".join(rng.choice(letters) for _ in range(100))]
        found = index.matching_statistics(np.array([[ord(c) for c in p] for p in pats], np.int16))
        for p, row in zip(pats, found):
            for i in range(len(p)):
                longest = max(k for k in range(len(p) - i + 1) if p[i : i + k] in text)
                assert row[i] == longest


def test_whole_characters(spark):
    body = "é" * 200
    docs = spark.createDataFrame([(1, body), (2, "x" + body), (3, "a" + "日本" * 80), (4, "b" + "日本" * 80)], "doc_id bigint, text string")
    got = {r.id: bytes(r.kept).decode() for r in repeats.remove_repeats(docs, whole_characters=True).collect()}
    assert got[1] != "" and got[2] == "x" and got[4] == "b"


# --- what earlier rounds found wanting


def test_repeated_long_rows_stay_apart_over_several_blocks(spark):
    """Rows that fill a segment each, with one id and one text, are rows of their own however many blocks there are."""
    long = "alpha beta gamma delta " + "filler " * 160_000
    docs = spark.createDataFrame([(7, long), (7, long), (8, long), (9, "no hit")], "doc_id bigint, text string").repartition(2)
    items = spark.createDataFrame([(k, p) for k, p in enumerate(["alpha beta", "beta gamma", "gamma delta", "absent words", "filler filler filler"])], "item_id bigint, text string")
    one, many = (sorted(map(tuple, decontaminate.contamination(docs, items, most=most).collect()), key=str) for most in (1000, 2))
    assert one == many and len(one) == 4
    assert [r[0] for r in one] == [7, 7, 8, 9] and one[0][4] == ["0", "1", "2", "4"] and one[3][4] == []


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(2)
    far = lambda n: " ".join(rng.choice(["kuu", "yö", "tähti", "talvi", "metsä"]) for _ in range(n))
    near = lambda n: " ".join(rng.choice(["lune", "nuit", "étoile", "hiver", "forêt"]) for _ in range(n))
    rows = [(k, far(4000), "fi") for k in range(12)] + [(k, near(60), "fr") for k in range(12, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.id: r.lang_pred for r in language.document_languages(docs, longest=2000).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_window_hashes_are_independent():
    data = np.random.default_rng(0).integers(0, 256, 400).astype(np.uint8)
    at = np.arange(300)
    one, two = (common.PrefixHash(data, *base).of(at, at + 100) for base in ((), (common.SECOND_BASE,)))
    assert len(set((one + two).tolist())) == len(set((one ^ two).tolist())) == 300
    assert np.abs(np.corrcoef(one.astype(float), two.astype(float))[0, 1]) < 0.2


def test_segment_counts_bound_the_difference():
    rng = random.Random(4)
    texts = [prose(rng, 300)]
    for _ in range(30):
        words = texts[-1].split()
        for _ in range(6):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    hashes, owner, size, _ = simhash.shingle_sets(pa.array(texts), 5)
    counts = simhash.segment_counts(hashes, owner, len(texts)).astype(int)
    sets = [set(hashes[owner == k].tolist()) for k in range(len(texts))]
    assert counts.sum(1).tolist() == [len(s) for s in sets] == size.tolist()
    for a in range(len(texts)):
        for b in range(a):
            assert np.abs(counts[a] - counts[b]).sum() <= len(sets[a] ^ sets[b])


def brute_kneser_ney(pairs, stems=(5, 4), d=0.75):
    """p(word | before) of each class, level by level from dictionaries; ``pairs`` is one Counter per class."""
    names = lambda w: [w.encode()[:k] for k in reversed(stems)] + [w.encode()]
    words = {w for p in pairs for _, w in p}
    seen = [{w: len({v for v, x in p if x == w}) for w in words} for p in pairs]
    depth = len(stems) + 1
    level = [{w: names(w)[i] for w in words} for i in range(depth)]
    parent = [{} for _ in range(depth)]
    for w in words:
        for i in range(1, depth):
            parent[i][level[i][w]] = level[i - 1][w]
    kinds = [sorted({level[i][w] for w in words}) for i in range(depth)]
    counts = [[{k: sum(seen[c][w] for w in words if level[i][w] == k) for k in kinds[i]} for c in range(2)] for i in range(depth)]
    shared = [{k: counts[i][0][k] + counts[i][1][k] + 1 for k in kinds[i]} for i in range(depth)]
    total = sum(shared[0].values())
    prob = [{k: shared[0][k] / total for k in kinds[0]} for _ in range(2)]
    for i in range(depth):
        if i:
            up = {}
            for k in kinds[i]:
                up[parent[i][k]] = up.get(parent[i][k], 0) + shared[i][k]
            prob = [{k: prob[c][parent[i][k]] * shared[i][k] / up[parent[i][k]] for k in kinds[i]} for c in range(2)]
        new = []
        for c in range(2):
            n = sum(counts[i][c].values())
            kept = sum(v > 0 for v in counts[i][c].values())
            new.append({k: (max(counts[i][c][k] - d, 0) + d * kept * prob[c][k]) / n for k in kinds[i]})
        prob = new

    def of(c, v, w):
        n = sum(m for (a, _), m in pairs[c].items() if a == v)
        base = prob[c][w.encode()]
        if not n:
            return base
        kinds_after = [m for (a, _), m in pairs[c].items() if a == v]
        return max(pairs[c].get((v, w), 0) - d, 0) / n + (1 - sum(max(m - d, 0) for m in kinds_after) / n) * base

    return of


def test_kneser_ney_by_plain_python():
    from collections import Counter

    rng = random.Random(12)
    texts = [prose(rng, 40) for _ in range(12)]
    pairs = [Counter(), Counter()]
    for k, text in enumerate(texts):
        words = SQL_WORD.findall(text)
        pairs[k % 2].update(zip(["", *words], words))
    every = sorted(set(pairs[0]) | set(pairs[1]))
    levels, before, _, _ = toxicity.word_pairs(pa.array(texts))
    name = {}
    for text, (a, b) in zip(texts, itertools.pairwise(np.concatenate([[0], np.cumsum([len(SQL_WORD.findall(t)) for t in texts])]))):
        words = SQL_WORD.findall(text)
        for v, w, i in zip(["", *words], words, range(a, b)):
            name[v, w] = (before[i], levels[:, i])
    n = np.array([[p[e] for e in every] for p in pairs])
    v, lv = np.array([name[e][0] for e in every]), np.stack([name[e][1] for e in every], 1)
    word, first, at = np.unique(lv[0], return_index=True, return_inverse=True)
    context, of = np.unique(v, return_inverse=True)
    model = toxicity.kneser_ney(
        (lv[:, first], np.stack([np.bincount(at, weights=(x > 0), minlength=len(word)) for x in n]).astype(np.int64)),
        (context, np.stack([np.bincount(of, weights=x, minlength=len(context)) for x in n]).astype(np.int64)),
        (np.stack([v, lv[0]]), n),
    )
    want = brute_kneser_ney(pairs)
    asked = every + [(a, w) for a, _ in every[::7] for _, w in every[::11]]
    got = model.ratios(np.stack([name[next(e for e in every if e[1] == w)][1] for _, w in asked], 1), np.array([name[next(e for e in every if e[0] == a)][0] for a, _ in asked]))
    assert np.allclose(got, [np.log(want(0, *e)) - np.log(want(1, *e)) for e in asked], atol=1e-5)


def test_toxicity_and_language_of_awkward_rows(spark, docs, texts, empty):
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0), "id", 0.5) for k in texts] * 2, "doc_id bigint, quality int, toxic int, id string, score double")
    for found in (toxicity.toxicity_scores(docs, labels), language.document_languages(docs)):
        rows = [tuple(r) for r in found.collect()]
        assert sorted(r[0] for r in rows) == sorted([*texts, 2]) and all(0 <= r[-1] <= 1 for r in rows)
        assert len({(*r[:-1], round(r[-1], 9)) for r in rows if r[0] == 2}) == 1  # repeated rows alike
    assert toxicity.toxicity_scores(docs, labels.where("false")).select("score").distinct().count() == 1


def test_near_matches_by_plain_python(spark):
    rng = random.Random(6)
    vocabulary = "one two three four five six seven eight".split()
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(3, "one two three"), (61, None), (62, "two one three")]
    items = [("a", "one two three four"), ("b", "eight one one"), ("c", "four five six seven eight one two three four five six one"), ("d", ""), ("e", "absent one"), ("a", "six seven")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    phrases = decontaminate.test_phrases(spark.createDataFrame(items, "item_id string, text string"))
    index = common.stored(decontaminate.build_index(docs), "near-index")
    for within in (3, 5, 9):
        want = []
        for doc, text in rows:
            words = (text or "").split()
            found = {}
            for item, phrase in items:
                own = phrase.split()
                for i in range(max(1, len(own) - 9) if own else 0):
                    terms = set(own[i : i + 10])
                    for p, w in enumerate(words):
                        if w in terms and terms <= set(words[p : p + within]):
                            found.setdefault(item, set()).add(p)
            want += [(doc, item, sorted(p)) for item, p in found.items()]
        for most in (1000, 2):
            got = [(r.doc_id, r.item, r.places) for r in decontaminate.near_matches(index, phrases, within, most).collect()]
            assert sorted(got) == sorted(want) and want
    none = decontaminate.test_phrases(spark.createDataFrame([], "item_id string, text string"))
    assert decontaminate.near_matches(index, none, 5).count() == 0
