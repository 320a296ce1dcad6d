"""Collocations against plain Python, also with fingerprints so short that phrases share them."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rolefunnel.llm import collocations, common

SCHEMA = "text string, lang string, doc_id bigint, phrase string, words int, h string, n int, doc string"


def brute(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    cands = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in cands.items():
        if (lang, w) in longer and 100 * longer[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for lang, rows in out.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(None, "en"), ("", None), (" \t\n", "en"), ("!!!", "de"), ("New York. new york; NEW YORK", None)]
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(["the cat sat", "new york city", "of the", "Ünder", "été", "a", "b", "new york", "x\x1cy", "日本 語"]))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for w in words)
        out.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    out += [(out[20][0], "en")] * 30 + [("a b " * 20_000, "de")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(t, la, None if k % 9 == 0 else k % 40, "p", 1, "h", 2, "d") for k, (t, la) in enumerate(rows)], SCHEMA).repartition(6)


@pytest.mark.parametrize(("least", "longest", "top", "bits"), [(30, 4, 2000, 64), (2, 4, 25, 64), (5, 3, 2000, 64), (3, 4, 40, 9), (30, 4, 2000, 5)])
def test_collocations(docs, rows, least, longest, top, bits):
    got = [tuple(r) for r in collocations.collocations(docs, least=least, longest=longest, top=top, bits=bits).collect()]
    assert set(got) == brute(rows, least, longest, top) and len(got) == len(set(got))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("one two", "en", 1, "p", 1, "h", 2, "d")], SCHEMA)).count() == 0


def test_filter_holds_every_member(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    for bits in (8, 16, 27):
        found = common.Filter.of(spark.createDataFrame([(int(v),) for v in values], "v bigint"), bits)
        assert found.has(values.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)
    assert found.has(others).mean() < 0.01
    assert len(found.words) == 1 << 21


def test_short_fingerprints_of_spark_and_numpy_agree(spark):
    from pyspark.sql import functions as F

    got = spark.range(100).select(F.xxhash64("id").alias("x")).toPandas().x.to_numpy().view(np.uint64)
    assert (collocations.spread(np.arange(100, dtype=np.uint64), 9) == got).all()
