"""The manifest and the rule ledger against plain Python, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolefunnel.llm import ledger, merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, pos int, digest string, id int, failed int, n_words int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold(nodes, fanout):
    """Root and the steps of every node."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            low = a - a % fanout
            steps[i].append(("".join(nodes[low:a]), "".join(nodes[a + 1 : low + fanout])))
            at[i] = a // fanout
        nodes = [h("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], steps


def manifest(rows, fanout):
    trees = {}
    for r in rows:
        digest = leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, digest))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = [fold([d for *_, d in sorted(trees[x])], fanout) for x in langs]
    root, upper = fold([r for r, _ in lower], fanout)
    out = []
    for lang, (sub, steps), tail in zip(langs, lower, upper):
        out += [(i if known else None, d, sub, root, tuple(s + tail)) for (known, i, d), s in zip(sorted(trees[lang]), steps)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, n, "tree", 1, "digest", 2, 3, 4) for i, t, la, s, n in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(k, f"text {k} é日", "en" if k % 3 else "de", "s" if k % 5 else None, k) for k in rng.sample(range(-50, 1000), 150)]
    out += [(5001, "ties", "fr", "s", 1)] * 4 + [(5001, "other", "fr", "s", 1)]  # repeated rows, one id
    out += [(None, None, None, None, None), (None, "", None, "", 0), (7000, "x" * 200_000, "", "s", None), (7001, None, "zä", "s", 2)]
    return out


@pytest.mark.parametrize(("fanout", "depth"), [(2, 4), (2, 1), (3, 2), (5, 1)])
def test_manifest(spark, rows, fanout, depth):
    docs = table(spark, rows)
    found = merkle.manifest(docs, fanout=fanout, depth=depth)
    found = found.withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof(F.col("path"))).collect()
    want = manifest([r.asDict() for r in docs.collect()], fanout)
    got = [(r.id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in found]
    assert Counter(got) == Counter(want)
    assert all(r.again == r.root and r.claimed is None for r in found)
    assert all(r.proof == h("".join(a + b for a, b in p)) for r, (*_, p) in zip(found, got))


def test_tampering_is_found_and_only_there(spark, rows):
    docs = table(spark, rows)
    changed = F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, claimed={"n_chars": changed}).withColumn("again", merkle.fold(F.coalesce("claimed", "leaf"), F.col("path"))).collect()
    known = {r[0]: r for r in rows}
    for r in found:
        touched = r.id is not None and r.id % 7 == 0 and known[r.id][4] is not None
        assert (r.again != r.root) == touched == (r.claimed is not None)
    assert {r.root for r in found} == {r.root for r in merkle.manifest(docs).select("root").distinct().collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17, 33])
def test_small_trees(spark, n):
    rows = [(k, "t", "en", "s", k) for k in range(n)]
    found = merkle.manifest(table(spark, rows) if n else spark.createDataFrame([], SCHEMA)).collect()
    want = manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], 2) if n else []
    assert sorted((r.id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in found) == sorted(want)


def test_crc_of_negative_ids(spark):
    from rolefunnel.llm.common import fold_of

    got = spark.createDataFrame([(-5,), (12,)], "doc_id bigint").select("doc_id", fold_of("doc_id", 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in got)


# --- ledger


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = [None, "", " \t\n", "\n", "a\n a\na\n\na", "a " * 9, "a b " * 8 + "\x0b#|x", "x\r\nx\r\nx", "é#日 " * 30, "one\x1ctwo", "line\n" * 50, "a" * 100_000]
    for _ in range(60):
        words = [rng.choice(["to", "be", "or", "#", "not<>", "Übung", "日本"]) for _ in range(rng.randint(1, 90))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t ", "  "]) for w in words)
        out.append(text * rng.choice([1, 1, 2]))
    out.append(" ".join(f"w{k % 9000}" for k in range(20_000)))
    return out


def test_measurements(spark, texts):
    docs = table(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "no id", "en", "s", 1)])
    found = ledger.ledger(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = "no id" if r.id is None else texts[r.id]
        assert tuple(r[m] for m in ledger.MEASURES) == measured(text), text
        n, chars, symbols, lines, dup, again = measured(text)
        assert bool(r.failed & 1) == (n < 20) and bool(r.failed & 2) == (100 * again > 30 * n) and bool(r.failed & 4) == (10 * symbols > chars)
    assert ledger.ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def test_policies_and_ablations(spark, texts):
    found = ledger.ledger(table(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]))
    rows = found.collect()
    of = {r.name: r.value for r in ledger.RULES}
    for p in ledger.ablations(found).collect():
        names = ledger.POLICIES[p.policy]
        fails = [{n for n in names if r.failed & of[n]} for r in rows]
        assert (p.n_docs, p.n_kept, p.n_failed) == (len(rows), fails.count(set()), sum(p.rule in f for f in fails))
        assert p.n_decisive == fails.count({p.rule}) and p.n_kept_without == sum(not f - {p.rule} for f in fails)
    old, new = ledger.POLICIES["1"], ledger.POLICIES["3-strict"]
    got = {(r.kept_before, r.kept_now): r.n for r in ledger.changes(found, old, new).collect()}
    keep = lambda r, names: not any(r.failed & of[n] for n in names)
    assert got == Counter((keep(r, old), keep(r, new)) for r in rows)
    for r in found.select("failed", ledger.decisive(new).alias("one")).collect():
        fails = [n for n in new if r.failed & of[n]]
        assert r.one == (fails[0] if len(fails) == 1 else None)


def test_rules_need_bits_of_their_own(spark):
    with pytest.raises(ValueError, match="bit"):
        ledger.ledger(spark.createDataFrame([], SCHEMA), rules=(ledger.Rule("a", 1, "true"), ledger.Rule("b", 1, "true")))
