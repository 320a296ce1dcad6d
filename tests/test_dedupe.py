"""Fuzzy de-duplication against a sequential scan written in plain Python."""

import random
import time
from difflib import SequenceMatcher

from rolefunnel.operators import dedupe as d
from rolefunnel.operators.rare_parts import part_entries

DDL = (
    "ord bigint, title string, company string, description string, url string, source string, "
    "source_id string, tags array<string>"
)


def rows_for(seed: int, n: int):
    rng = random.Random(seed)
    companies = ["Acme", "Acme Inc", "Acmee Ltd", "Globex", "Globex Corp", "Initech", ""]
    roles = ["Sr Data Engineer", "Senior Data Engineer", "Data Engineer", "Data Engineer II",
             "Backend Engineer", "Backend Engineers", "Jr Backend Engineer", "ML Ops", "a", ""]
    sources = ["remoteok", "remotive", "jobicy", "himalayas"]
    rows = []
    for i in range(n):
        url = rng.choice(["", f"https://x.io/{i}", f"http://www.x.io/{i}/", f"https://x.io/{rng.randrange(n)}?q=1"])
        rows.append((i, rng.choice(roles), rng.choice(companies), "d" * rng.randrange(6), url,
                     rng.choice(sources), rng.choice([None, f"{i}:lever:{i}", str(i)]),
                     rng.sample(["x", "y", "z"], rng.randrange(3))))
    return rows


def key(company, title):
    words = company.lower().split()
    c = " ".join(w for w in words if w not in d.COMPANY_SUFFIXES)
    t = [d.TITLE_ABBREVIATIONS.get(w, w) for w in title.lower().split()]
    return c, " ".join([c] + t)


def norm(url):
    if not url:
        return ""
    host, _, path = url.split("://", 1)[1].partition("/")
    path = path.split("?")[0].rstrip("/")
    return "https://" + host.removeprefix("www.") + ("/" + path if path else "")


def sequential(rows):
    """First-match scan; a kept row keeps being compared by its first member."""
    kept, by_url = [], {}
    for r in rows:
        o, title, company, desc, url, source, sid, tags = r
        c, k = key(company, title)
        own_id = source in d.UNIQUE_ROLE_SOURCES or ":lever:" in (sid or "")
        u = norm(url)
        hit = by_url.get(u) if u else None
        if hit is None:
            for i, kr in enumerate(kept):
                if (source == kr["source"] and own_id and kr["own_id"]) or not (c and kr["c"]):
                    continue
                if SequenceMatcher(None, c, kr["c"]).ratio() < 0.5:
                    continue
                if SequenceMatcher(None, k, kr["k"]).ratio() >= 0.88:
                    hit = i
                    break
        if hit is None:
            kept.append(dict(c=c, k=k, source=source, own_id=own_id, ords=[o], rows=[r]))
            hit = len(kept) - 1
            if u:
                # Only a kept row stands for its URL.
                by_url[u] = hit
        else:
            kept[hit]["ords"].append(o)
            kept[hit]["rows"].append(r)
    out = {}
    for kr in kept:
        best = max(kr["rows"], key=lambda r: (len(r[3]), -r[0]))
        tags = best[7] if len(kr["rows"]) == 1 else sorted({t for r in kr["rows"] for t in r[7]})
        out[min(kr["ords"])] = (best[1], best[2], best[3], tuple(tags))
    return out


def test_dedupe_equals_sequential_scan(spark):
    for seed in (1, 2):
        rows = rows_for(seed, 160)
        df = spark.createDataFrame(rows, DDL)
        got = {r["ord"]: (r["title"], r["company"], r["description"], tuple(r["tags"])) for r in d.dedupe(df).collect()}
        assert got == sequential(rows)


def test_dedupe_in_turns_equals_sequential_scan(spark, monkeypatch):
    monkeypatch.setattr(d, "TURN_NODES", 10)
    written, cut = [], d.cut_lineage
    monkeypatch.setattr(d, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    rows = rows_for(3, 60)
    got = {r["ord"]: (r["title"], r["company"], r["description"], tuple(r["tags"])) for r in d.dedupe(spark.createDataFrame(rows, DDL)).collect()}
    assert got == sequential(rows)
    assert sum("a_full_key" in columns for columns in written) > 2


def test_candidates_lose_no_pair(spark):
    rng = random.Random(7)
    words = ["data", "dota", "engine", "engineer", "senior", "acme", "acne", "x", "go", "lead"]
    keys = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(250)} | {"a", "b", "ab"})
    nodes = spark.createDataFrame([(None, "c", k, i) for i, k in enumerate(keys)],
                                  "src string, company_key string, full_key string, node bigint")
    for threshold in (0.88, 0.7):
        got = {(r.a, r.b) for r in d.fuzzy_pairs(nodes, threshold, 0.0).collect()}
        want = {(i, j) for i in range(len(keys)) for j in range(i)
                if SequenceMatcher(None, keys[i], keys[j]).ratio() >= threshold}
        assert got == want


def test_key_precedence(spark):
    df = spark.createDataFrame(
        [("https://www.A.io/x/?q#f", "s", "1", "t"), ("", "s", "1", "t"), ("", "s", "", "t"), ("", "s", None, "t")],
        "url string, source string, source_id string, title string")
    got = [r[0] for r in d.with_dedup_key(df).select("dedup_key").collect()]
    assert got == ["https://a.io/x", "s:1", "s:t", "s:t"]


def test_exact_dedupe_keeps_rows_without_url(spark):
    rows = [(0, "t", "c", "aa", "https://a.io/x", "s", "1", ["z", "b"]),
            (1, "t", "c", "aaa", "http://www.a.io/x/", "s", "2", ["a"]),
            (2, "u", "c", "", "", "s", "3", ["q", "p"]), (3, "u", "c", "", "", "s", "3", [])]
    got = d.exact_dedupe(spark.createDataFrame(rows, DDL)).orderBy("ord").collect()
    assert [(r["ord"], r["description"], r["tags"]) for r in got] == [
        (0, "aaa", ["a", "b", "z"]), (2, "", ["q", "p"]), (3, "", [])]


def test_a_third_of_all_rows_is_one_posting(spark):
    rows = [(i, "Data Engineer", "Acme", "d" * (i % 9), f"https://x.io/{i % 2000}", "remoteok", None, [f"t{i % 3}"])
            for i in range(3000)]
    rows += [(i, f"{chr(97 + i % 26) * 8} {i}", f"{chr(97 + i % 23) * 9}{i}", "d", "", "remoteok", str(i), []) for i in range(3000, 3100)]
    got = {r["ord"]: r for r in d.dedupe(spark.createDataFrame(rows, DDL)).filter("company = 'Acme'").collect()}
    assert set(got) == {0}
    assert got[0]["description"] == "d" * 8 and got[0]["tags"] == ["t0", "t1", "t2"]


def test_a_merged_row_does_not_hand_its_url_on(spark):
    rows = [(0, "Senior Data Engineer", "Acme", "", "https://x.io/a", "s", None, []),
            (1, "Senior Data Engineers", "Acme", "", "https://x.io/b", "s", None, []),
            (2, "Warehouse Cook", "Zeta", "", "https://x.io/b", "s", None, []),
            (3, "Gardener", "Zeta Parks", "", "https://x.io/b", "s", None, [])]
    got = {r["ord"]: r["title"] for r in d.dedupe(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {0: "Senior Data Engineer", 2: "Warehouse Cook"}


def test_similar_keys_share_an_entry_and_others_seldom_meet(spark):
    rng = random.Random(11)
    syllables = ["th", "he", "an", "er", "on", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", " ", " "]
    keys = []
    for _ in range(150):
        key = ("en " + "".join(rng.choice(syllables) for _ in range(60)))[:80].strip()
        keys.append(key)
        # Characters put in and taken out, as many as the ratio allows or a few less.
        loose = list(key)
        for _ in range(rng.randrange(1, 9)):
            del loose[rng.randrange(len(loose))]
            loose.insert(rng.randrange(len(loose)), rng.choice("theano"))
        keys.append("".join(loose))
    keys = sorted(set(keys))
    nodes = spark.createDataFrame([(None, "c", k, i) for i, k in enumerate(keys)],
                                  "src string, company_key string, full_key string, node bigint")
    longer, shorter = part_entries(nodes, 0.88)
    met = longer.join(shorter.select("key", shorter["node"].alias("other")), "key").filter("node != other")
    # All parts of four characters, looked up in all places that a part may have moved to, met more than once per pair.
    assert met.count() < len(keys) ** 2 / 2 * 0.25
    got = {(r.a, r.b) for r in d.fuzzy_pairs(nodes, 0.88, 0.0).collect()}
    want = {(i, j) for i in range(len(keys)) for j in range(i) if SequenceMatcher(None, keys[i], keys[j]).ratio() >= 0.88}
    assert got == want and len(want) > 50


def keyed(spark, keys):
    return spark.createDataFrame([(None, "c", k, i) for i, k in enumerate(keys)], "src string, company_key string, full_key string, node bigint")


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_entries_in_turns_lose_no_pair_and_leave_no_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    words = ["data", "dota", "engine", "engineer", "senior", "acme", "acne", "x", "go", "lead"]
    keys = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(150)})
    nodes = d.cut_lineage(keyed(spark, keys))
    whole = sorted(map(tuple, d.candidate_pairs(nodes).collect()))
    monkeypatch.setattr(d, "TURN_NODES", 50)
    written, cut = [], d.cut_lineage
    monkeypatch.setattr(d, "cut_lineage", lambda df: written.append((shuffle_files(spark), cut(df))) or written[-1][1])
    found = d.candidate_pairs(nodes)
    assert len(written) == 3
    # Executors delete files when they are told to, a moment later.
    until = time.monotonic() + 20
    while shuffle_files(spark) - written[0][0] and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - written[0][0]
    assert sorted(map(tuple, found.collect())) == whole and len(whole) > 5
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_sides_tell_large_counts_apart(spark):
    _, shorter = part_entries(keyed(spark, ["e" * 40]), 0.88)
    # Capped at four, all places from the fourth on looked alike; now those that are up to four apart differ by as many bits.
    codes = {(r.before_0, r.before_1) for r in shorter.select("before_0", "before_1").collect()}
    assert len(codes) == 8
