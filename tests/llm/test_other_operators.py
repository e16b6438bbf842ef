import hashlib
import math
import random
import re
from datetime import datetime, timezone
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import chat_trees, hnsw_dedup, url_rules, warc_revisit

# --- revisits

RECORDS = "record_id long, url string, ts timestamp, is_revisit boolean, headers map<string,string>, status string, bucket string"


def second(n):
    return None if n is None else datetime.fromtimestamp(n, timezone.utc)


def records(spark, rows):
    return spark.createDataFrame([(i, u, second(t), v, h, "x", "y") for i, u, t, v, h in rows], RECORDS)


@pytest.mark.parametrize("bucket", [3600, 10])
def test_revisits_against_brute_force(spark, bucket):
    rng = random.Random(9)
    urls = ["http://a.com/x", "https://www.A.com/x/", "http://a.com:80/x#f", "http://b.org/?b=1&utm_q=2&a=0", "http://b.org?a=0&b=1", "nope", None]
    canon = ["a.com/x"] * 3 + ["b.org?a=0&b=1"] * 2 + [None, None]
    rows = []
    for i in range(150):
        u = rng.randrange(7)
        rows.append((i, urls[u], rng.choice([None, *range(0, 90)]), rng.choice([True, False, None]), rng.choice([None, {}, {"ETag": 'W/"1"'}, {"etag": '"1"'}, {"ETAG": '"2"', "Last-Modified": "t"}, {"last-modified": "t", "X": "1"}, {"last-modified": "u"}])))
    got = {r.record_id: r for r in warc_revisit.resolve(records(spark, rows), bucket).collect()}
    of = dict(zip(urls, canon, strict=True))
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, u, t, v, h in rows:
        if not v:
            assert i not in got
            continue
        before = [r for r in rows if not r[3] and of[u] is not None and of[r[1]] == of[u] and t is not None and r[2] is not None and r[2] < t]
        full = max(before, key=lambda r: (r[2], r[0]), default=None)
        assert got[i].response_id == (full and full[0])
        a, b = low(h), low(full[4]) if full else {}
        if full is None:
            want = "no-response"
        elif "etag" in a and "etag" in b:
            want = "etag" if a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/") else "mismatch"
        elif "last-modified" in a and "last-modified" in b:
            want = "last-modified" if a["last-modified"] == b["last-modified"] else "mismatch"
        else:
            want = "unchecked"
        assert got[i].status == want and got[i].headers == (None if want in ("no-response", "mismatch") else b | a)


def test_body_fields_stay(spark):
    full = {"Content-Type": "text/html", "Content-Length": "9", "Date": "old", "Keep": "me"}
    again = {"content-length": "0", "content-type": "x/y", "date": "new", "Connection": "close"}
    r = warc_revisit.resolve(records(spark, [(1, "http://h/", 1, False, full), (2, "http://h", 2, True, again), (3, "http://h", 1, True, {})])).orderBy("record_id").collect()
    assert r[0].headers == {"content-type": "text/html", "content-length": "9", "date": "new", "keep": "me"} and r[1].status == "no-response"
    assert warc_revisit.resolve(records(spark, [])).count() == 0


# --- embeddings


def brute_links(rows, least=0.98):
    good = []
    for i, (k, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, k, np.array(v, float), label))
    n, parent = [0] * len(rows), {k: k for k, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, k, v, x) in enumerate(good):
        for j, m, w, y in good[:a]:
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                n[i] += 1
                n[j] += 1
                lo, hi = sorted((root(k), root(m)))
                parent[hi] = lo
    return sorted((k, n[i], root(k)) for i, (k, _, _) in enumerate(rows))


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.4])).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(450, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(460, None, 1), (461, [0.0] * 16, 1), (462, [float("nan")] + [1.0] * 15, 1), (463, [None] + [1.0] * 15, 1), (464, rows[0][1], None), (465, [1e300] * 16, 1), (466, [1e-300] * 16, 1), (467, [1.0] * 15, 1), (468, [], 1), (469, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, component_id string")
    got = hnsw_dedup.near_duplicates(df, shard=64, queries=100).collect()
    safe = [(k, None if v is None else [x * 1e-300 if k == 465 else x * 1e300 if k == 466 else x for x in v] if k in (465, 466) else v, x) for k, v, x in rows]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(safe)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_nothing_and_without_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in hnsw_dedup.near_duplicates(df).collect() if r.vec_id) == [(3, 1, 3, True)]
    assert hnsw_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_graphs():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 24)), 25, axis=0) + rng.normal(size=(1500, 24)) * 0.08
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b, report = hnsw_dedup.search(x, x, 0.98, np.arange(1500), audit=64)
    want = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.98)), strict=True))
    assert len(want & set(zip(a.tolist(), b.tolist(), strict=True))) / len(want) > 0.99
    assert report["audited"] == 64 and report["wanted"] > 0 and report["recall"][-1] == 1
    alone = hnsw_dedup.search(np.eye(24), np.eye(24), 0.98, np.arange(24))[2]
    assert (alone["wanted"], alone["recall"]) == (0, [])


def test_audits_are_reported(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) if i % 3 else np.ones(8) + rng.normal(size=8) * 0.02).tolist(), i % 2) for i in range(600)]
    out, audits = hnsw_dedup.with_audits(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=100, queries=200)
    got = audits.collect()
    assert out.count() == 600 and len(got) >= 6 and all(r.audited > 0 and (r.recall[-1] == 1 if r.wanted else not r.recall) for r in got) and sum(r.wanted for r in got) > 0


def test_graphs_survive_packing():
    x = np.random.default_rng(1).normal(size=(300, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw_dedup.Graph(x)
    packed = hnsw_dedup.Graph.unpack(*(g.pack()[k] for k in ("sizes", "x", "names", "near")))
    for a, b in zip(g.within(x, 0.7, 32), packed.within(x, 0.7, 32), strict=True):
        assert all((p == q).all() for p, q in zip(a, b, strict=True))


# --- URL rules


def test_given_rules(spark):
    urls = ["http://a.com/", "http://a.com", "https://WWW.Example.COM/en/1", "http://x.example.com/en/", "http://example.com/en", "http://xexample.com/en/", "ftp://n.net/es/?q#f", "http://net/fr/", "//a.com/", None, "", "http://h.net/a/es/", "http://com/"]
    r = {x.page_id: x for x in url_rules.judge(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [r[i].rule for i in range(len(urls))] == ["com/", None, "www.example.com/en/", "example.com/en/", "com/", "com/", "net/es/", "net/fr/", None, None, None, None, "com/"]
    assert (r[2].host, r[2].path, r[9].host, r[9].path, r[6].path) == ("www.example.com", "/en/1", "", "", "/es/") and {x.verdict for x in r.values()} == {"allow", "block"}
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_rules(rows, least, confidence):
    """Rules of single tokens and of sets of them, each minimal, from (tokens, verdict)."""
    frequent = [x for x in sorted({x for t, _ in rows for x in t}) if sum(x in t for t, _ in rows) >= least]
    rules = {}
    for n in range(1, len(frequent) + 1):
        for items in combinations(frequent, n):
            met = [v for t, v in rows if set(items) <= set(t)]
            for verdict in set(met):
                both = met.count(verdict)
                if both >= least and both / len(met) >= confidence:
                    if not any(set(x) < set(items) and v == verdict and c >= both / len(met) for (x, v), c in rules.items()):
                        rules[items, verdict] = both / len(met)
    return rules


def test_mined_rules_against_enumeration(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        t = rng.sample(["a", "b", "c", "d"], rng.randrange(1, 4))
        t += ["a2"] if "a" in t else []
        rows.append((t, "block" if "a" in t and "b" in t or ("d" in t and rng.random() < 0.95) else "allow"))
    rules = url_rules.mine(spark.createDataFrame([*rows, (None, "block"), ([], "block"), (["a"], None)], "tokens array<string>, verdict string"), 0.02, 0.9)
    got = {}
    for items, verdict, confidence in rules:
        for one in product(*items):
            got[tuple(sorted(one)), verdict] = pytest.approx(confidence)
    assert got == brute_rules(rows, 6, 0.9) and any(len(x) == 2 for items, _, _ in rules for x in items)
    assert url_rules.mine(spark.createDataFrame([], "tokens array<string>, verdict string")) == []


def test_long_urls_are_mined_in_little_time(spark):
    long = "http://h.com/" + "/".join(f"s{i}" for i in range(60))
    urls = [long] * 12 + [f"http://x.net/es/{i}" for i in range(20)] + [f"http://y.com/{i}?id=1" for i in range(9)] + ["http://q.org/s3/s4", "http://y.org/?id=2"]
    got = url_rules.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in got}[41] == "allow" and len(got) == len(urls)


def test_whole_verdict_against_brute_force(spark):
    rng = random.Random(12)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'b', 'www', 'Shop'])}.{rng.choice(['x', 'y'])}.{rng.choice(['com', 'net', 'net', 'org', 'de'])}/{rng.choice(['es', 'fr', 'en', 'Es'])}/{rng.choice(['1', 'item', 'a.html'])}{rng.choice(['', '?id=3', '?q&id=1', '#f'])}" for _ in range(260)]
    urls += [None, "", "no url", "x\n://A.com/p", "x\n://A.org/p\nq?r", urls[0], urls[0]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    split = lambda u: (lambda m: (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", ""))(re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or ""))
    tokens = {r.page_id: r.t for r in df.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    given = {}
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        given[i] = max(fits, default=(0, None, None))[1:]
    labelled = [(tokens[i], v) for i, (_, v) in given.items() if v and tokens[i]]
    rules = brute_rules(labelled, max(3, math.ceil(0.02 * len(labelled))), 0.9)
    for r in url_rules.judge(df, min_support=0.02).collect():
        rule, verdict = given[r.page_id]
        best = max(((c, len(x), v) for (x, v), c in rules.items() if set(x) <= set(tokens[r.page_id])), default=(0, 0, "allow"))[2]
        assert ((r.host, r.path), r.rule, r.verdict) == (split(urls[r.page_id]), rule, verdict or best)


# --- chat trees


def test_paths_of_trees_against_enumeration(spark):
    rng = random.Random(8)
    rows = []
    for tree in range(12):
        for i in range(rng.randrange(1, 14)):
            rows.append((tree, i, rng.choice([None, *range(i)]) if i else None, rng.choice([None, 0.5, 1.0, 2.0])))
    rows.append((99, 0, 77, 1.0))
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, score double")
    got = {}
    for r in chat_trees.best_paths(df, per_tree=2).collect():
        got.setdefault((r.tree_id, r.path), []).append((r.depth, r.msg_id))
    want = {}
    for tree in {r[0] for r in rows}:
        own = {m: (p, s or 0.0) for t, m, p, s in rows if t == tree}
        leaves = []
        for m in own:
            if not any(p == m for p, _ in own.values()):
                path, at = [], m
                while at in own:
                    path.append(at)
                    at = own[at][0]
                leaves.append((-sum(own[x][1] for x in path) / len(path), -len(path), m, path[::-1]))
        for k, leaf in enumerate(sorted(leaves)[:2]):
            want[tree, k + 1] = list(enumerate(leaf[3], 1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_cycles_and_repeats(spark):
    ring = [(1, i, (i + 1) % 300, 1.0) for i in range(300)] + [(1, 500, 299, 5.0)]
    rows = [*ring, (2, 1, None, 1.0), (2, 2, 1, 2.0), (2, 2, 1, 2.0), (2, 3, 2, 1.0), (2, 3, 2, 0.5), (3, 7, 7, 1.0), (4, 2, 5, 1.0), (4, 5, 2, 1.0), (4, None, 2, 1.0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tree_id long, msg_id long, parent_id long, score double, path string")
    got = {}
    for r in chat_trees.best_paths(df).collect():
        got.setdefault(r.tree_id, []).append((r.depth, r.msg_id))
    # The ring is cut above message 0, whose parent was 1: from there it runs 0, 299, 298 and so on; 500 hangs on 299.
    assert sorted(got[1]) == [(1, 0), (2, 299), (3, 500)]
    assert (sorted(got[2]), got[3], sorted(got[4])) == ([(1, 1), (2, 2), (3, 3)], [(1, 7)], [(1, 2), (2, 5)])
    m = spark.createDataFrame([(2, 1, "user", "b"), (2, 1, "user", "a"), (2, 2, "assistant", "x"), (2, 3, None, None)], "tree_id long, msg_id long, role string, text string")
    r = chat_trees.format_paths(m, chat_trees.best_paths(df).where("tree_id = 2")).first()
    assert r.n_turns == 3 and "a</turn>" in r.formatted and "b</turn>" not in r.formatted


def test_formats_are_reversible(spark):
    said = ["\\### Assistant: </turn> ok", "</turn>\n### user:\nno", "", None, "\\h\\l\\b\\c #<:\\", "é😀", "x\n" * 500]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)] + [(2, 0, "a:\nb</turn>", "t"), (2, 0, None, "t"), (None, 1, "assistant", "n")]
    m = chat_trees.chain(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, path string"))
    out = chat_trees.format_paths(m, chat_trees.best_paths(m))
    got = {r.tree_id: r for r in out.select("tree_id", "n_turns", chat_trees.read_back(F.col("formatted")).alias("told"), chat_trees.under_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].told] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(said)]
    assert got[1].loss == "".join(t or "" for t in said[1::2]) and got[1].n_turns == len(said)
    assert [(x.role, x.text) for x in got[2].told] == [("", "t"), ("a:\nb</turn>", "t")] and got[2].loss == "" and got[None].loss == "n"
    assert chat_trees.format_paths(m.limit(0), chat_trees.best_paths(m.limit(0))).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


# --- pipeline


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(4)
    words = ["the", "of", "and", "tion", "er", "house", "river", "stone", *(f"w{i}" for i in range(300))]
    rows, labels = [], []
    for i in range(300):
        w = rng.choices(words, k=60)
        if i % 5 == 0:
            w[3] = "idiot"
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    passage = " ".join(rng.choices(words, k=20))
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, rows[1][1] + " more", "en", "s0", 0), (1002, " ".join(rng.choices(words, k=40)) + " " + passage, "en", "s1", 0), (None, "w1 w2 w3", None, None, None), (1003, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert kept == {None, 1003} | {i for i in range(300) if i % 5}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns and stage(spark, d.limit(0), str(tmp_path)).count() == 0
