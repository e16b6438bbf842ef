import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, common, decontaminate, license_scan, ngram_join, quality_bayes, queries, token_records

DOCS = "doc_id long, text string, note string, n_shingles string"


def docs(spark, texts, first=0):
    """Documents with columns that clash with results; a text may be (id, text)."""
    rows = [(t[0], t[1]) if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# --- token records

ODD = [None, "", "a", "The CAT'S 3 naïve façades, é  x <|endoftext|> <|ENDOFTEXT|>\nend.", "\x1c\x1d " * 5, "word " * 3000, "z" * 5000, "the cat", "the cat"]


def test_records_read_back(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    d = docs(spark, ODD).unionByName(docs(spark, [(None, "null id"), (3, "again")]))
    m = token_records.write_records(d, path, 2)
    got = token_records.read_records(m).orderBy("start").collect()
    order = [(None, "null id"), *[(i, x) for i, x in enumerate(ODD)]]
    assert len(got) == len(order) + 1 and [g.doc_id for g in got] == sorted([i for i, _ in order] + [3], key=lambda i: -1 if i is None else i)
    texts = {i: x for i, x in order}
    at = 0
    for g in got:
        assert g.start == at and g.n_tokens == len(g.ids)
        at += g.n_tokens
        if g.doc_id != 3:
            assert list(g.ids) == t.encode(texts[g.doc_id] or "", add_special_tokens=False).ids + [2]
    r = token_records.ShuffledReader(m.orderBy("shard").first().path)
    assert sorted(len(x) for _, x in r.shuffled(3)) == sorted(len(r[i][1]) for i in range(len(r)))


@pytest.fixture
def many_shards(spark):
    """Small inputs aren't put together to one shard."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_equal_ids_keep_their_order_and_hot_ids_spread(spark, many_shards):
    d = docs(spark, [(7, f"text {i % 50}") for i in range(400)] + [(None, f"null {i}") for i in range(300)] + [(8, "z")])
    runs = [[(r.doc_id, r.start, tuple(r.ids)) for r in token_records.read_records(token_records.write_records(d.repartition(k), P.path("word_bpe_49k.json"), 2)).orderBy("start").collect()] for k in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 701
    assert token_records.write_records(d, P.path("word_bpe_49k.json"), 2).count() > 1


@pytest.mark.parametrize("harm", ["cut index", "cut shard", "swap index", "swap both", "stale manifest"])
def test_harmed_shards_are_refused(spark, many_shards, tmp_path, harm):
    d = docs(spark, [f"some words {i}" for i in range(60)])
    m = token_records.write_records(d, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/r")
    a, b = (r.path.removeprefix("file://") for r in m.orderBy("shard").limit(2).collect())
    read = lambda n: open(n, "rb").read()

    def write(n, data):
        with open(n, "wb") as f:
            f.write(data)

    if harm == "cut index":
        x = read(f"{a}.idx")
        write(f"{a}.idx", x[: -20 - token_records.INDEX.itemsize] + x[-20:])
    elif harm == "cut shard":
        write(f"{a}.rec", read(f"{a}.rec")[:-3])
    elif harm == "swap index":
        x, y = read(f"{a}.idx"), read(f"{b}.idx")
        write(f"{a}.idx", y), write(f"{b}.idx", x)
    elif harm == "swap both":
        for kind in ("idx", "rec"):
            x, y = read(f"{a}.{kind}"), read(f"{b}.{kind}")
            write(f"{a}.{kind}", y), write(f"{b}.{kind}", x)
    else:
        m = m.withColumn("n_records", F.col("n_records") + 1)
    with pytest.raises(Exception, match="index|shard|broken"):
        token_records.read_records(m).collect()


def test_signs_behind_words_are_cut_as_the_library_cuts_them():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, (encoder, dtype) = Tokenizer.from_file(path), token_records._encoder(path, 2)
    assert encoder.known.plain
    words = ["word,%%%", "Word.", "É.!!", "ß,", "it's.", "it'll!'", "x<|endoftext|>", "x<|", "a-b", "e.g.", "ſ.", "İ,", "e\u0301.", "o\u0327,\u0301", "44.234.", "_a_", "a`~", "a" * 99 + "," * 99, "漢,", "a.\tb", "a,\u00a0b"]
    texts = [*words, *(w + x for w in words for x in words), " ".join(words), "\n".join(words)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_records_of_nothing(spark):
    m = token_records.write_records(docs(spark, []), P.path("word_bpe_49k.json"), 2)
    assert m.count() == 0 and token_records.read_records(m).count() == 0


def test_broken_frames_are_found():
    data = token_records.frame(b"abc") + token_records.frame(b"")
    a, at = token_records.unframe(data)
    assert (a, token_records.unframe(data, at)) == (b"abc", (b"", len(data)))
    for i in range(at):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        token_records.unframe(data[: at - 1])
    assert token_records.masked(zlib.crc32(b"x")) != zlib.crc32(b"x")


# --- byte-level encoding


def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_encoding_agrees_with_tiktoken(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    rng = random.Random(2)
    wild = ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(32, 127), rng.randrange(0x2000, 0x3100), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(60)]
    texts = [*ODD, "a" * 4000, " " * 999, "ab" * 3000, *wild]
    for r in byte_bpe.encode_decode(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids)


def plain_merges(piece, table):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table), default=None)
        if best is None:
            return [table[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_against_plain_merges():
    table, rng = ranks(), random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choices(b"aab the1\xc3\xa9\xff", k=rng.randrange(1, 30)))
        if piece not in table:
            assert byte_bpe.encode_piece(piece, table) == plain_merges(piece, table)


# --- n-gram join


def brute_components(rows, k=5, percent=75):
    sets = []
    for i, t in rows:
        w = SPACED.findall(fold(t))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y) and root(i) != root(j):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets}


def family(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 80])) for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, rng.choice([" ", "\t", "\n "]).join(w)))
    return [*out, (900, None), (901, " \n"), (902, "One two THREE"), (903, "one TWO three"), (904, "x" * 20000)]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 512), (2, 4)])
def test_components_against_brute_force(spark, seed, chunk):
    rows = family(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows), chunk=chunk).collect()}
    assert got == brute_components(rows)


def test_repeats_nulls_and_ids_with_several_texts(spark):
    same = "a b c d e f"
    rows = [(5, same), (5, same), (None, same), (None, None), (7, "p q r s t"), (7, same), (9, same)]
    got = [tuple(r) for r in ngram_join.ngram_components(docs(spark, rows)).collect()]
    assert sorted(g for g in got if g[0] == 5) == [(5, 2, 5)] * 2 and (9, 2, 5) in got and (None, 2, None) in got and (None, 0, None) in got
    assert len(got) == 7 and sorted(g for g in got if g[0] == 7) == [(7, 1, 7), (7, 2, 5)] and ngram_join.ngram_components(docs(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    got = sorted(tuple(r) for r in ngram_join.ngram_components(docs(spark, [(7, long), (7, "others are here today too"), (9, long + " more")])).collect())
    assert got == [(7, 1, 7), (7, 36, 7), (9, 37, 7)]


def test_copies_stand_aside_for_one_document(spark, monkeypatch):
    records, seen = ngram_join._records, []
    monkeypatch.setattr(ngram_join, "_records", lambda *a: seen.append(records(*a)) or seen[-1])
    text = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    rows = [(10 * i + j, text(i, 40)) for i in range(3) for j in range(8)] + [(100, text(7, 60)), (101, text(7, 61)), (102, text(7, 61))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs(spark, rows).repartition(6)).collect()}
    assert got == {d: 10 * (d // 10) for d, _ in rows}
    # Texts that only their own copies share shingles with aren't searched, wherever the copies lie.
    assert seen[0].count() == 2


def test_bits_of_chosen_ids_miss_none(spark):
    ids = np.random.default_rng(4).integers(-(1 << 39), 1 << 39, 40_000)
    bits = ngram_join._bloom(spark.createDataFrame([(i,) for i in ids[:20_000].tolist()], "id long"), 40_000)
    assert ngram_join._maybe(bits, ids[:20_000]).all() and ngram_join._maybe(bits, ids[20_000:]).mean() < 0.01
    assert not ngram_join._maybe(ngram_join._bloom(spark.createDataFrame([], "id long"), 0), ids).any()


@pytest.mark.parametrize("seed", [3, 4])
def test_large_blocks_whose_members_do_not_all_link(spark, seed):
    """Groups of documents share rare passages, and only some of a group are near copies."""
    rng = random.Random(seed)
    vocabulary, rows = [f"v{i}" for i in range(3000)], []
    for g in range(4):
        common = rng.choices(vocabulary, k=60)
        for i in range(50):
            own = rng.choice([0, 5, 12, 16, 20, 24])
            rows.append((100 * g + i, " ".join(common[: 60 - own] + [f"x{g}-{i % 9}-{j}" for j in range(own)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows), chunk=5).collect()}
    assert got == brute_components(rows)


def test_divide_skip_finds_every_partner():
    rng = np.random.default_rng(4)
    for turn in range(30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
        parts = rng.integers(0, 12, 30) if turn % 2 else np.arange(30)
        search = ngram_join.TOccurrence(np.arange(30), np.array([len(s) for s in sets]), sets, 60, parts)
        asked = rng.random(30) < 0.5 if turn % 3 else None
        links = search.link_all(None if asked is None else asked[search.keys])
        parent = list(range(30))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(30):
            parent[root(i)] = root(int(np.flatnonzero(parts == parts[i])[0]))
        for a, b in links:
            assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
            assert root(a) != root(b) and (asked is None or asked[a])
            parent[root(a)] = root(b)
        for a in range(30):
            for b in range(30):
                if (asked is None or asked[a]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b])):
                    assert root(a) == root(b)


def test_merge_leaps_over_lists():
    lists = [sorted(random.Random(i).sample(range(400), 60)) for i in range(12)]
    counts = {c: sum(c in x for x in lists) for c in range(400)}
    for least in (1, 2, 4):
        for apart in (list(range(400)), list(range(0, 400, 7))):
            merge, got = ngram_join.MergeSkip([(len(x), 0, x) for x in lists], least, apart), []
            while (found := merge.next()) is not None:
                got.append(found)
            assert got == [(c, n) for c, n in sorted(counts.items()) if n >= least and c in apart]


def test_components_of_a_graph(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(3, 3), (None, 4)]
    got = {r.id: r.component_id for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert got == {i: root(i) for i in list(parent)}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- decontamination


def brute_hits(rows, items, span=13):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(fold(t))
        m = min(span, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = ALNUM.findall(fold(t)), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if x := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= x
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("local_words", [decontaminate.LOCAL_WORDS, 0])
def test_hits_against_brute_force(spark, local_words):
    rng = random.Random(6)
    words = ["a", "B", "é", "zz9", "x"]
    rows = [(i, None if rng.random() < 0.05 else rng.choice(["", "!", "\n"]).join([" ".join(rng.choices(words, k=rng.randrange(0, 90))), ""])) for i in range(60)]
    items = [(j, " ".join((rng.choice(rows)[1] or "").split()[3 : 3 + rng.randrange(0, 40)])) for j in range(25)] + [(98, None), (99, "..."), (97, "unseen words only here")]
    bench = spark.createDataFrame([(*x, "clash") for x in items] + [(None, "a B", "y"), (0, items[0][1], "again")], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs(spark, rows), bench, local_words=local_words).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == brute_hits(rows, items)
    kept = decontaminate.flagged(docs(spark, rows[:3]), bench, local_words=local_words)
    assert kept.columns == ["doc_id", "text", "note", "n_shingles", "contamination"]


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs(spark, ["a b"]), none).collect()] == [(0, [])]
    assert decontaminate.contamination(docs(spark, []), none).count() == 0


def test_a_common_gram_and_many_items_by_join(spark):
    """Every text has the same few words over and over, and only some a whole window."""
    rng, common = random.Random(8), "of the one and all"
    rows = [(i, " ".join([common] * rng.randrange(1, 4) + [f"w{rng.randrange(40)}" for _ in range(30)])) for i in range(80)]
    items = [(j, " ".join(rows[j][1].split()[: 10 + j])) for j in range(40)] + [(50, common), (51, "w3"), (52, "w4 w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, [*rows, *rows[:3], (None, rows[0][1])])
    near = sorted(map(str, decontaminate.contamination(d, bench).collect()))
    assert near == sorted(map(str, decontaminate.contamination(d, bench, local_words=0).collect())) and len(near) == 84


def test_winnowing_keeps_a_hash_of_every_window():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 50, 300).astype(np.uint64)
    bounds = np.array([0, 0, 7, 120, 125, 300])
    at, kept = decontaminate.winnowed(h, bounds, 5, 9)
    from attestra.llm.word_hash import grams

    g, chosen = grams(h, 5), set(at.tolist())
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, b - 12):
            assert min(range(i, i + 9), key=lambda j: g[j]) in chosen
    assert (g[at] == kept).all()


# --- license scan


def test_license_spans(spark):
    notice = next(iter(license_scan.NOTICES))
    texts = ["Under the MIT  License, and apache-license! CC BY", None, "", "gnu general public", "License", notice.upper(), notice.replace("charge to", "charge now to"), "GNU General Public License gnu GENERAL public license", "K apache K license é mit İ license", "mit license " * 500]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, want = ALNUM.findall(fold(t)), []
        for p, label in license_scan.PHRASES.items():
            q = p.split()
            want += [(label, k, k + len(q) - 1) for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
        assert got[i].n_words == len(w)
        assert sorted((s.label, s.first_word, s.last_word) for s in got[i].spans if s.is_phrase) == sorted(want)
    assert {s.label for s in got[5].spans if not s.is_phrase} == {"mit"} and any(s.label == "mit" and s.coverage < 1 for s in got[6].spans)
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_texts_with_changes(spark):
    whole = {label: text for text, label in license_scan.TEXTS.items()}
    rng = random.Random(3)
    texts = []
    for label, text in whole.items():
        w = text.split()
        for k in range(10, len(w), 23):
            w[k] = "changed"
        texts.append((label, " ".join(["before"] * 9 + w + ["after"] * 9)))
    texts += [("", " ".join(rng.choices("the software is provided to any person of this license in source form".split(), k=400))), ("", "warranty of any kind " * 40)]
    got = license_scan.scan(docs(spark, [t for _, t in texts])).orderBy("doc_id").collect()
    for (label, text), r in zip(texts, got, strict=True):
        spans = [s for s in r.spans if not s.is_phrase]
        assert (not label and not spans) or label in {s.label for s in spans}
        assert all(0 < s.coverage <= 1 and 0 <= s.first_word <= s.last_word < r.n_words for s in r.spans)
    # A place of the template counts once, however many diagonals vote for it.
    notice = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    half = "alpha beta gamma delta epsilon x alpha beta gamma delta epsilon"
    assert license_scan.scan(docs(spark, [half, notice]), {}, {notice: "n"}).orderBy("doc_id").select(F.size("spans")).collect() == [(0,), (1,)]


# --- quality


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(["the", "of", "and", "tion", "er", "house", "river", "stone"], k=rng.randrange(20, 120))
        toxic, low = i % 5 == 0, i % 7 == 0
        if toxic:
            w[rng.randrange(len(w))] = "idiot"
        text = " ".join(x.upper() + "!!" for x in w) if low else " ".join(w)
        rows.append((i, text, f"s{i % 3}", "en"))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(spark):
    d, l, truth = labelled(spark)
    r = {x.doc_id: x.kept for x in quality_bayes.judge(d, l.where("doc_id < 200")).collect()}
    held = [(r[i], q == 1 and t == 0) for i, q, t in truth if i >= 200]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and all(a for a, b in held if b)


def test_quality_without_labels_and_with_nulls(spark):
    d, l, _ = labelled(spark, 30)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "s1", None), (1, "", "s1", None)], d.schema)
    got = quality_bayes.judge(d.unionByName(odd), l.limit(0)).collect()
    assert len(got) == 33 and all(r.kept for r in got)
    assert quality_bayes.judge(d.limit(0), l).count() == 0
    assert quality_bayes.judge(d, spark.createDataFrame([(1, None, None), (None, 0, 1), (2, 1, 0)], l.schema)).count() == 30


def test_posteriors_against_a_plain_computation(spark):
    rng = random.Random(2)
    d, l, _ = labelled(spark, 300)
    d = d.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "fr").when(F.col("doc_id") % 9 == 0, None).otherwise("en"))
    weights = quality_bayes.train(d, l)
    rows = quality_bayes.document_odds(d, weights, F.col("source"), F.col("lang")).collect()
    got = {r.doc_id: r for r in quality_bayes.judge(d, l).collect()}
    chance = lambda z: 1 / (1 + math.exp(-z))

    def strength(groups):  # (sum, number, prior mean) of each
        groups = [g for g in groups if g[1] > 1]
        extra = sum((x - n * p) ** 2 / n for x, n, p in groups) - sum(p * (1 - p) for _, n, p in groups)
        more = sum((n - 1) * p * (1 - p) for _, n, p in groups)
        return 1e6 if extra <= 0 or not more else min(max(more / extra - 1, 1.0), 1e6)

    for f in ("low_quality", "toxic"):
        sites, hosts = {}, {}
        for r in rows:
            for of, k in ((sites, (r.host, r.path)), (hosts, r.host)):
                x, n = of.get(k, (0.0, 0))
                of[k] = x + chance(r[f]), n + 1
        p = sum(x for x, _ in hosts.values()) / len(rows)
        s = strength([(x, n, p) for x, n in hosts.values()])
        prior = {h: (x + s * p) / (n + s) for h, (x, n) in hosts.items()}
        t = strength([(x, n, prior[h]) for (h, _), (x, n) in sites.items()])
        for r in rows:
            x, n = sites[r.host, r.path]
            rate = (x + t * prior[r.host]) / (n + t)
            want = chance(r[f] + math.log(rate / (1 - rate)) - math.log(p / (1 - p)))
            assert got[r.doc_id][f"p_{f}"] == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert all(r.kept == (r.p_low_quality < 0.5 and r.p_toxic < 0.2) for r in got.values()) and rng


def test_quality_of_long_texts_and_clashing_columns(spark):
    d, l, truth = labelled(spark, 200)
    odd = spark.createDataFrame([(900, "word " * 60000, "s1", "en"), (901, "IDIOT!! " * 20000, "s1", "en"), (5, "the of and", "s1", "en")], d.schema)
    clash = d.unionByName(odd).withColumn("host", F.lit("h")).withColumn("kept", F.lit(1)).withColumn("features", F.lit(2)).withColumn("low", F.lit("x"))
    got = quality_bayes.judge(clash, l.withColumn("doc_id2", F.lit(1)))
    assert got.count() == 203 and got.columns == ["doc_id", "host", "path", "p_low_quality", "p_toxic", "kept"]


def test_sparse_sites_shrink_toward_the_global_rate(spark):
    even = spark.createDataFrame([(f"h{i}", 10, 2.0 + 0.01 * (i % 3)) for i in range(50)], "host string, n long, x double").withColumn("p", F.lit(0.2))
    apart = spark.createDataFrame([(f"h{i}", 10, 9.0 if i % 2 else 0.5) for i in range(50)], "host string, n long, x double").withColumn("p", F.lit(0.475))
    assert quality_bayes._strength(even, "x", "n", "p") == 1e6 and quality_bayes._strength(apart, "x", "n", "p") < 5


def test_digest_columns(spark, tmp_path):
    docs(spark, ["one two", None]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    r = {x.doc_id: x for x in queries.op3_byte_bpe(spark, str(tmp_path)).collect()}
    assert r[1].ids_sha256 == r[1].decoded_sha256 == hashlib.sha256(b"").hexdigest() and r[0].decoded_sha256 == hashlib.sha256(b"one two").hexdigest()
    r = {x.doc_id: x for x in queries.op1_token_records(spark, str(tmp_path)).collect()}
    assert (r[1].n_tokens, r[1].ids_crc32) == (1, zlib.crc32((2).to_bytes(4, "little"))) and r[1].start == r[0].n_tokens
