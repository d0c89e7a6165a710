"""Each operator against brute force, the library it rebuilds, or what it should find."""

import random
import re
import time
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from frames import frame, prose, words
from pyspark.sql import functions as F

from landcompare.llm import decontamination, licenses, linetemplates, neighbours, quality, sentencepieces, simhash, tokencounts, toxicity, urlfilter
from landcompare.llm.common import table
from landcompare.operators import components
from landcompare.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Components


def test_components(spark):
    own = random.Random(3)
    links = [(own.randrange(300), own.randrange(300)) for _ in range(170)] + [(400, n) for n in range(401, 600)] + [(n, n + 1) for n in range(700, 760)]
    links += [(5, 5), (None, 3), links[0]]
    found = dict(components.connected_components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect())
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == groups({n for e in real for n in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


# SimHash


def fingerprint(text):
    data = text.encode().lower().translate(None)
    parts = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    runs = [b" ".join(parts[k : k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "a", "A b\tC", "a b c d", "Éa É b a b c d e e", prose(200, 8), "w " * 50])
def test_fingerprint(text):
    assert simhash.simhash(text) % (1 << 64) == fingerprint(text)


@pytest.mark.parametrize("size", [1, 7, 64, 200])
@pytest.mark.parametrize("tail", ["", " ", "\n", " \t \n" * 40])
def test_fingerprint_in_pieces(monkeypatch, size, tail):
    """Whatever the pieces, and whatever blanks stand behind the last cut."""
    monkeypatch.setattr(simhash, "PIECE", size)
    for n in [0, 1, 2, 3, 4, 5, *range(300, 340)]:
        text = prose(n, 9) + tail
        assert simhash.simhash(text) % (1 << 64) == fingerprint(text)


def test_triples_cover_every_shared_set():
    assert all(any(set(t) <= set(s) for t in simhash.OF_8) for s in combinations(range(8), simhash.SHARED_OF_8))


def test_links_of_near_prints(spark):
    """Planted prints 1 to 6 bits apart, dense groups included, with blocks so small that lists are split."""
    own = random.Random(4)
    prints = []
    for centre in [own.getrandbits(64) for _ in range(30)] + [own.getrandbits(64)] * 40:
        for _ in range(4):
            flipped = centre
            for bit in own.sample(range(64), own.randrange(7)):
                flipped ^= 1 << bit
            prints.append(flipped)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    frame_ = spark.createDataFrame([(p,) for p in prints], "fingerprint BIGINT")
    for block in (3, 512):
        listed = simhash.members(frame_, "fingerprint", ["fingerprint"], simhash.OF_8, block)
        links = simhash.forests(listed, "fingerprint", simhash.tallied(["fingerprint"], 4, 4), 4).collect()
        real = [(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
        assert groups(prints, [tuple(x) for x in links]) == groups(prints, real)


def test_simhash_query(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    links = [(a, b) for a, b in combinations(docs, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(docs, links)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SF).collect()}
    assert found == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def test_near_duplicate_stage(spark):
    """One row of each component of fingerprints, by all pairs; ties, repeats, texts without words and null ids included."""
    own, rows = random.Random(9), []
    for k in range(40):
        base = words(own.choice([3, 60, 400]), 100 + k)
        for _ in range(6):
            near = list(base)
            for _ in range(own.randrange(3)):
                near[own.randrange(len(near))] = own.choice(["other", base[0]])
            rows.append((len(rows), " ".join(near) + own.choice(["", " ", "\n"])))
    rows += [(1000, ""), (1001, " "), (1002, None), (rows[0][0], rows[0][1]), (None, rows[5][1]), (None, "alone " + prose(30, 1)), (None, "alone " + prose(30, 1))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    prints = [fingerprint(t or "") for _, t in rows]
    groups_ = groups(range(len(rows)), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    best = {}
    for at, (i, t) in enumerate(rows):
        best[groups_[at]] = min(best.get(groups_[at], (True, 0, "")), (i is None, i or 0, t or "")) if groups_[at] in best else (i is None, i or 0, t or "")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(best.values())
    assert len(kept) < 0.6 * len(rows)


# Token counts


def test_token_counts_and_cache(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokencounts.TOKENIZER)
    library = Tokenizer.from_file(path)
    own = table(spark, SF, "documents").select("doc_id", "text").limit(60)
    odd = ["a\u00a0b", "é e\u0301  e \u0301", "İI ΑΣ ΑΣ, ς", "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>", "x\x1cy\x85z\u2028w", "don't I'LL 3.14", "\u3000 a"]
    docs = own.unionByName(frame(spark, [(10_000 + k, t) for k, t in enumerate(odd)], "doc_id BIGINT, text STRING")).cache()
    cache = shared_folder(spark, "test-cache")
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()}
    for _ in range(2):
        found = tokencounts.count_tokens(docs, path, cache, limit=100).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in found)
        stored = spark.read.parquet(cache)
        # Nothing is encoded twice: the second run appends no row, nor do texts that differ in blanks only.
        assert stored.count() == stored.select("digest").distinct().count()
        assert tokencounts.count_tokens(docs.limit(5).select("doc_id", F.concat(F.lit("  "), "text").alias("text")), path, cache).count() == 5
        assert spark.read.parquet(cache).count() == stored.count()


def test_only_new_texts_move(spark):
    """With one new text among many known ones, its digest goes to the texts; with all of them new, texts are dealt by digest."""
    path, cache = public_tokenizers.path(tokencounts.TOKENIZER), shared_folder(spark, "test-cache")
    docs = spark.createDataFrame([(k, prose(30, k)) for k in range(400)], "doc_id BIGINT, text STRING")
    want = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(docs, path, cache).collect()}
    more = docs.union(spark.createDataFrame([(1000, "one new text"), (1001, "one  new text "), (None, "one new text")], "doc_id BIGINT, text STRING"))
    found = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(more, path, cache).collect()}
    assert {i: n for i, n in found.items() if i in want} == want and found[1000] == found[1001] == found[None] == 3
    rows = more.select("doc_id", "text", F.sha2("text", 256).cast("binary").alias("digest"))
    missing = rows.groupBy("digest").agg(F.min("doc_id").alias("some_id"))
    for part, moves in ((missing.where("some_id = 7"), False), (missing, True)):
        plan = tokencounts.misses_of(rows, part, rows)._jdf.queryExecution().executedPlan().toString()
        assert ("ShuffledHashJoin" in plan) == moves and ("BroadcastHashJoin" in plan) != moves


def test_shapes_of_whole_tokens():
    features = quality.Features()
    long = "a" * 300_000
    tokens = ["abC1", "abc", "ABC", "É1é", "a_b", "x" * 100 + "1!!!", long, long + "-", long + "B1", "日本語" * 5000]
    shapes = [features._of(t)[1] for t in tokens]
    want = ["A0", "a", "A", "A0a", "a_a", "a0!!", "a", "a-", "A0", "a"]
    assert shapes == [quality._bucket("s", w) for w in want]
    for k in range(3000):
        features._of(f"{k}" + "y" * 20_000)
        assert sum(len(t) + quality.ENTRY for t in features.memo) <= quality.MEMO


# SentencePiece


def test_same_ids_as_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path(sentencepieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  two  blanks ", "▁ mark▁ed", "<s> </s> <unk> <0x41>", "日本語 🙂 \x00\x01", "line\nfeed\ttab", "a" * 5000, "word" + " " * 40 + "end"]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(frame(spark, [(10_000 + k, t) for k, t in enumerate(odd)], "doc_id BIGINT, text STRING")).cache()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = sentencepieces.encode(docs, path).cache()
    for r in found.collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.parity
    again = {r.doc_id: r.text for r in sentencepieces.decode(found, path).collect()}
    marked = {i for i, t in texts.items() if "▁" in t}
    assert all(again[i] == texts[i] for i in texts if i not in marked)
    assert all(r.round_trip for r in found.collect() if r.doc_id not in marked)


def proto(number, value):
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model():
    """A small unigram model written by hand: pieces, scores, byte fallback, and a normaliser that squeezes blanks."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    pieces += [("▁", -2.0, 1), ("▁the", -3.0, 1), ("▁th", -4.5, 1), ("e", -3.5, 1), ("re", -4.1, 1), ("r", -5.2, 1), ("▁there", -6.0, 1), ("t", -5.5, 1), ("h", -5.6, 1), ("the", -6.5, 1)]
    data = b"".join(proto(1, proto(1, p.encode()) + proto(2, s) + proto(3, kind)) for p, s, kind in pieces)
    data += proto(2, proto(3, 1) + proto(35, 1)) + proto(3, proto(3, 1) + proto(4, 1) + proto(5, 1))
    codec = sentencepieces.Codec(data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the there", "  there   the ", "threet hé", "", "rethe e", "日"]
    assert codec.words
    for text, (ids, same, back) in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text) and same and back


@pytest.mark.parametrize("words", [True, False])
def test_ids_are_those_of_the_rebuilt_model(monkeypatch, words):
    """A rebuilt model without merges shows in the ids, not only in the parity flag."""
    import sentencepiece

    path = public_tokenizers.path(sentencepieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentencepieces, "by_words", lambda model: words)
    with open(path, "rb") as file:
        data = file.read()
    text = "the words of a text"
    ids, same, back = sentencepieces.Codec(data).encode([text])[0]
    assert np.frombuffer(ids, np.int32).tolist() == library.encode(text) and same and back
    monkeypatch.setattr(sentencepieces, "merges", lambda model: [])
    ids, same, back = sentencepieces.Codec(data).encode([text])[0]
    assert len(ids) // 4 > len(library.encode(text)) and not same and back


# Toxicity and quality


@pytest.fixture(scope="module")
def marked(spark):
    own = random.Random(6)
    rows = []
    for k in range(900):
        text, toxic, junk = words(own.randint(20, 200), 5000 + k), own.random() < 0.2, own.random() < 0.25
        if toxic:
            for _ in range(3):
                text.insert(own.randrange(len(text)), own.choice(["vile", "rotten", "nasty"]))
        text = [w + own.choice(["###", "$$$", "%%%"]) for w in text] if junk else text
        rows.append((k, " ".join(text), int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, quality INT, toxic INT").cache()


def test_toxicity_on_held_out_rows(marked):
    found = {r.doc_id: r for r in toxicity.score(marked, toxicity.fit(marked, marked)).collect()}
    rows = [(found[r.doc_id], r.toxic) for r in marked.collect()]
    held = [(f, y) for f, y in rows if f.held_out]
    assert 250 < len(held) < 350
    assert np.mean([f.predicted == y for f, y in held]) > 0.95
    assert all(f.predicted == int(f.score >= 0.7) for f, _ in held)
    low, high = (np.mean([f.score for f, y in held if y == k]) for k in (0, 1))
    assert low < 0.2 < 0.8 < high


def test_toxicity_never_learns_from_held_out_labels(marked):
    flipped = marked.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(marked, m) for m in (marked, flipped))
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_sparse_weights(marked):
    _, buckets, weights = toxicity.fit(marked, marked)
    assert 0 < len(buckets) < 2000 and (weights != 0).all()


def test_grams_in_pieces(monkeypatch):
    text = prose(400, 12)
    whole = toxicity.Grams()(text)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert (toxicity.Grams()(text) == whole).all()


def test_quality_on_held_out_rows(marked):
    model = quality.fit(marked, quality.ratings_of(marked))
    assert (np.diff(model[2]) > 0).all()
    found = {r.doc_id: r for r in quality.score(marked, model).collect()}
    held = [r for r in marked.withColumn("held", toxicity.held_out(F.col("doc_id"))).collect() if r.held]
    assert np.mean([found[r.doc_id].selected == (r.quality == 1) for r in held]) > 0.95
    means = [np.mean([found[r.doc_id].expected_grade for r in held if g == (0 if not r.quality else 2 - r.toxic)]) for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_ordinal_gradient():
    """One batch against differences of the likelihood."""
    own = np.random.default_rng(2)
    rows = [(np.arange(4), own.standard_normal(4)) for _ in range(400)]
    true = np.array([1.5, -1.0, 0.5, 2.0])
    s = np.array([x @ true for _, x in rows]) + own.logistic(size=400)
    grades = np.digitize(s, [-1.0, 1.0])
    w, cuts = quality.fit_rows(rows, grades, 3)
    assert np.corrcoef(w[:4], true)[0, 1] > 0.97 and cuts[0] < cuts[1]


# Decontamination


def brute_leaks(docs, items):
    found = set()
    for i, t in docs.items():
        ws = decontamination.words_of(t)
        for item, text in items.items():
            own = decontamination.words_of(text)
            n = min(5, len(own))
            runs = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            have = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
            if own and len(runs & have) == len(runs):
                found.add((i, item))
    return found


def test_leaks_query(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text or "" for r in table(spark, SF, "benchmark").collect()}
    found = decontamination.query(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(docs, items) != set()
    clean = {r[0] for r in decontamination.drop_leaking(table(spark, SF, "documents"), table(spark, SF, "benchmark")).select("doc_id").collect()}
    assert clean == set(docs) - {r.doc_id for r in found}


def test_leaks_at_every_place_and_in_shards(spark, monkeypatch):
    items = [(k, ". ".join([prose(12 + k, 700 + k), prose(6, 800 + k)]) + ".") for k in range(30)]
    rows = []
    for k, (_, text) in enumerate(items):
        changed = text.split()
        changed[3] = "changed"  # 4 runs of five go: 10 to 25 percent
        rows += [(3 * k, f"{prose(37 * k, 900 + k)} {text.upper()} {prose(50, 950 + k)}"), (3 * k + 1, prose(150, 970 + k)), (3 * k + 2, " ".join(changed))]
    docs, own = spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    want = {(3 * k, k) for k in range(30)}
    for size in (100_000, 60):
        monkeypatch.setattr(decontamination, "SHARD_POSTINGS", size)
        found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, own).collect()}
        assert want <= set(found) and all(found[x].overlap == found[x].question_overlap == found[x].answer_overlap == 1 for x in want)
        assert {i for i, _ in set(found) - want} <= {3 * k + 2 for k in range(30)}
        assert all(r.overlap >= 0.8 and r.score >= decontamination.THRESHOLD for r in found.values())


@pytest.mark.parametrize("passages", [512, 2])
def test_no_item_above_the_threshold_is_missed(spark, monkeypatch, passages):
    """Index.search against plain scores of every window and item."""
    items = spark.createDataFrame([(k, prose(20, 60 + k % 9) + f" w{k}") for k in range(40)], "item_id BIGINT, text STRING")
    index = decontamination.Index(*next(decontamination.shards(items)[1]))
    seen = set()
    index._verify = lambda item, passage, score, first, best: seen.add((first, item))
    ids = index.ids((prose(33, 1) + " " + prose(20, 62) + " " + prose(90, 2) + " " + prose(20, 67)).split())
    monkeypatch.setattr(decontamination, "PASSAGES", passages)
    index.search(ids)
    size, dense = index.longest, np.zeros((len(index.words), len(index.items)))
    dense[index.places // index.blocks, index.owners] = index.weights
    want = set()
    for k in range(len(ids) // size + 1):
        terms = np.unique(ids[k * size : (k + 2) * size])
        scores = dense[terms[terms >= 0]].sum(0)
        want |= {(k * size, item) for item in np.flatnonzero(scores >= decontamination.THRESHOLD)}
    # A stretch at the end of a part is a passage of its own there, and a whole one in the next part.
    assert want <= seen if passages < 512 else want == seen
    assert want


# Neighbours


@pytest.mark.parametrize("block", [64, neighbours.BLOCK])
def test_recall_and_scores(spark, block):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()}
    vectors = neighbours.usable(table(spark, "/root/testdata/sf0.01", "embeddings"))
    queries = vectors.where(F.col("vec_id") % neighbours.QUERY_EVERY == 0)
    found = defaultdict(list)
    for r in neighbours.nearest(vectors, queries, block=block).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        want = sorted((-(v * rows[q]).sum(), i) for i, v in rows.items() if i != q)[:20]
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        assert all(abs(s - (rows[i] * rows[q]).sum()) < 1e-12 for _, i, s in got)
        hits += len({i for _, i in want} & {i for _, i, _ in got})
    assert hits / (20 * len(found)) >= 0.9


def test_hot_vector(spark):
    own = np.random.default_rng(1)
    hot = own.standard_normal(8).tolist()
    rows = [(k, hot if k % 3 == 0 else own.standard_normal(8).tolist()) for k in range(600)]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>"))
    found = neighbours.nearest(vectors, vectors.where("vec_id = 300"), block=32).orderBy("rank").collect()
    want = sorted((-round(float(np.dot(v, hot)), 9), i) for i, v in rows if i != 300)[:20]
    assert [r.vec_id for r in found] == [i for _, i in want]


# URLs


def test_redirects_and_canonical_links(spark):
    def page(i, url, more=""):
        return (i, url, f"<html><head>{more}</head>")

    rows = [
        page(1, "http://one.net/a", '<link href="https://de.com/de/x" rel="canonical">'),  # alias of a blocked url
        page(2, "http://two.net/b?q=1#f", "<meta http-equiv='refresh' content='0; url=//one.net/a'>"),  # through another alias
        page(3, "http://three.net/c", '<link rel="canonical" href="http://two.net/b?q=1">'),
        page(4, "https://fr.com/fr/y", '<link rel="canonical" href="https://DE.com/de/z#top">'),  # allowed by its own rule
        page(5, "http://five.net/d", '<link rel="canonical" href="https://fr.com/fr/y">'),  # allowed and blocked aliases
        page(6, "http://six.net/e/", '<link rel="canonical" href="f"><link rel="stylesheet" href="https://de.com/de/x">'),
        page(7, "http://six.net/e/f"),
        page(8, "https://www.de.com/de/w"),
        page(9, "http://nine.net/", '<link rel="canonical" href="javascript:x">'),
        page(10, "http://ten.net/k"),
        page(11, "HTTP://one.net/a#there"),
    ]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    redirects = spark.createDataFrame([("http://ten.net/k", "http://six.net/e/f"), ("http://six.net/e/", "https://de.com/de/x"), (None, "x")], "url STRING, target STRING")
    rules = urlfilter.rule_table(spark, urlfilter.RULES)
    found = {r.page_id: (r.verdict, r.rule) for r in urlfilter.judge(pages, rules).collect()}
    block, allow = ("block", None), ("allow", None)
    assert found == {1: block, 2: block, 3: block, 4: ("allow", "com/fr/"), 5: allow, 6: allow, 7: allow, 8: ("block", "com/de/"), 9: allow, 10: allow, 11: block}
    more = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules, redirects).collect()}
    assert more[6] == more[7] == more[10] == "block" and more[9] == "allow"


@pytest.mark.parametrize(
    "base, tag, alias",
    [
        ("http://m.net/x/y/z?q", '<link rel="nofollow canonical" href="/k">', "http://m.net/k"),
        ("http://m.net/x/y/z?q", "<link href='/k' rel='canonical nofollow'>", "http://m.net/k"),
        ("http://m.net/x/y/z", "<link rel=canonical href=../q>", "http://m.net/x/q"),
        ("http://m.net/x/y/z", '<link rel="canonical" href="../../../../q?a=../b">', "http://m.net/q?a=../b"),
        ("http://m.net/x/y/z", '<link rel="canonical" href="./q/./r/..">', "http://m.net/x/y/q/"),
        ("http://m.net/x/y/z", '<link rel="canonical" href=".">', "http://m.net/x/y/"),
        ("http://m.net/x/", '<link rel="canonical" href="/a/b/../../c.d/..e">', "http://m.net/c.d/..e"),
        ("http://m.net/x/p?r=1#f", '<link rel="canonical" href="?p=2">', "http://m.net/x/p?p=2"),
        ("http://m.net", '<link rel="canonical" href="?p=2">', "http://m.net/?p=2"),
        ("http://m.net/x", '<link rel="noncanonical" href="/k">', None),
        ("http://m.net/x", '<link rel="canonical-x" href="/k">', None),
    ],
)
def test_links_are_resolved(spark, base, tag, alias):
    """A block of the alias reaches the page that names it, in SQL too."""
    import duckdb

    pages = spark.createDataFrame([(1, base, tag), (2, alias, None), (3, "http://m.net/none", None)], "page_id BIGINT, url STRING, html STRING")
    links = urlfilter.links(pages).collect()
    assert len(links) == (alias is not None)
    redirects = spark.createDataFrame([(alias or "http://m.net/else", "http://a.com/de/")], "url STRING, target STRING")
    found = {r.page_id: r.verdict for r in urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES), redirects).collect()}
    assert found[1] == ("block" if alias else "allow") and found[3] == "allow"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    blocked = "<link rel=canonical href='http://a.com/de/'>"
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(1, base, tag), (2, alias, blocked), (3, "http://m.net/none", None)])
    assert {r[0]: r[4] for r in con.execute(urlfilter.SQL).fetchall()}[1] == found[1]


@pytest.mark.parametrize(
    "url, rule",
    [
        ("http://example.org/es/1", "example.org/es/"),
        ("http://www.example.org/en/12", "example.org/en/1"),
        ("http://www.example.org/en/2", "org/"),
        ("http://notexample.org/es/1", "org/"),
        ("http://org", None),
        ("http://ORG/", "org/"),
        ("http://a.com/fr", None),
        ("http://a.com/fr/?x", "com/fr/"),
        ("x://y://org/", None),
        ("http://a.org?q=/de/", None),
    ],
)
def test_rules(spark, url, rule):
    pages = spark.createDataFrame([(1, url, None)], "page_id BIGINT, url STRING, html STRING")
    assert urlfilter.judge(pages, urlfilter.rule_table(spark, urlfilter.RULES)).first().rule == rule


# Lines


def test_templates(spark):
    own = [prose(14, 300 + k) for k in range(40)]
    note, passage = "Posted by user {} on day {} of the year", prose(60, 31)
    rows = []
    for k in range(8):
        rows.append((k, "\n".join([own[k], note.format(k * 17, k + 3), own[8 + k], own[16 + k]] + ([passage] if k > 4 else []))))
    menu = "Home about us contact imprint search {} privacy terms"  # a field without a digit
    rows += [(20 + k, "\n".join([own[24 + k], menu.format(w), own[28 + k]])) for k, w in enumerate(["alpha", "beta", "gamma"])]
    rows += [(30, "\n".join(own[32:36])), (31, "\n".join([*own[32:35], "a line of its own here"])), (32, "\n".join(own[32:36]))]  # copies
    rows += [(40, "short line\n" + own[36]), (41, "short line\n" + own[37])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = {r.doc_id: r.text for r in linetemplates.drop_recurring_lines(docs).collect()}
    texts = dict(rows)
    for k in range(8):
        lines = texts[k].split("\n")
        assert found[k].split("\n") == [x for n, x in enumerate(lines) if (n != 1 or k == 0) and (x != passage or k == 5)]
    assert menu.format("alpha") in found[20] and found[21] == "\n".join([own[25], own[29]]) and found[22] == "\n".join([own[26], own[30]])
    assert all(found[i] == texts[i] for i in (30, 31, 32, 40, 41))


def test_shared_passages_are_no_copies(spark):
    """Passages that fill most of several texts go from all but the first; copies of one text keep its lines, but not those of others."""
    passage, parts, menu = prose(60, 51), [prose(20, 52 + k) for k in range(3)], prose(9, 55)
    rows = [(k, passage + "\n" + prose(15, 400 + k)) for k in range(4)]
    rows += [(10 + k, "\n".join([*parts, prose(30, 410 + k)])) for k in range(4)]
    rows += [(20, menu + "\n" + prose(80, 420))]
    copy = [prose(20, 430 + k) for k in range(5)]
    rows += [(30, "\n".join([menu, *copy, "the first one ends like this"])), (31, "\n".join([menu, *copy, "while another one ends here"]))]
    rows += [(40, "\n".join([passage, passage, prose(70, 440)]))]
    found = {r.doc_id: r.text for r in linetemplates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    texts = dict(rows)
    assert all(found[i] == texts[i] for i in (0, 10, 20))
    assert all(found[k] == prose(15, 400 + k) for k in range(1, 4))
    assert all(found[10 + k] == prose(30, 410 + k) for k in range(1, 4))
    assert all(found[i] == texts[i].split("\n", 1)[1] for i in (30, 31))
    assert found[40] == prose(70, 440)


def test_masked_lines(spark):
    """Against each token by itself, on texts of any blanks and digits, long ones among them."""
    rng = random.Random(7)
    alphabet = "ab0 9\t\n\r\x0b\x0c <*>$\\1\u00e9\u65e5\U0001f600\u0085\u0663 \n  "
    texts = ["", "0", " 0", "\n0", " <*>", "a" * 100_000, "a" * 100_000 + "1", " " * 100_000, "a " * 50_000, "a1 " * 50_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "doc_id BIGINT, text STRING").repartition(4)
    found = dict(docs.select("doc_id", linetemplates.masked(F.col("text"))).collect())
    field = lambda token: linetemplates.FIELD if re.search("[0-9]", token) else token
    for k, text in enumerate(texts):
        assert found[k] == [" ".join(map(field, re.split("[\t\x0b-\r ]+", line))).strip(" ") for line in text.split("\n")]
    assert found[len(texts)] is None


# Licenses


def test_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "// Released under the MIT License."
    rows = [
        (1, "LICENSE", "Some words first.\n" + apache),
        (2, "src/main/a.c", prose(50, 41)),
        (3, "src/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "src/lib/deep/er/b.c", prose(50, 42)),
        (5, "src/lib/deep/c.c", mit + "\n" + prose(300, 43)),
        (6, "src/libx/d.c", prose(10, 44)),
        (7, None, prose(10, 45)),
        (8, "e.c", prose(300, 46) + "\n * SPDX-License-Identifier: BSD-3-Clause"),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, path STRING, text STRING")).collect()}
    assert {i: r.effective for i, r in found.items()} == {1: "Apache-2.0", 2: "Apache-2.0", 3: "GPL-3.0", 4: "GPL-3.0", 5: "MIT", 6: "Apache-2.0", 7: None, 8: "BSD-3-Clause"}
    assert {i: r.inherited_from for i, r in found.items() if r.inherited_from} == {2: "LICENSE", 4: "src/lib/COPYING", 6: "LICENSE"}
    assert [found[i].line for i in (1, 5, 8)] == [1, 0, 1]


def test_wrapped_and_inline_notices(spark):
    import textwrap

    code = prose(300, 47)
    mit = next(t for name, t in licenses.TEMPLATES if name == "MIT" and len(t) > 300)
    apache = licenses.TEMPLATES[1][1]
    block = "\n".join(" * " + x for x in textwrap.wrap(mit + ":", 77))
    rows = [
        (1, "a/a.c", f"/*\n{block}\n */\n{code}"),
        (2, "b/b.c", f"{code}\n{block}\n{code}"),
        (3, "c/c.c", f"Copyright 2020 Foo Inc. All rights reserved.\n{code}"),
        (4, "d/d.c", f"{prose(12, 48)}. {licenses.TEMPLATES[0][1]} {prose(15, 49)}.\n{code}"),
        (5, "e/e.c", code + "\n" + "\n".join("# " + x for x in textwrap.wrap(f"{prose(9, 50)}. {apache} {prose(20, 51)}.", 40))),
        (6, "f/f.c", f"{code}\nall of this is under a license, reserved to the rights of others, version 2\n{code}"),
        (7, "g/g.c", code),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, path STRING, text STRING")).collect()}
    assert {i: r.license for i, r in found.items()} == {1: "MIT", 2: "MIT", 3: "Proprietary", 4: "Apache-2.0", 5: "Apache-2.0", 6: None, 7: None}
    assert [found[i].line for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert not any(r.license_file for r in found.values())


def test_running_sums_in_chunks(spark):
    for n in (0, 1, 3, 4, 5, 8, 11):
        [(got,)] = spark.range(1).select(licenses._sums_before(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x, chunk=4)).collect()
        assert got == [k * (k + 1) // 2 for k in range(n + 1)]


def test_many_sentences_take_time_in_proportion(spark):
    frame = spark.createDataFrame([(1, "a.c", "Prose goes on. " * 40_000 + licenses.TEMPLATES[1][1])], "doc_id BIGINT, path STRING, text STRING")
    start = time.perf_counter()
    [row] = licenses.scan(frame).collect()
    assert row.license == "Apache-2.0"
    assert time.perf_counter() - start < 120


WHOLE = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
SHELF = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not all((SHELF / n).exists() for n in WHOLE), reason="this machine has no whole license texts")
def test_whole_license_texts_are_told_apart(spark):
    rows = [(k, f"p{k}/LICENSE", (SHELF / n).read_text()) for k, n in enumerate(WHOLE)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, path STRING, text STRING")).collect()}
    assert {n: found[k].license for k, n in enumerate(WHOLE)} == WHOLE
    assert all(r.license_file for r in found.values())


def test_rights_reserved_only_where_nothing_else_is_near(spark):
    rows = [(1, "a/a.c", "All rights reserved."), (2, "b/b.c", "All rights reserved.\nReleased under the MIT License.")]
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, path STRING, text STRING")).collect()}
    assert found == {1: "Proprietary", 2: "MIT"}
