"""Conversation repair, spelling variants and the set join against brute force, over rows of all kinds."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from frames import clashing, documents, frame, prose, rows_of, words
from pyspark.sql import functions as F
from test_methods import groups

from landcompare.llm import conversations, setjoin, spelling

TALK = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


# Conversations


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def brute(rows):
    """The least (cost, audit, lines) over all edits of (role, text, fault), with up to two insertions in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    per_row = []
    for role, text, fault in rows:
        cut = int(fault == "truncated")
        found = [(3, "D", None)]
        if fault in (None, "truncated"):
            found += [(cut, "K", (role, text)), (2 + cut, "R", ("user", text)), (2 + cut, "R", ("assistant", text))]
        per_row.append(found)
    best = None
    for inserted in product(gaps, repeat=len(rows) + 1):
        for acts in product(*per_row):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for c in inserted[k]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append(("user" if c == "u" else "assistant", ""))
                if k < len(rows):
                    cost, audit = cost + acts[k][0], audit + acts[k][1]
                    if acts[k][2]:
                        lines.append(acts[k][2])
            if legal("".join(r[:1] or "?" for r, _ in lines)):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def by_strings(rows):
    """The same by a plain dynamic program over (cost, audit, lines)."""
    moves, after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}, {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    best = {0: (0, "", ())}

    def put(found, state, value):
        if state not in found or value < found[state]:
            found[state] = value

    def insert(found):
        for state in (0, 1, 2, 3):
            if state in found:
                cost, audit, lines = found[state]
                put(found, after[state][1], (cost + 2, audit + "I", (*lines, (after[state][0], ""))))

    for role, text, fault in rows:
        insert(best)
        now, cut = {}, int(fault == "truncated")
        for state, (cost, audit, lines) in best.items():
            put(now, state, (cost + 3, audit + "D", lines))
            if fault in (None, "truncated"):
                if state in moves.get(role[:1], {}):
                    put(now, moves[role[:1]][state], (cost + cut, audit + "K", (*lines, (role, text))))
                put(now, after[state][1], (cost + 2 + cut, audit + "R", (*lines, (after[state][0], text))))
        best = now
    insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def judged(rows):
    """(turn, role, text) in order, with faults."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        last = text.strip(conversations.BLANKS)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def paths_of(rows):
    paths = conversations.Paths()
    for role, text, fault in rows:
        paths.row(role, text, fault)
    return paths.end()


def sha(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_least_edits_by_brute_force():
    own = random.Random(2)
    kinds = list(product(["system", "user", "assistant", "tool", ""], [None, "truncated", "blank"]))
    cases = [list(c) for n in (0, 1) for c in product(kinds, repeat=n)] + [[own.choice(kinds) for _ in range(n)] for n in (2, 3) for _ in range(25)]
    for case in cases:
        rows = [(role, f"t{k}", fault) for k, (role, fault) in enumerate(case)]
        cost, audit, lines = brute(rows)
        assert paths_of(rows) == (cost, audit, sha(lines)), case
        assert by_strings(rows)[:2] == (cost, audit)


@pytest.mark.parametrize("roles", [["user", "assistant"], ["user"], ["system", "user"], ["assistant", "user", "system", "x"]])
def test_long_conversations_keep_short_integers(roles):
    own = random.Random(3)
    rows = [(own.choice(roles), "t", own.choice([None, None, None, "truncated", "blank"])) for _ in range(700)]
    cost, audit, lines = by_strings(rows)
    assert paths_of(rows) == (cost, audit, sha(lines))
    paths = conversations.Paths()
    for role, text, fault in rows * 20:
        paths.row(role, text, fault)
    assert paths.width < 200 and all((w or 0).bit_length() < 2000 for w in paths.weights)
    held = [("system", "t", None)] + [("user", "", "blank")] * 2000  # nothing decides until the end
    assert paths_of(held)[:2] == by_strings([*held])[:2]


def talks():
    own, rows = random.Random(4), []
    for c in range(60):
        for t in range(own.choice([1, 2, 5, 9])):
            role = own.choice(["system", "user", "assistant", "user", "assistant", None])
            rows.append((c, own.choice([t, t, t, None, 3]), role, own.choice([None, "", " \n", "Yes.", "Yes.", f"no {t}", prose(3, t) + "! "])))
    return rows + [(None, 1, "user", "Hello?"), (None, 2, "assistant", "Hello."), *rows[:20], (99, 0, "user", "x" * 200_000), (100, -(1 << 62), "u", "a."), (100, 1 << 62, "a", "b.")]


def test_repair_of_rows_of_all_kinds(spark):
    rows = talks()
    table = frame(spark, rows, TALK)
    damaged, want = {}, {}
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, role or " ", " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        damaged.setdefault(conv_id, []).extend([(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    lines_of = {}
    for conv_id, part in damaged.items():
        found = judged(part)
        turns = {t for t, *_ in found if t is not None}
        faults = Counter(f for *_, f in found)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:], strict=False)]
        cost, audit, lines = by_strings([f[1:] for f in found])
        gaps = min(max(turns) - min(turns) + 1 - len(turns), (1 << 63) - 1) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        want[conv_id] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha(lines))
        lines_of[conv_id] = list(lines)
    report = conversations.repair(conversations.damage(table)).cache()
    assert {r[0]: tuple(r[1:]) for r in report.collect()} == want
    edited = conversations.repaired(conversations.damage(table), report).collect()
    for conv_id, lines in lines_of.items():
        mine = sorted((r.place, r.edit, r.role, r.text) for r in edited if r.conv_id == conv_id)
        assert "".join(e for _, e, *_ in mine) == want[conv_id][6]
        assert [(role, text) for _, e, role, text in mine if e != "D"] == lines
    more = table.select("*", *[F.lit("x").alias(c) for c in ("copies", "fault", "again", "last", "there", "audit", "place")])
    assert rows_of(conversations.repair(conversations.damage(more))) == rows_of(report)
    assert conversations.repair(conversations.damage(table.limit(0))).count() == 0
    whole = conversations.repair(conversations.rows_of(table))
    assert whole.count() == len(want)


# Spelling


def brute_variants(rows, at_least=7):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= at_least and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    met = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            met[a].append(b)
            met[b].append(a)
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n[w], len(met[w]), n[form[w]] if form[w] else None))
    return found, n, met


def misspelt(own, n_docs=60):
    bases = ["".join(w)[:own.randint(7, 12)] for w in product(["anton", "éstra", "aaaaaaa", "bere"], ["aaaa", "ifica", "ßüöäta", "xyz"])]
    bases = [b for b in bases if len(b) >= 7]
    rows = []
    for d in range(n_docs):
        text = []
        for _ in range(120):
            w = own.choice(bases[: own.choice([3, len(bases)])])
            if own.random() < 0.3:
                k, kind = own.randrange(len(w)), own.randrange(3)
                c = own.choice("abé")
                w = (w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :])[kind]
            text.append(w.upper() if own.random() < 0.1 else w)
        rows.append((d if d % 7 else None, own.choice([" ", ", ", "1"]).join(text)))
    return [*rows, (5, None), (6, ""), (7, "× ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷ " * 2), rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_by_brute_force(spark, seed):
    rows = misspelt(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want, _, _ = brute_variants(rows)
    found = spelling.variants(docs).cache()
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("word", "n", "form", "root", "key", "near")])
    assert rows_of(spelling.variants(more)) == rows_of(found)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert rows_of(spelling.variants(frame(spark, documents()))) == rows_of(spelling.variants(clashing(frame(spark, documents()))))


def test_near_words_in_long_lists(spark, monkeypatch):
    """Hundreds of words with frequent grams, in lists dealt in small blocks, each pair once."""
    own = random.Random(6)
    stems = ["".join(own.choice("ab") for _ in range(own.choice([7, 8, 9]))) for _ in range(900)]
    monkeypatch.setattr(spelling, "LISTS", 10_000)
    _, n, met = brute_variants([(2, " ".join(stems * 2))])
    words_ = spark.createDataFrame(list(n.items()), "word STRING, n BIGINT")
    for share, size in ((4096, 20), (2, 4096), (50, 64)):
        found = [tuple(r) for r in spelling.near_words(words_, 7, share, size).collect()]
        assert sorted(found) == sorted((w, o, n[o]) for w, others in met.items() for o in others)


# Sets


def sets_of_texts(texts_, n=3):
    out = []
    for t in texts_:
        parts = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if len(parts) >= n else {tuple(parts)} if parts else set())
    return out


def brute_join(rows, percent=90):
    sets = sets_of_texts([t for _, t in rows])
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = groups(range(len(rows)), links)
    ids = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            ids[found[at]] = min(ids.get(found[at], i), i)
    return sorted(repr((i, len(s), ids.get(found[at]))) for at, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def varied(own):
    rows = []
    for size in (1, 2, 3, 5, 9, 11, 12, 20, 40, 60, 90, 300, 900):
        for _ in range(3):
            base = words(size, own.randrange(1 << 30))
            for _ in range(5):
                near = list(base)
                for _ in range(own.randrange(1 + size // 40 + 1)):
                    near[own.randrange(len(near))] = "other"
                near = near + words(own.choice([0, 0, size // 20, size // 9]), own.randrange(1 << 30))
                rows.append((len(rows), own.choice([" ", "\n"]).join(near[own.choice([0, 0, 1]) :])))
    return rows


@pytest.mark.parametrize("percent, block", [(90, 512), (90, 3), (70, 5), (100, 7)])
def test_join_by_brute_force(spark, percent, block):
    """Texts appended to, cut and changed, of all sizes; copies, ties, repeats, empty texts, null ids."""
    rows = varied(random.Random(percent + block))
    rows += [(5000, ""), (5001, None), (None, " \n"), (5002, "Two words"), (5003, "two\tWORDS"), (None, rows[40][1]), rows[41], rows[41], (None, "alone " + prose(30, 8))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = sorted(repr(tuple(r)) for r in setjoin.join(docs, percent=percent, block=block).collect())
    assert found == brute_join(rows, percent)


def test_join_in_a_dense_group(spark):
    own, base, rows = random.Random(9), words(150, 77), []
    for k in range(200):
        text = list(base)
        for at in own.sample(range(150), own.randint(1, 4)):
            text[at] = f"{text[at]}{own.randrange(1000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(repr(tuple(r)) for r in setjoin.join(docs, block=40).collect()) == brute_join(rows)


def test_join_of_rows_of_all_kinds(spark):
    docs = frame(spark, documents())
    found = setjoin.join(docs)
    assert rows_of(found) == rows_of(setjoin.join(clashing(docs)))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_join([(d[0], d[1]) for d in documents()])
    assert setjoin.join(docs.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    own = np.random.default_rng(5)
    for n in [1, 2, 8, 9, 10, 12, 18, 19, 21, 40, 57, 60, 64, 200, 1500] * 3:
        limits = setjoin.bands(90, 4 * n + 40)
        for m in {n, n + 1, n * 10 // 9, int(n * 1.05)}:
            differ = setjoin.differing(n + m, 90)
            shared = (n + m - differ) // 2 + (n + m - differ) % 2
            pool = own.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
            if shared > n or 100 * shared < 90 * (n + m - shared) or len(b) != m:
                continue
            of = [next(k for k, (_, high) in enumerate(limits) if len(x) <= high) for x in (a, b)]
            marks = [set(setjoin.both_signatures(x, k, limits, 90).tolist()) for x, k in zip((a, b), of, strict=True)]
            assert marks[0] & marks[1], (n, m)
            apart = np.bitwise_count(
                setjoin._folded(np.frombuffer(setjoin.sketch(a), np.uint64)[None, :], 1) ^ setjoin._folded(np.frombuffer(setjoin.sketch(b), np.uint64)[None, :], 1)
            ).sum()
            assert apart <= n + m - 2 * shared


def test_lists_across_batches(spark):
    own = random.Random(8)
    rows = [(own.randrange(40), own.randrange(12)) for _ in range(500)] + [(99, 1)] * 50 + [(98, 7), (98, 9)]
    held = {}
    for s, n in rows:
        held.setdefault(s, set()).add(n)
    want = sorted((s, n, min(x)) for s, x in held.items() if len(x) > 1 for n in x)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = setjoin.lists_of(spark.createDataFrame(rows, "signature BIGINT, node BIGINT"))
            assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
