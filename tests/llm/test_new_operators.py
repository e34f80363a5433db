"""Code compression, line removal and ranked search against brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vectorloom.llm import codes, linededup, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).selectExpr("*", "'x' AS h", "1 AS id", "2 AS term", "3 AS pos", "4 AS key", "5 AS impact0", "true AS some", "6 AS rank")


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [max(-(1 << 27), min(1 << 27, math.floor(4096 * float(np.float32(x))))) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    edge = codes.bounds(len(kept[0][2]), parts)
    kept = [r for r in kept if len(r[2]) == edge[-1]]
    cut = [[r[2][a:b] for a, b in zip(edge, edge[1:])] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    best = lambda v, book: min((far(v, w), k) for k, w in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[best(c[p], books[p])[1]].append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    total = Counter()
    for r, f in zip(kept, found):
        total[r[1]] += sum(d for d, _ in f)
    digest = sha(",".join(str(x) for b in books for w in b for x in w))
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[r[1]], digest) for r, f in zip(kept, found))


@pytest.mark.parametrize("wide", [16, 19])
def test_codes_against_plain(spark, wide):
    r = random.Random(wide)
    vector = lambda: [r.gauss(0, 1) for _ in range(wide)]
    rows = [(i, r.choice([None, 1, 2]), vector()) for i in range(90)]
    rows += [(90, 1, None), (91, 1, []), (92, 1, [None] + vector()[1:]), (93, 2, [math.inf] * wide), (94, 2, [math.nan] * wide), (95, 3, vector()[:-1]), (None, None, vector()), (96, 1, rows[0][2]), (96, 1, rows[0][2]), (97, 4, [1e30, -1e30] + vector()[2:])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' AS q", "1 AS code", "2 AS error")
    got = sorted((str(x["vec_id"]), x["code"], x["error"], x["label_error"], x["codebooks_sha256"]) for x in codes.compressed(df).collect())
    assert got == plain_codes(rows, 8)
    few = rows[:5]
    got = sorted((str(x["vec_id"]), x["code"], x["error"], x["label_error"], x["codebooks_sha256"]) for x in codes.compressed(df.where("vec_id < 5")).collect())
    assert got == plain_codes(few, 8)
    assert codes.compressed(df.limit(0)).count() == 0 and codes.compressed(df.where("vec_id in (90, 93)")).count() == 0


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 400)] + rng.integers(-300, 300, (400, 8))
    index, far, refined = codes.nearest(parts, centres)
    every = ((parts[:, None] - centres[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (far == every.min(1)).all()
    assert refined.mean() < 4 and refined.min() >= 1
    same = np.zeros((3, 2), np.int64)
    assert codes.nearest(np.array([[5, -5]]), same)[0].tolist() == [0]


def plain_lines(rows, least=20, documents=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    doc = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(doc(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < documents or max(held[key(x)]) == doc(i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_plain(spark, monkeypatch):
    r = random.Random(4)
    pool = [f"line number {k} of the shared pool " + "é" * (k % 3) for k in range(12)] + ["short", "", "  ", "x" * 19, "y" * 20, "\tTRAILING Shared Line of Text\r", "trailing shared line of text", "ÉTOILE shared line of a text", "étoile shared line of a text"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (3, rows[3][1]), (4, "y" * 20 + "\n" + rows[7][1]), (None, rows[5][1]), (None, pool[0]), (103, "\n".join(pool[0] if k % 3 else str(k) for k in range(3000))), (104, "z" * 50000 + "\n" + pool[1])]
    got = lambda: sorted((str(x["doc_id"]), x["n_lines"], x["n_dropped"], x["kept"], x["kept_sha256"]) for x in linededup.dedup(table(spark, rows), texts=True).collect())
    want = [(*x, sha(x[3])) for x in plain_lines(rows)]
    assert got() == want
    # the way of hot keys, for every key
    monkeypatch.setattr(linededup, "hot_keys", lambda counts, key: counts.select(*key))
    assert got() == want
    assert linededup.dedup(table(spark, rows).limit(0)).count() == 0


def test_keep_bitmaps_are_runs(spark):
    common = "a line that is in all documents"
    rows = [(i, f"{common}\n{common}\nown {i}\n{common}") for i in range(4)]
    got = {x["id"]: [tuple(y) for y in x["gone"]] for x in linededup.bitmaps(table(spark, rows)).collect()}
    assert got == {i: [(0, 1), (3, 3)] for i in range(3)}


def plain_search(docs, items, most=20):
    bags = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total, df = len(bags), sum(b.total() for _, b in bags), Counter(w for _, b in bags for w in b)
    asked = {}
    for i, t in items:
        asked[i] = t if asked.get(i) is None else asked[i] if t is None else min(t, asked[i])
    out = []
    for item, t in asked.items():
        scores = []
        for i, b in bags:
            m = 100 - 25 + (25 * b.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 12 * m)) for w in TERM.findall((t or "").translate(FOLD)) if b[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(str(item), k + 1, str(None if none else i), -s) for k, (s, none, i) in enumerate(sorted(scores)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("most", "seed"), [(20, 1), (3, 2), (1, 3)])
def test_search_against_plain(spark, monkeypatch, most, seed):
    monkeypatch.setattr(ranked, "BLOCK", 5)
    monkeypatch.setattr(ranked, "ROWS", 7)
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "naïve", "東京", "Mixed", "a1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ,".join(r.choices(words, weights, k=n))
    docs = [(i, text(r.randint(1, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "...!?"), (None, text(9)), (None, text(9)), (3, text(5)), (203, text(9)), (204, text(4000))]
    docs += [(300 + k, docs[5][1]) for k in range(25)]
    items = [(i, text(r.randint(1, 12))) for i in range(12)] + [(20, None), (21, "unheard"), (22, "--"), (None, "w1 W2 w2"), (5, "w3"), (23, "É é w59 w58")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS n")
    got = sorted((str(x["item_id"]), x["rank"], str(x["doc_id"]), x["score"]) for x in ranked.search(table(spark, docs).repartition(3), frame, most).collect())
    assert got == plain_search(docs, items, most)


def test_search_proves_at_high_tiers(spark, monkeypatch):
    seen = []
    scan = ranked._scan
    monkeypatch.setattr(ranked, "_scan", lambda items, upto, most, proof: seen.append((upto, proof is not None, len(np.unique(items.item)))) or scan(items, upto, most, proof))
    rare = [(i, "common words here " * 3 + f"topic{i // 5} " * 4) for i in range(400)]
    items = spark.createDataFrame([(k, f"topic{k} common here") for k in range(6)], "item_id long, text string")
    got = sorted((str(x["item_id"]), x["rank"], str(x["doc_id"]), x["score"]) for x in ranked.search(table(spark, rare), items, 5).collect())
    assert got == plain_search(rare, items.collect(), 5)
    assert any(proof for _, proof, _ in seen) and not any(upto == ranked.TIERS - 1 for upto, _, _ in seen)


def test_empty_tables(spark):
    docs, items = table(spark, [(1, "a b"), (2, "b")]), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert [tuple(x)[:3] for x in ranked.search(docs, items).collect()] == [(1, 1, 2), (1, 2, 1)]
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0


def test_samples_at_any_size():
    from vectorloom.llm import sampling

    assert sampling.bound(10, 10) is None and sampling.bound(10, 3) is None
    for n in (11, 10**6, 10**9, 4 * 10**9, 10**12, 10**15):
        taken = sampling.bound(10, n) + (1 << 63)
        assert 0 < taken < 1 << 64 and abs(taken / (1 << 64) * n - 10) < 1e-3


def test_samples_of_huge_tables_are_not_empty(spark, monkeypatch):
    """With the counts of a table of 1e12 rows the share of hashes is small but there; a sample that still comes out empty is an error, not a field that knows nothing."""
    from vectorloom.llm import secrets

    docs = table(spark, [(i, f"plain text {i}") for i in range(50)])
    monkeypatch.setattr(secrets, "bound", lambda wanted, n: -(1 << 63) + (wanted << 64) // 10**12)
    with pytest.raises(ValueError):
        secrets.fit(docs)
    assert secrets.sample(docs.limit(0)).count() == 0


def test_toxicity_against_plain_recursion(spark):
    """The query's scores by forward and backward recursion in plain Python and a logistic function, from texts alone."""
    from vectorloom.llm import queries, toxicity
    from vectorloom.llm.textcore import tokenize

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.field is not None
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    assert len(got) == docs.count()
    trans = model.field.trans
    soft = lambda *x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    for doc, text in docs.select("doc_id", "text").collect():
        t = tokenize([text or ""])
        e = model.field.emissions(toxicity.features(t)) if len(t.start) else np.zeros((0, 2))
        n, ahead, back = len(e), [], []
        for k in range(n):
            ahead.append([e[k][s] + (soft(*(ahead[-1][p] + trans[p][s] for p in (0, 1))) if k else 0) for s in (0, 1)])
        for k in reversed(range(n)):
            back.insert(0, [soft(*(trans[s][q] + e[k + 1][q] + back[0][q] for q in (0, 1))) if k < n - 1 else 0.0 for s in (0, 1)])
        p = [1 / (1 + math.exp((ahead[k][0] + back[k][0]) - (ahead[k][1] + back[k][1]))) for k in range(n)]
        z = model.coef[0] + model.coef[1] * math.log1p(sum(x for x in p if x > 0.01)) + model.coef[2] * max((x for x in p if x > 0.01), default=0.0)
        want = 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))
        assert abs(got[doc]["score"] - want) < 1e-4
        assert got[doc]["predicted"] == int(got[doc]["score"] >= 0.3)


def test_one_text_stands_for_a_repeated_id(spark):
    """Of the texts of one doc_id only the least by SHA-256 counts, however often and in what order its rows come."""
    from vectorloom.llm import dartminhash

    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    one, two = text(), text()
    least, other = sorted((one, two), key=lambda t: hashlib.sha256(t.encode()).digest()[:16])
    near = lambda t: t + " tail"
    rows = [(1, near(least)), (2, near(other)), (5, one), (5, two), (5, other), (5, least)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {x["doc_id"]: x["class_id"] for x in dartminhash.classes(table(spark, rows).repartition(3)).collect()}
        assert got == {1: 1, 2: 2, 5: 1}
