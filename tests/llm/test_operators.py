"""Edge cases on small tables, and each operator against brute force."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import crf, dartminhash, decontam, editprint, queries, secrets, spm, storage, substrings, textcore, tokencounts, toolchat, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def table(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls, empty, white space, repeated rows, a null id, a long text, and columns named as operators name their own."""
    long = prose(4000, 9)
    df = table(spark, [None, "", " \t\n", "a", "a", prose(30), prose(30), long, "é🎉x", None], [0, 1, 2, 3, 3, 5, 6, 7, None, 9])
    return df.selectExpr("*", "'x' AS h", "1 AS id", "2 AS key", "3 AS hits", "4 AS copy", "5 AS bucket")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_viterbi_and_marginals_against_enumeration(monkeypatch):
    monkeypatch.setattr(crf, "PIECE", 4)
    rng = np.random.default_rng(0)
    m = crf.Model(np.zeros((2, 3), np.float32), rng.normal(size=(3, 3)))
    lens = [0, 5, 1, 7, 0, 6]
    doc = np.repeat(np.arange(len(lens)), lens)
    e = rng.normal(size=(len(doc), 3))
    tags, marg = crf.viterbi(m, e, doc, len(lens)), crf.marginals(m, e, doc, len(lens))
    at = 0
    for n in lens:
        own, total, z = [], np.zeros((n, 3)), 0.0
        for p in itertools.product(range(3), repeat=n):
            q = (0, *p, 0)
            s = sum(m.trans[a, b] for a, b in itertools.pairwise(q)) + sum(e[at + i, x] for i, x in enumerate(p))
            own.append((s, p))
            z += np.exp(s)
            for i, x in enumerate(p):
                total[i, x] += np.exp(s)
        assert tuple(tags[at : at + n]) == max(own)[1]
        assert np.allclose(total / z, marg[at : at + n], atol=1e-6)
        at += n


def test_secret_base_spans():
    key = "AKIA" + "A1" * 9
    text = f"x password= 'abc' API-KEY: 12 api_key: \"hello.world\" {key} AKIASHORT {'a' * 23} {'0f' * 12}"
    assert [(k, text[s:e]) for s, k, e in secrets.base_spans(text)] == [(0, 'api_key: "hello.world'), (1, key), (2, "0f" * 12)]
    assert secrets.base_spans("") == []


def base_plain(text):
    """The base patterns, character by character."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, of):
        while at < len(text) and text[at] in of:
            at += 1
        return at

    def assign(at):
        low = "".join(c.lower() if c.isascii() else "?" for c in text[at : at + 8])
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name):
                k = at + len(name)
                k += text[k : k + 1] in ('"', "'")
                k = run(k, " ")
                if text[k : k + 1] not in (":", "="):
                    continue
                k = run(k + 1, " ")
                k += text[k : k + 1] in ('"', "'")
                end = run(k, word)
                if end > k:
                    return end, end - k >= 6
        return None

    def access(at):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        return (end, end - at >= 20) if text.startswith("AKIA", at) and end > at + 4 else None

    def hexa(at):
        end = run(at, "0123456789abcdef")
        return (end, end - at >= 24) if end > at else None

    out = []
    for rank, find in enumerate((assign, access, hexa)):
        at = 0
        while at < len(text):
            hit = find(at)
            if hit and hit[1]:
                out.append((at, rank, hit[0]))
            at = hit[0] if hit else at + 1
    return sorted(out)


def test_secret_base_columns_against_brute_force(spark):
    r = random.Random(8)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "paſſword", "toKen", '"', "'", " ", "  ", "\t", ":", "=", "==", "abc", "abcdef", "A1+/_.=-", "AKIA", "AKIAAKIA", "Z9" * 8, "0af" * 7, "0af" * 9, "F0", "é", "\n", "."]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    got = by_id(secrets.SecretScan(secrets.fit_texts([])).spans(table(spark, texts)))
    n = 0
    for i, t in enumerate(texts):
        want = base_plain(t or "")
        n += len(want)
        name = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3)), t
        assert got[i]["base_sha256"] == sha(name) and got[i]["spans"] == name
    assert n > 300


def test_secret_field_on_forms_it_has_not_seen(spark):
    """Names that are not in the training data, values of several alphabets; clean texts stay clean; the sample does not depend on the layout."""
    texts = [prose(60, i) + (f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + prose(9, i) if i % 8 == 0 else "") for i in range(400)]
    model = secrets.fit_texts(texts)
    r = random.Random(3)
    for form in ('passphrase = "{}"', "signing_key: '{}'", "dbcode = {}"):
        hits = 0
        for i in range(60):
            value = "".join(r.choices("ABCDEFabcdef0123456789", k=24)) + "7"
            text = prose(20, 900 + i) + " " + form.format(value) + " " + prose(20, 990 + i)
            at = text.index(value)
            hits += any(k == 3 and s <= at and at + len(value) <= e for s, k, e in secrets.scan_texts([text], model)[0])
        assert hits >= 48, form
    assert not any(secrets.scan_texts([prose(100, 5000 + i) for i in range(200)], model))
    text = prose(20, 1) + ' password = "abcdef12$ghi90jkl34" ' + prose(20, 2)
    assert "[SECRET]" in by_id(secrets.SecretScan(model).redact(table(spark, [text])))[0]["text"]
    assert secrets.outside(2, 20, [(0, 0, 4), (6, 2, 8), (18, 1, 30)]) == [(4, 6), (8, 18)] and secrets.outside(2, 4, [(0, 0, 9)]) == []
    df = table(spark, texts)
    assert [r[0] for r in secrets.sample(df).collect()] == [r[0] for r in secrets.sample(df.repartition(7)).collect()]


def test_secret_scan_cases(spark):
    texts = [prose(20, i) + f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + prose(20, i + 99) for i in range(40)]
    model = secrets.fit_texts(texts + [prose(60, 500 + i) for i in range(60)])
    other = prose(20, 7) + ' credential = "' + hashlib.sha1(b"q").hexdigest()[:20] + '" ' + prose(20, 8)
    found = secrets.scan_texts([other], model)[0]
    assert any(k == 3 for _, k, _ in found)
    got = secrets.SecretScan(model)
    rows = got.spans(odd(spark)).collect()
    assert len(rows) == 10 and all(r["spans"] == "" and r["base_sha256"] == sha("") for r in rows if r["doc_id"] in (0, 1, 2))
    assert got.spans(empty(spark)).count() == 0
    red = by_id(got.redact(table(spark, [texts[0], None])))
    assert "[SECRET]" in red[0]["text"] and red[0]["n_chars"] == len(red[0]["text"]) and red[1]["text"] is None
    assert secrets.fit_texts([]).states == 3


def test_toxicity_held_out_and_cases(spark):
    bad = ["grumpf", "zoltan", "quaxle", "brimble"]
    r = random.Random(1)
    texts, y = [], []
    for i in range(300):
        w = prose(80, i).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", "er", "est"]))
        texts.append(" ".join(w))
        y.append(i % 4 == 0)
    m = toxicity.fit_texts(texts[:200], y[:200])
    s = m.score(m.evidence(texts[200:]))
    assert ((s >= 0.3) == np.array(y[200:])).mean() >= 0.95
    spans = [[]]
    m.evidence(["one grumpf two"], spans)
    assert spans == [["4:10"]]
    rows = toxicity.score(odd(spark), m).collect()
    assert len(rows) == 10 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in rows)
    assert toxicity.score(empty(spark), m).count() == 0
    assert toxicity.fit_texts([], []).score(np.zeros((2, 2))).tolist() == [0, 0]
    kept = {x["doc_id"] for x in toxicity.keep_clean(table(spark, [texts[0], texts[1], None]), m).collect()}
    assert kept == {1, 2}


def linked(n, near):
    """The least number of each component."""
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if near(i, j):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return {i: root(i) for i in range(n)}


def test_fingerprints(spark):
    rows = [(i, t or "") for i, t in sorted({0: None, 1: "", 4: "ab", 300: prose(50), 700: prose(50), 701: prose(400, 3), 5000: "🎉é" * 9}.items(), reverse=True)]
    got = by_id(editprint.fingerprints(table(spark, [t or None for _, t in rows], [i for i, _ in rows])))
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        g = got[i]
        assert (g["n_chars"], g["edited_sha256"], g["fingerprint"], g["edited_fingerprint"]) == (len(t), sha(edited), editprint.fingerprint(t), editprint.fingerprint(edited))
        assert g["near_next"] == editprint.likeness(editprint.fingerprint(t), editprint.fingerprint(nxt))
    assert got[701]["near_edited"] > 0.6 > 0.3 > got[701]["near_next"]
    assert editprint.fingerprints(odd(spark)).count() == 10
    assert editprint.fingerprints(empty(spark)).count() == 0
    one = editprint.fingerprints(table(spark, ["abc"])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == sha("aba")


def edited(text, share, seed):
    r, out = random.Random(seed), list(text)
    for _ in range(int(share * len(text))):
        k = r.randrange(len(out))
        out[k : k + 1] = r.choice(([], [r.choice("abcdefghij")], [out[k], r.choice("abcdefghij")]))
    return "".join(out)


@pytest.mark.parametrize("all_pairs", [16, 2])
def test_edit_classes_against_brute_force(spark, all_pairs, monkeypatch):
    """Families of edited texts, in small buckets and in ones that are searched by rare tokens: all links between texts that share a bucket, and nearly all of all."""
    monkeypatch.setattr(dartminhash, "ALL_PAIRS", all_pairs)
    texts = [edited(prose(120, f), share, 100 * f + c) for f in range(8) for c, share in enumerate((0, 0, 0.001, 0.003, 0.006, 0.01, 0.03))]
    texts += [prose(100 + 10 * k, 700 + k) for k in range(10)] + ["", None, "a", "a", "ab", prose(3, 9)]
    prints = [editprint.fingerprint(t or "") for t in texts]
    x = [editprint._read(p) for p in prints]
    alike = lambda i, j: prints[i] == prints[j] or editprint.agreement(x[i], x[j]) >= 0.8
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(i, j)]
    got = {r["doc_id"]: r["class_id"] for r in editprint.near(table(spark, texts)).collect()}
    want = linked(len(texts), alike)
    assert len(pairs) > 60 and all(got[i] == got[j] for i, j in pairs) and got == want
    keys = [set(editprint.band_keys(p)) for p in prints]
    assert sum(bool(keys[i] & keys[j]) or prints[i] == prints[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert len(editprint.near(odd(spark)).collect()) == 10 and editprint.near(empty(spark)).count() == 0


def test_edit_links_at_the_threshold(spark):
    """Pairs that differ in as many samples as they may, of all lengths and spread so that few blocks stay whole: none is lost."""
    r = random.Random(5)
    symbols = editprint.ALPHABET.tobytes().decode()
    prints = []
    for n in [*range(1, 90), *range(100, 500, 23), 640, 900] * 2:
        x = [r.choice(symbols) for _ in range(n)]
        cut = r.choice((0, 0, editprint.missed(n) // 2))
        y = x[: n - cut]
        left = editprint.missed(n) - cut
        for k in range(left) if r.random() < 0.5 else ():
            y[min(k * 5, len(y) - 1)] = r.choice(symbols)
        for k in r.sample(range(len(y)), left):
            if editprint.agreement(np.frombuffer("".join(x).encode(), np.uint8), np.frombuffer("".join(y).encode(), np.uint8)) > 0.8 + 1 / n:
                y[k] = r.choice(symbols)
        prints += ["".join(x), "".join(y)]
    codes = [editprint._read(p) for p in prints]
    alike = lambda i, j: prints[i] == prints[j] or editprint.agreement(codes[i], codes[j]) >= 0.8
    pairs = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if alike(i, j)]
    assert sum(prints[i] != prints[j] and len(prints[i]) < 64 for i, j in pairs) > 50
    for i, j in pairs:
        assert prints[i] == prints[j] or set(editprint.band_keys(prints[i])) & set(editprint.band_keys(prints[j]))
        differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in editprint.sketch(prints[i]) ^ editprint.sketch(prints[j]))
        assert differ <= editprint.missed(max(len(prints[i]), len(prints[j])))
    got = {x["doc_id"]: x["class_id"] for x in editprint.classes(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()}
    assert got == linked(len(prints), alike)


def test_texts_that_agree_on_many_blocks_meet_once(spark, monkeypatch):
    """A crowd with one beginning and ends of their own: no links, and no pair of them is looked at once a block that it shares."""
    r = random.Random(7)
    symbols = editprint.ALPHABET.tobytes().decode()
    same = "".join(r.choice(symbols) for _ in range(140))
    prints = [same + "".join(r.choice(symbols) for _ in range(60)) for _ in range(60)]
    seen, keep = [], storage.Workspace.written
    monkeypatch.setattr(storage.Workspace, "written", lambda self, df, name, *more: (lambda out: (seen.append(out.agg(F.sum("shared")).first()[0] or 0) if name.startswith("maybe-") else None) or out)(keep(self, df, name, *more)))
    got = {x["doc_id"]: x["class_id"] for x in editprint.classes(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()}
    assert got == {i: i for i in range(60)}
    assert seen and sum(seen) <= 60 * 59 // 2


def test_crowds_are_dealt_to_tiles_and_travel_once(spark, monkeypatch):
    """A crowd with one beginning, dealt to small tiles, some of whose texts have an edited one beside them: all links are found, and each text is shuffled once for each of its blocks."""
    monkeypatch.setattr(editprint, "TILE", 16, raising=False)
    monkeypatch.setattr(editprint, "COUNTED", 1, raising=False)
    monkeypatch.setattr(editprint, "COMPARED", 64, raising=False)
    r = random.Random(8)
    symbols = editprint.ALPHABET.tobytes().decode()
    same = "".join(r.choice(symbols) for _ in range(60))
    prints = [same + "".join(r.choice(symbols) for _ in range(100)) for _ in range(50)]
    for x in prints[::5]:
        y = list(x)
        for k in r.sample(range(160), 31):
            y[k] = r.choice(symbols)
        prints.append("".join(y))
    codes = [editprint._read(p) for p in prints]
    shuffles, keep = [], storage.Workspace.written
    monkeypatch.setattr(storage.Workspace, "written", lambda self, df, name, *more: (shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL")) if name.startswith("maybe-") else None) or keep(self, df, name, *more))
    got = {x["doc_id"]: x["class_id"] for x in editprint.classes(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()}
    assert got == linked(len(prints), lambda i, j: editprint.agreement(codes[i], codes[j]) >= 0.8) and len(set(got.values())) == 50
    assert shuffles == [1]


def test_pairs_of_a_key_against_brute_force(monkeypatch):
    """Pairs that meet in a key: of different class, with other blocks before, across the sides of a tile; near by length and by both sketches."""
    monkeypatch.setattr(editprint, "COMPARED", 32)
    r = random.Random(9)
    width = editprint.LONGS * editprint.PLANES
    base = [np.array([r.getrandbits(64) for _ in range(width)], np.uint64) for _ in range(3)]
    rows = []
    for key in range(-4, 4):
        for side in ((0,), (1, 2))[key % 2]:
            for _ in range(r.choice((1, 20, 40))):
                flips = np.array([1 << r.randrange(64) for _ in range(width)], np.uint64) * np.uint64(r.random() < 0.8)
                rows.append((key, len(rows) - 30, r.randrange(3), r.randrange(3), side, r.choice((50, 55, 100)), r.choice(base) ^ flips))
    columns = {c: np.array([x[k] for x in rows]) for k, c in enumerate(("key", "rep", "label", "before", "side", "n", "sketch"))}
    got = [tuple(sorted((int(i), int(j)))) for x, y in editprint.Met(columns, 0.8).every() for i, j in zip(x, y, strict=True)]

    def near(x, y):
        bits = sum((int(x[6][k] ^ y[6][k]) | int(x[6][k + editprint.LONGS] ^ y[6][k + editprint.LONGS])).bit_count() for k in range(editprint.LONGS))
        return min(x[5], y[5]) >= 0.8 * max(x[5], y[5]) and bits <= editprint.missed(max(x[5], y[5]))

    want = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (x := rows[i])[0] == (y := rows[j])[0] and x[2] != y[2] and x[3] != y[3] and (x[4] == 0 or x[4] != y[4]) and near(x, y)]
    assert len(want) > 20 and sorted(got) == want


def test_token_ids_of_long_white_space():
    e = tokencounts.encoder(tokencounts.default_vocabulary())
    for t in ("a" + " " * 20000 + "b", "a" + "\n" * 20000, " " * 12000 + "\n x", "x" + "\t" * 12001 + "\xa0y " + "\u3000" * 10000, "\u2028" * 10000 + "z"):
        assert e.ids(t) == e.bpe.encode_ordinary(t)
    for t in (" " * 1_000_000, "a" + " " * 2_000_000 + "b", "w" * 2_000_000, "!" * 2_000_000):
        ids, start, end = e.spans(t)
        assert start[0] == 0 and end[-1] == len(t) and (start[1:] == end[:-1]).all()


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, rule):
    texts = ["one two\nthree\n\nfour é🎉 five\n", "", None, "\n\n\n"]
    got = by_id(tokencounts.section_counts(table(spark, texts), rule))
    e = tokencounts.encoder(tokencounts.default_vocabulary())
    for i, t in enumerate(texts):
        t = t or ""
        low, high = tokencounts.lines(t)
        ids, start, end = e.spans(t) if t else ((), (), ())
        want = Counter()
        for s, f in zip(start, end, strict=True):
            over = [max(0, min(f, h) - max(s, lo)) for lo, h in zip(low, high, strict=True)]
            inside = [k for k, o in enumerate(over) if o]
            want[inside[0] if rule == "first" else inside[-1] if rule == "last" else max(inside, key=lambda k: over[k])] += 1
        assert got[i]["n_tokens"] == len(ids) and got[i]["counts"] == [want[k] for k in range(len(low))]
    assert tokencounts.section_counts(odd(spark)).count() == 10 and tokencounts.section_counts(empty(spark)).count() == 0
    f = tokencounts.field_counts(table(spark, ["a b c", None]), ["lang", "text"], "doc_id").orderBy("doc_id").collect()
    assert f[0]["lang_tokens"] == 1 and f[0]["text_tokens"] == 3 and f[1]["text_tokens"] == 0


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", None, None, "hi"), (1, 3, "call", "f", "x", '{"n": 1, "s": "q"}'), (1, 1, "tool", "f", "x", "done"), (1, 4, "call", "f", "y", '{"n": "1"}'), (1, 5, "call", "f", "y", "{}"),
        (1, 6, "tool", "f", "z", None), (1, 7, "call", "g", "w", "{}"), (1, 8, "call", "f", "v", "[1]"), (1, 9, "call", "f", "u", '{"n": 2, "s": "a", "t": 1}'), (None, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, name string, call_id string, text string")
    out = toolchat.formatted(df, {"f": {"n": "integer", "s": "string"}}).collect()
    got = {r["turn"]: (r["at"], r["step"], r["state"], r["valid"]) for r in out if r["conv_id"] == 1}
    assert got == {0: (0, 0, "said", None), 3: (3, 0, "call", "ok"), 1: (3, 1, "result", None), 4: (4, 0, "open", "kind:n"), 5: (5, 0, "repeated", "missing:n"), 6: (6, 0, "orphan", None), 7: (7, 0, "open", "unknown"), 8: (8, 0, "open", "invalid"), 9: (9, 0, "open", "extra:t")}
    ties = [(1, 0, "call", "f", "x", '{"b": 1, "a": {"d": [1, 2], "c": "é"}}'), (1, 0, "call", "f", "x", "{}"), (1, 2, "call", "f", "y", '{"a":{"c":"é","d":[1,2]},"b":1}'), (1, 3, "call", "f", "z", '{"s": "abcd", "n": 5}'), (1, 4, "call", "f", "q", '{"s": "abc", "n": 1}'), (1, 5, "call", "f", "q2", '{"s": "abc", "n": 5, "n": 5}')]
    tied = toolchat.formatted(spark.createDataFrame(ties, df.schema), {"f": {"n": "integer?>=3", "s": "string?<=3"}}).collect()
    assert sorted(r["state"] for r in tied if r["turn"] == 0) == ["open", "repeated"]
    content = {json.loads(r["message"])["content"] for r in tied if r["turn"] in (0, 2)}
    assert content == {'{"a":{"c":"é","d":[1,2]},"b":1}', "{}"}
    assert [r["valid"] for r in sorted(tied, key=lambda r: r["turn"])][-3:] == ["bounds:s", "bounds:n", "invalid"]
    chat = toolchat.transcript(toolchat.formatted(df, {})).where("conv_id = 1").first()["chat"]
    assert chat.startswith('{"messages":[{"content":"hi","role":"user","state":"said"},{"call_id":"x"')
    assert toolchat.formatted(df.limit(0), {"f": {}}).count() == 0


def test_sentencepiece_against_library(spark):
    e = spm.Encoder(spm.default_model())
    r = random.Random(3)
    texts = ["", " ", "a  ", "▁▁a ▁", "x▁y é　Ａ", "\n\t\0z", "<s> <0x0A>", "日本語 🎉"] + ["".join(r.choice(" ▁ab\n<>é日🎉0x") for _ in range(r.randint(1, 40))) for _ in range(300)]
    for t in texts:
        ids, spans, decoded = e.encode(t)
        assert ids == e.lib.encode(t) and decoded == e.lib.decode(ids)
        assert not len(spans) or (spans[0, 0] == 0 and spans[-1, 1] == len(t.encode()) and (spans[1:, 0] == spans[:-1, 1]).all())
    got = spm.digests(odd(spark)).collect()
    assert len(got) == 10 and all(g["n_tokens"] == 0 and g["ids_sha256"] == sha("") for g in got if g["doc_id"] in (0, 1, 9))
    full = spm.encode(table(spark, ["hello world"])).first()
    assert full["ids"] == e.lib.encode("hello world") and full["decoded"] == "hello world" and full["ends"][-1] == 11
    assert spm.encode(empty(spark)).count() == 0


def test_compiled_character_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pb.ModelProto()
    proto.ParseFromString(norm.serialized_model_proto())
    e = object.__new__(spm.Encoder)
    e.map = spm.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for t in ("ﬁ½Ａｶﾞ", "①②", "plain", "éx"):
        out, source = e.normalise(t)
        assert re.sub(" +", " ", out).strip() == norm.normalize(t).replace(spm.SPACE, " ").strip()
        assert len(source) == len(out.encode()) + 1 and source[-1] == len(t.encode()) and (np.diff(source) >= 0).all()


def shingle_set(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_decontamination(spark, monkeypatch):
    passage = prose(60, 1)
    w = passage.split()
    w2 = list(w)
    w2[30] = "changed"
    items = spark.createDataFrame([(0, passage), (1, prose(40, 2)), (2, None), (3, ""), (4, "two words"), (None, prose(9, 3)), (0, passage)], "item_id long, text string")
    docs = table(spark, [prose(900, 4) + "\n" + passage + " " + prose(500, 5), " ".join(w2), " ".join(w[:40]), None, "", "here are two words indeed", prose(50, 6)])
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontam.contained(docs, items).collect()}
    assert got == {(0, 0): 56, (1, 0): 51, (5, 4): 1}
    assert {r["doc_id"] for r in decontam.keep_clean(docs, items).collect()} == {2, 3, 4, 6}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontam.contained(docs, items).collect()} == got
    assert decontam.contained(docs, items.limit(0)).count() == 0 and decontam.contained(empty(spark), items).count() == 0
    assert decontam.contained(odd(spark), items).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 5, 300).astype(float), rng.uniform(0.2, 4, 300)
    sig = dartminhash.signatures(np.concatenate([h, h]), np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 3000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_near_duplicates_against_brute_force(spark):
    texts = []
    for f in range(6):
        base = prose(120, f).split()
        for c in range(30 if f == 0 else 4):
            w, r = list(base), random.Random(100 * f + c)
            for _ in range(c % 4):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [None, "", "", "short text", "short text", prose(40, 77)]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(table(spark, texts)).collect()}
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            total = sum(sets[i].values()) + sum(sets[j].values()) - low
            if (texts[i] or "") == (texts[j] or "") or (total and low / total >= 0.8):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    assert got == {i: root(i) for i in range(len(texts))}
    assert len(dartminhash.classes(odd(spark)).collect()) == 9  # two rows of one doc_id are one document
    assert dartminhash.classes(empty(spark)).count() == 0
    kept = [r["doc_id"] for r in dartminhash.keep_one(table(spark, ["x y", "x y", None], [4, 2, None])).collect()]
    assert sorted(kept, key=str) == [2, None]


def test_near_duplicates_in_large_buckets(spark):
    """A family 0.75 alike through shared text, among it pairs just over 0.8 that mostly share nothing but large buckets."""
    r = random.Random(4)
    shared = prose(200, 70).split()
    texts = []
    for p in range(150):
        pair = prose(8, 2000 + p).split()
        texts += [" ".join([*shared, *pair, *prose(24, 3000 + 2 * p + k).split()]) for k in range(2)]
    r.shuffle(texts)
    label = list(range(len(texts)))
    sets = [set(shingle_set(t)) for t in texts]
    pairs = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            label[j] = label[i]
            pairs += 1
    assert pairs == 150
    assert {x["doc_id"]: x["class_id"] for x in dartminhash.classes(table(spark, texts)).collect()} == dict(enumerate(label))


def test_near_duplicates_of_hub_chain_and_boilerplate(spark):
    """A text that is near to each of two hundred that are far from one another; a chain of small edits; pairs in shared boilerplate."""
    base = prose(400, 1)
    hub = [base] + [base + " " + prose(95, 100 + k) for k in range(200)]
    words = prose(200, 2).split()
    chain = []
    for k in range(40):
        words[5 * k : 5 * k + 5] = prose(5, 300 + k).split()
        chain.append(" ".join(words))
    shared = prose(300, 3)
    plate = [f"{shared} {prose(70, 400 + k // 2)} {prose(20, 500 + k)}" for k in range(60)]
    texts = [*hub, *chain, *plate]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    sets = [shingle_set(texts[i]) for i in order]
    size = [sum(s.values()) for s in sets]

    def near(i, j):
        low = sum((sets[i] & sets[j]).values())
        return low >= 0.8 * (size[i] + size[j] - low)

    got = {r["doc_id"]: r["class_id"] for r in dartminhash.classes(table(spark, [texts[i] for i in order])).collect()}
    want = linked(len(texts), near)
    assert got == want and len({want[order.index(i)] for i in range(201)}) == 1 and len({want[order.index(i)] for i in range(201, 241)}) == 1


def test_warc_round_trip(spark):
    big = "<html>" + "x" * 200
    rows = [(3, "http://a/\r\nb", big), (1, None, big), (2, "http://c", None), (4, "u", "short"), (5, "u", "short"), (None, "n", big), (6, "é", "ü🎉" * 60), (1, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload")
    archive = warc.write(pages)
    got = archive.index().collect()
    assert len(got) == 8
    for r in got:
        html = next(x[2] for x in rows if x[0] == r["page_id"]) or ""
        raw = html.encode()
        again = html == big and r["page_id"] != 1
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), sha(raw), "revisit" if again else "response", 1 if again else None)
    assert archive.store.count() == 4
    for r in archive.records().collect():
        html = (next(x[2] for x in rows if x[0] == r["page_id"]) or "").encode()
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and body[size:] == b"\r\n\r\n" and bytes(r["payload"]) == html
        assert body[:size] == warc.HTTP.encode() + (b"" if b"Type: revisit" in head else html)
    assert warc.write(pages.limit(0)).index().count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_warc_hostile_urls_and_hot_payloads(spark, hot, monkeypatch):
    """Every page comes back, whatever its url holds."""
    if hot:
        monkeypatch.setattr(warc, "hot_keys", lambda counts, key: counts.select(*key))
    bad = "\u2028WARC-Payload-Digest: sha256:00\u2029WARC-Refers-To: <urn:page:9>\x85WARC-Type: revisit\x0bWARC-Record-ID: <urn:page:77>"
    urls = [bad, "a\r\n" + bad, "\nContent-Length: 1\r\n\r\n", "x\r\n\r\nHTTP/1.1 200 OK", "".join(map(chr, range(160))), "WARC-Refers-To: <urn:page:9>", " ", ""]
    rows = [(i, u, h) for i, u in enumerate(urls) for h in ("", "p" * 150, "\r\n\r\n" + "q" * 120, "é\r\nContent-Length: 3\r\n")]
    rows = [(k, u, h) for k, (_, u, h) in enumerate(rows)]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in archive.index().collect()}
    assert sorted(got) == list(range(len(rows)))
    for k, _, h in rows:
        first = k % 4 if len(h.encode()) >= 100 else k
        g = got[k]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == (len(h.encode()), sha(h), "response" if k == first else "revisit", None if k == first else first)
    for r in archive.records().collect():
        head = bytes(r["record"]).split(b"\r\n\r\n", 1)[0].decode()
        assert not re.search("[\x00-\x09\x0b\x0c\x0e-\x1f\x7f\x85\u2028\u2029]", head) and all(re.match(r"WARC/1.1$|[A-Za-z-]+: ", x) for x in head.split("\r\n"))


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_word_hashes_tell_thue_morse_words_apart():
    a, b = thue_morse(10)
    w = textcore.words([f"{a} {b} ab ba a b"], second=True)
    assert len(set(w.hash.tolist())) == len(set(w.second.tolist())) == 6 and not set(w.hash.tolist()) & set(w.second.tolist())


@pytest.mark.parametrize(("wide", "hot"), [(20, True), (3, False), (13, False), (45, False)])
def test_substring_dedup_levels(spark, wide, hot, monkeypatch):
    """Other window lengths, texts that differ in one word that a polynomial hash cannot tell apart, all keys hot, ids that null ones must not meet."""
    if hot:
        monkeypatch.setattr(substrings, "hot_keys", lambda counts, key: counts.select(*key))
    assert substrings.levels(20) == [5, 10, 20] and substrings.levels(3) == [3] and substrings.levels(45) == [6, 12, 23, 45]
    a, b = thue_morse(10)
    line, tail = prose(12, 1), prose(12, 2)
    p = prose(60, 3)
    texts = [f"{line} {a} {tail}", f"{line} {b} {tail}", p, p[5:], p + " " + p, None, "x " * 100]
    rows = [*enumerate(texts), (2**63 - 1, p)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(table(spark, [t for _, t in rows], [i for i, _ in rows]), wide).collect()}
    assert got == dedup_plain(rows, wide)
    if wide == 20:
        both = substrings.dedup(table(spark, [p, p], [None, 2**63 - 1])).collect()
        assert {r["doc_id"]: r["n_removed"] for r in both} == {None: 60, 2**63 - 1: 0}


def dedup_plain(rows, wide=20):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        lost = [False] * len(w)
        for k in range(len(w) - wide + 1):
            x = tuple(w[k : k + wide])
            if x in seen:
                lost[k : k + wide] = [True] * wide
            seen.setdefault(x, (i, k))
        out[i] = (len(w), sum(lost), sha(" ".join(a for a, no in zip(w, lost, strict=True) if not no)))
    return out


def test_substring_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(textcore, "BLOCK_CHARS", 4000)
    r = random.Random(2)
    passages = [prose(r.randint(15, 60), 50 + k) for k in range(5)]
    texts = [" ".join(r.choice([prose(r.randint(1, 30), 1000 + i * 10 + k), r.choice(passages)]) for k in range(6)) for i in range(60)] + [None, "", "same " * 90, texts_tail := prose(19, 3), texts_tail]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = by_id(substrings.dedup(table(spark, [t for _, t in rows], [i for i, _ in rows]), texts=True))
    want = dedup_plain(rows)
    assert {i: (g["n_words"], g["n_removed"], g["kept_sha256"]) for i, g in got.items()} == want
    assert all(sha(g["kept"]) == g["kept_sha256"] for g in got.values())
    o = substrings.dedup(odd(spark)).collect()
    assert len(o) == 10 and {x["doc_id"]: x["n_removed"] for x in o}[6] == 30
    assert substrings.dedup(empty(spark)).count() == 0


def test_components(spark):
    from vectorloom.llm.graph import components
    from vectorloom.llm.storage import Workspace

    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 60), (60, 55)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(edges, Workspace(spark)).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 55: 50, 60: 50}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids", "decoded").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    one = dartminhash.keep_one(clean)
    free = decontam.keep_clean(one, spark.read.parquet(f"{SF}/benchmark.parquet"))
    left = {r["doc_id"]: r["text"] for r in secrets.SecretScan(secrets.fit(free)).redact(free).collect()}
    assert set(out) == set(left) and 0 < len(left) < docs.count()
    e = spm.Encoder(spm.default_model())
    assert all(list(out[i]["ids"]) == e.lib.encode(left[i]) for i in left)
    assert all(df.columns == docs.columns for df in (clean, one, free))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = Counter(tuple(r[k] for k in df.columns) for r in df.collect())
    assert rows == Counter(tuple(r[rel.columns.index(k)] for k in df.columns) for r in rel.fetchall())
