"""The grammar's table of moves and the choice of tokens, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import tokens

BINS = 64
T = tokens.TOKEN


def kind(t, geometry):
    if t < 256:
        return "byte"
    if t == tokens.EOS:
        return "eos"
    if tokens.COORD <= t < tokens.COORD + BINS:
        return "coord"
    name = next((k for k, v in T.items() if v == t), "other")
    for p in ("src", "cut_in", "cut_out"):
        if name.startswith(p + "_"):
            return p
    if name == ("line" if geometry == "linestring" else "poly"):
        return "geometry"
    return {"ring": "done_ring" if geometry == "polygon" else "other", "prop": "done_prop"}.get(name, name)


def walk(ids, geometry, least, most=0):
    state, points, objects = "start", 0, 0
    may = lambda: {c for c in tokens.GRAMMAR[state] if (not c.startswith("done_") or points >= least) and (c != "done_ring" or geometry == "polygon") and (c != "obj" or not most or objects < most)}
    for t in ids:
        c = kind(t, geometry)
        if c not in may():
            return f"invalid:{state}", may()
        new = tokens.GRAMMAR[state][c]
        points = points + 1 if new == "point" else 0 if new in ("ring", "map") else points
        objects += c == "obj"
        state = new
    return state, may()


def sentence(r, geometry):
    c = lambda: tokens.COORD + r.randrange(BINS)
    out = [T["map_bos"]]
    for _ in range(r.randint(0, 3)):
        out += [T["obj"], T["line" if geometry == "linestring" else "poly"], T["src_local"], T["cut_in_none"], T["cut_out_top"]]
        for ring in range(r.randint(1, 2) if geometry == "polygon" else 1):
            out += [T["ring"]] * (ring > 0)
            for _ in range(r.randint(1, 5)):
                out += [T["pt"], c(), c()]
        out += [T["prop"], *(r.randrange(256) for _ in range(r.randint(0, 3))), T["prop_end"], T["obj_end"]]
    out.append(tokens.EOS)
    if r.random() < 0.7:  # broken somewhere
        k = r.randrange(len(out))
        out[k : k + r.randint(0, 2)] = r.choice(([], [r.choice([*T.values(), tokens.EOS, tokens.PAD, 65, c(), 99_999])]))
    return out[: r.randint(0, len(out))] if r.random() < 0.3 else out


@pytest.mark.parametrize(("geometry", "least", "most"), [("linestring", 2, 0), ("polygon", 3, 2)])
def test_moves_against_walk(spark, geometry, least, most):
    r = random.Random(3)
    rows = [(i, sentence(r, geometry), r.choice([*T.values(), tokens.EOS, 65, tokens.COORD])) for i in range(400)] + [(400, [], 65)]
    df = spark.createDataFrame(rows, "i long, ids array<int>, t int")
    w = tokens.walked(F.col("ids"), geometry, least, BINS, most)
    got = df.select("i", tokens.grammar_state(F.col("ids"), geometry, least, BINS, most).alias("s"), tokens.may_follow(w, F.col("t"), geometry, least, BINS, most).alias("m")).collect()
    seen = Counter()
    for g in got:
        state, may = walk(rows[g["i"]][1], geometry, least, most)
        assert g["s"] == state and g["m"] == (kind(rows[g["i"]][2], geometry) in may)
        seen[state] += 1
    assert len(seen) > 8


def test_choice_of_the_best(spark):
    rows = [(1, 5, 2.0, True), (1, 6, 3.0, True), (1, 7, 3.0, True), (1, 8, 9.0, False), (2, 5, -1.0, True), (2, 6, -1.5, True), (3, tokens.EOS, 5.0, True), (3, 4, 1.0, True), (4, 4, 1.0, False), (4, 5, 2.0, False)]
    df = spark.createDataFrame(rows, "k long, token int, score double, allowed boolean")
    said = spark.createDataFrame([(1, 6), (1, 6), (2, 5)], "k long, token int")
    best = lambda **o: {r["k"]: r["token"] for r in tokens.chosen(df, ["k"], **o).collect()}
    assert best() == {1: 6, 2: 5, 3: tokens.EOS, 4: 5}
    assert best(said=said, penalty=2.0) == {1: 7, 2: 6, 3: tokens.EOS, 4: 5}
    assert best(no_end=F.col("k") == 3)[3] == 4
    assert best(k=1, temperature=0.1) == best()


def test_draws_follow_their_shares(spark):
    """Of the three best, tokens are drawn by the shares of their exponentials; the fourth never; the same seed draws the same."""
    scores = {10: 1.0, 11: 0.0, 12: -0.5, 13: -0.6}
    df = spark.range(20_000).select(F.col("id").alias("k"), F.explode(F.array(*(F.struct(F.lit(t).alias("token"), F.lit(s).alias("score")) for t, s in scores.items()))).alias("x")).select("k", "x.*")
    for heat in (1.0, 0.5):
        n = {r["token"]: r["count"] for r in tokens.chosen(df, ["k"], k=3, temperature=heat, seed=4).groupBy("token").count().collect()}
        e = {t: math.exp(s / heat) for t, s in scores.items() if t != 13}
        assert set(n) == set(e)
        assert all(abs(n[t] / 20_000 - e[t] / sum(e.values())) < 0.015 for t in e)
    draw = lambda seed: sorted(map(tuple, tokens.chosen(df.where("k < 50"), ["k"], k=3, seed=seed).collect()))
    assert draw(1) == draw(1) != draw(2)


def test_long_sequences_are_decoded_in_spans(spark):
    """Noise of all kinds gives the same items in spans as whole, and no call sees more than a span's tokens."""
    r = random.Random(8)
    item = lambda: [T["obj"], T["line"], T["src_local"], T["cut_in_none"], T["cut_out_none"], *(v for _ in range(3) for v in (T["pt"], tokens.COORD + r.randrange(BINS), tokens.COORD + r.randrange(BINS))), T["prop"], *b'{"a":1}', T["prop_end"], T["obj_end"]]
    noise = lambda ids: [t for t in ids if r.random() > 0.03 for t in ([t, r.choice((tokens.PAD, T["obj"], T["obj_end"], T["prop"]))] if r.random() < 0.03 else [t])]
    whole = [sum((item() for _ in range(40)), [T["map_bos"]]) for _ in range(12)]
    rows = [*whole[:2], *(noise(w) for w in whole[2:]), whole[0][:300] + [tokens.EOS] + whole[0][300:], [], [5, 6], [T["obj"]] * 300]
    for ids in rows:
        assert sum((tokens.decode(s, "linestring", 2, 256, BINS)[0] for s in tokens.spans(np.array(ids, np.int32), 50)), []) == tokens.decode(ids, "linestring", 2, 256, BINS)[0]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, ids array<int>")
    got = {x["k"]: x for x in tokens.decode_items(df, ["k"], "linestring", 2, 256, BINS).collect()}
    for k, ids in enumerate(rows):
        items, saw = tokens.decode(ids, "linestring", 2, 256, BINS)
        assert (got[k]["n_items"], got[k]["saw_object"], got[k]["first_props"]) == (len(items), saw, items[0]["props"] if items else None)
        assert [[(p["x"], p["y"]) for p in i["points"]] for i in got[k]["items"]] == [i["points"] for i in items]
    assert max(len(s) for s in tokens.spans(np.array(sum(whole, []), np.int32), 50)) <= 100
