"""Token codec of map items: control tokens, coordinate bins and property bytes, a tolerant decoder and the grammar as a table of states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions.lines import let

# The control tokens in the order of their ids, which follow the bytes (0-255), padding and end.
CONTROL = (
    "map_bos state_bos obj obj_end anchor anchor_end line poly prop prop_end pt ring src_local src_state "
    "cut_in_none cut_in_left cut_in_top cut_in_right cut_in_bottom cut_in_internal "
    "cut_out_none cut_out_left cut_out_top cut_out_right cut_out_bottom cut_out_internal side_none side_left side_top side_right side_bottom"
).split()
PAD, EOS = 256, 257
TOKEN = {name: 258 + i for i, name in enumerate(CONTROL)}
COORD = 258 + len(CONTROL)


def _ids(*names: str) -> Column:
    return F.array(*(F.lit(TOKEN[n]) for n in names))


def _named(prefix: str, value: Column, default: str) -> Column:
    out = F.lit(TOKEN[f"{prefix}_{default}"])
    for n in CONTROL:
        if n.startswith(f"{prefix}_"):
            out = F.when(value == n.removeprefix(f"{prefix}_"), TOKEN[n]).otherwise(out)
    return F.array(out)


def point_ids(line: Column, size: int, bins: int) -> Column:
    return F.flatten(F.transform(line, lambda p: F.array(F.lit(TOKEN["pt"]), COORD + C.quantise(p["x"], size, bins), COORD + C.quantise(p["y"], size, bins))))


def ring_ids(rings: Column, size: int, bins: int) -> Column:
    return F.flatten(F.transform(rings, lambda r, i: F.concat(F.when(i > 0, _ids("ring")).otherwise(F.array().cast("array<int>")), point_ids(r, size, bins))))


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as ids."""
    hexa = F.hex(text.cast("binary"))
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substr(hexa, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def item_ids(geometry: str, size: int, bins: int) -> Column:
    """Ids of one item: line (or rings), source, cut_in, cut_out, props."""
    body = point_ids(F.col("line"), size, bins) if geometry == "linestring" else ring_ids(F.col("rings"), size, bins)
    head = _ids("obj", "line" if geometry == "linestring" else "poly")
    return F.concat(head, _named("src", F.col("source"), "local"), _named("cut_in", F.col("cut_in"), "none"), _named("cut_out", F.col("cut_out"), "none"), body, _ids("prop"), byte_ids(F.col("props")), _ids("prop_end", "obj_end"))


def finalise(ids: Column, most: int = 0) -> Column:
    """With the end token, then cut to ``most`` (0: no limit); a cut sequence loses its end."""
    out = F.concat(ids, F.array(F.lit(EOS)))
    return F.slice(out, 1, most) if most > 0 else out


def encode_items(items: DataFrame, key: list[str], size: int, bins: int, geometry: str = "linestring", most: int = 0) -> DataFrame:
    """key, ids: the key's items in canonical order (first y, first x, last y, last x, points, properties)."""
    one = F.struct(F.col("line")[0]["y"].alias("a"), F.col("line")[0]["x"].alias("b"), F.element_at("line", -1)["y"].alias("c"), F.element_at("line", -1)["x"].alias("d"), F.size("line").alias("n"), "props", item_ids(geometry, size, bins).alias("ids"))
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select(*key, finalise(F.concat(_ids("map_bos"), F.flatten(F.transform("all", lambda x: x["ids"]))), most).alias("ids"))


def encode_anchors(items: DataFrame, key: list[str], size: int, bins: int, geometry: str = "linestring") -> DataFrame:
    """key, ids of state items (side, line)."""
    one = F.concat(_ids("anchor", "line" if geometry == "linestring" else "poly"), _named("side", F.col("side"), "none"), point_ids(F.col("line"), size, bins), _ids("anchor_end"))
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("side", F.col("line")[0]["y"].alias("y"), F.col("line")[0]["x"].alias("x"), one.alias("ids")))).alias("all"))
    return rows.select(*key, finalise(F.concat(_ids("state_bos"), F.flatten(F.transform("all", lambda x: x["ids"])))).alias("ids"))


def decode(ids: list[int], geometry: str, least: int, size: int, bins: int) -> tuple[list[dict], bool]:
    """Items of the wanted geometry with enough points, and whether any object began. Unknown or missing parts are passed over."""
    from ..functions import props

    name = {v: k for k, v in TOKEN.items()}
    ids = [i for i in ids if i != PAD]
    if EOS in ids:
        ids = ids[: ids.index(EOS)]
    starts = [i for i, t in enumerate(ids) if t == TOKEN["obj"]]
    items, after = [], 0
    for start in starts:
        if start < after:
            continue  # an object inside another one's body
        stop = next((i for i in range(start + 1, len(ids)) if ids[i] == TOKEN["obj_end"]), len(ids))
        after = stop + 1
        body = ids[start + 1 : stop]
        if not body:
            continue
        kind = {TOKEN["line"]: "linestring", TOKEN["poly"]: "polygon"}.get(body[0], geometry)
        item = {"geometry_type": kind, "source": "local", "cut_in": "none", "cut_out": "none"}
        at = 1
        for field, prefix in (("source", "src_"), ("cut_in", "cut_in_"), ("cut_out", "cut_out_")):
            if at < len(body) and name.get(body[at], "").startswith(prefix):
                item[field] = name[body[at]].removeprefix(prefix)
                at += 1
        shape, _, tail = _partition(body[at:], TOKEN["prop"])
        raw, _, _ = _partition(tail, TOKEN["prop_end"])
        rings: list[list[tuple[float, float]]] = [[]]
        n = 0
        while n < len(shape):
            if shape[n] == TOKEN["ring"]:
                rings.append([])
            elif shape[n] == TOKEN["pt"] and n + 2 < len(shape) and all(COORD <= v < COORD + bins for v in shape[n + 1 : n + 3]):
                rings[-1].append(tuple((v - COORD) / (bins - 1) * (size - 1) for v in shape[n + 1 : n + 3]))
                n += 2
            n += 1
        text = bytes(b for b in raw if b < 256).decode("utf-8", "replace").strip()
        rings = [r for r in rings if r]
        if kind == geometry and rings and len(rings[0] if kind == "polygon" else rings[-1]) >= least:
            parsed = props.parse_relaxed(text)
            items.append(item | {"props": text or "{}", "parsed": parsed, "parse_ok": "_raw_text" not in parsed, "points": rings[0] if kind == "polygon" else rings[-1], "rings": rings if kind == "polygon" else None})
    return items, bool(starts)


def _partition(seq: list[int], mark: int) -> tuple[list[int], bool, list[int]]:
    return (seq[: (i := seq.index(mark))], True, seq[i + 1 :]) if mark in seq else (seq, False, [])


#: Tokens that are decoded at once.
AT_ONCE = 1 << 16


def spans(ids: np.ndarray, most: int = AT_ONCE) -> Iterator[list[int]]:
    """A sequence up to its end in spans of about ``most`` tokens. They are cut behind ends of objects, where no object is open, so what ``decode`` finds in the spans is what it finds in the whole."""
    at = 0
    while at < len(ids):
        stop = at + most
        while stop < len(ids) and not (ids[at:stop] == TOKEN["obj_end"]).any():
            stop += most
        part = ids[at:stop]
        if stop < len(ids):
            part = part[: np.flatnonzero(part == TOKEN["obj_end"])[-1] + 1]
        last = np.flatnonzero(part == EOS)
        yield (part[: last[0]] if len(last) else part).tolist()
        if len(last):
            return
        at += len(part)


_ITEM = "cut_in string, cut_out string, source string, props string, points array<struct<x:double,y:double>>"


def decode_objects(coded: DataFrame, key: list[str], geometry: str, least: int, size: int, bins: int) -> DataFrame:
    """key, _row (a number of the sequence), _place, saw_object and the item: a row an item, and one without an item (_place null) a span. Python holds a span's tokens and items, not a sequence's."""
    schema = ", ".join(f"{k} {coded.schema[k].dataType.simpleString()}" for k in key) + f", _row long, _place long, saw_object boolean, {_ITEM}"
    points = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches):
        for b in batches:
            column = b["ids"]
            for r in range(b.num_rows):
                ids = column[r].values
                place = 0
                for span in spans(ids.to_numpy(zero_copy_only=False)) if ids is not None and len(ids) else [[]]:
                    items, saw = decode(span, geometry, least, size, bins)
                    n = len(items) + 1
                    texts = {c: pa.array([i[c] for i in items] + [None], pa.string()) for c in ("cut_in", "cut_out", "source", "props")}
                    shapes = pa.array([[{"x": x, "y": y} for x, y in i["points"]] for i in items] + [None], points)
                    own = {k: b[k].take(pa.array(np.full(n, r))) for k in (*key, "_row")}
                    yield pa.RecordBatch.from_pydict(own | {"_place": pa.array([*range(place, place + n - 1), None], pa.int64()), "saw_object": pa.array([saw] * n)} | texts | {"points": shapes})
                    place += n - 1

    return coded.select(*key, "ids").withColumn("_row", F.monotonically_increasing_id()).select(*key, "_row", "ids").mapInArrow(run, schema)


def decode_items(coded: DataFrame, key: list[str], geometry: str, least: int, size: int, bins: int) -> DataFrame:
    """key, n_items, saw_object, first_props, items (struct array of cut_in, cut_out, source, props, points), a row a sequence."""
    item = F.struct("cut_in", "cut_out", "source", "props", "points")
    listed = F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", item.alias("item")))))
    rows = decode_objects(coded, key, geometry, least, size, bins).groupBy(*key, "_row")
    out = rows.agg(F.count("_place").alias("n_items"), F.max("saw_object").alias("saw_object"), F.min(F.when(F.col("_place") == 0, F.col("props"))).alias("first_props"), listed.alias("items"))
    return out.select(*key, "n_items", "saw_object", "first_props", F.transform("items", lambda x: x["item"]).alias("items"))


#: For each state the classes of tokens that may follow and the state that they lead to. ``done`` needs the least number of points.
GRAMMAR = {
    "start": {"map_bos": "map"},
    "map": {"obj": "object", "eos": "end"},
    "object": {"geometry": "geometry"},
    "geometry": {"src": "source"},
    "source": {"cut_in": "cut_in"},
    "cut_in": {"cut_out": "cut_out"},
    "cut_out": {"pt": "point_x"},
    "point_x": {"coord": "point_y"},
    "point_y": {"coord": "point"},
    "point": {"pt": "point_x", "done_ring": "ring", "done_prop": "props"},
    "ring": {"pt": "point_x"},
    "props": {"byte": "props", "prop_end": "closing"},
    "closing": {"obj_end": "map"},
    "end": {},
}


STATES = list(GRAMMAR)
CLASSES = sorted({c for row in GRAMMAR.values() for c in row}) + ["other"]


def _class_of(geometry: str) -> dict[int, str]:
    """Class of each control token and of the end."""
    out = {EOS: "eos"}
    for name, t in TOKEN.items():
        kind = next((p for p in ("src", "cut_in", "cut_out") if name.startswith(f"{p}_")), None)
        shape = "geometry" if name == ("line" if geometry == "linestring" else "poly") else None
        done = {"prop": "done_prop"} | ({"ring": "done_ring"} if geometry == "polygon" else {})
        out[t] = kind or shape or done.get(name) or (name if name in ("map_bos", "obj", "obj_end", "pt", "prop_end") else "other")
    return out


def _moves() -> list[int]:
    """The grammar as one table: at state x class, the next state, or -1."""
    return [STATES.index(GRAMMAR[s][c]) if c in GRAMMAR[s] else -1 for s in STATES for c in CLASSES]


def token_class(t: Column, geometry: str, bins: int) -> Column:
    """Number of a token's class."""
    number = CLASSES.index
    known = F.create_map(*(F.lit(x) for t, c in _class_of(geometry).items() for x in (t, number(c))))
    return F.when(t < 256, number("byte")).when(t.between(COORD, COORD + bins - 1), number("coord")).otherwise(F.coalesce(F.try_element_at(known, t), F.lit(number("other"))))


def walked(ids: Column, geometry: str, least: int, bins: int, most_objects: int = 0) -> Column:
    """Struct state (number), points, objects and broken after an id array, by one pass over the table of moves: a token that may not follow breaks it, and the state stays where it was. ``least``: points that a line or ring has at least;
    ``most_objects`` (0: any number) closes the map."""
    L_ = CLASSES.index
    table = F.array(*(F.lit(m) for m in _moves()))
    done = [L_(c) for c in CLASSES if c.startswith("done_")]
    fresh = [STATES.index(s) for s in ("ring", "map")]

    def step(a: Column, t: Column) -> Column:
        def moved(v: Column) -> Column:
            c, to = v["c"], v["to"]
            early = c.isin(done) & (a["points"] < least)
            full = (c == L_("obj")) & F.lit(most_objects > 0) & (a["objects"] >= most_objects)
            broken = a["broken"] | (to < 0) | early | full
            points = F.when(to == STATES.index("point"), a["points"] + 1).when(to.isin(fresh), 0).otherwise(a["points"])
            return F.when(broken, F.struct(a["state"].alias("state"), a["points"].alias("points"), a["objects"].alias("objects"), F.lit(True).alias("broken"))).otherwise(
                F.struct(to.alias("state"), points.alias("points"), (a["objects"] + F.when(c == L_("obj"), 1).otherwise(0)).alias("objects"), F.lit(False).alias("broken"))
            )

        cls = let(token_class(t, geometry, bins), lambda c: F.struct(c.alias("c"), F.get(table, a["state"] * len(CLASSES) + c).alias("to")))
        return let(cls, moved)

    start = F.struct(F.lit(STATES.index("start")).alias("state"), F.lit(0).alias("points"), F.lit(0).alias("objects"), F.lit(False).alias("broken"))
    return F.aggregate(ids, start, step)


def grammar_state(ids: Column, geometry: str, least: int, bins: int, most_objects: int = 0) -> Column:
    """Name of the state that an id array ends in, or ``invalid:`` and where it breaks the grammar."""
    name = lambda w: F.get(F.array(*(F.lit(s) for s in STATES)), w["state"])
    return let(walked(ids, geometry, least, bins, most_objects), lambda w: F.concat(F.when(w["broken"], "invalid:").otherwise(""), name(w)))


def may_follow(walk: Column, token: Column, geometry: str, least: int, bins: int, most_objects: int = 0) -> Column:
    """Whether a token may follow what has been ``walked``; after a broken walk, what might have stood there."""
    c = token_class(token, geometry, bins)
    to = F.get(F.array(*(F.lit(m) for m in _moves())), walk["state"] * len(CLASSES) + c)
    early = c.isin([CLASSES.index(x) for x in CLASSES if x.startswith("done_")]) & (walk["points"] < least)
    full = (c == CLASSES.index("obj")) & F.lit(most_objects > 0) & (walk["objects"] >= most_objects)
    return (to >= 0) & ~early & ~full


def chosen(scores: DataFrame, key: list[str], k: int = 1, temperature: float = 1.0, seed: int = 0, said: DataFrame | None = None, penalty: float = 1.0, no_end: Column | None = None) -> DataFrame:
    """key and the next token of each key among scored ones (key, token, score, and ``allowed`` where only some may follow).

    Tokens that were ``said`` (key, token) lose by a ``penalty`` over 1: positive scores are divided by it, others multiplied. ``no_end``: where the end is too early. Of the ``k`` best scores (the least token of equal
    ones first) one is drawn by its share of the exponentials, by Gumbel's rule: the greatest score plus noise that hashes of seed, key and token make, so a draw can be repeated and no row waits for another. k = 1 takes the best."""
    rows = scores
    if said is not None and penalty > 1:
        seen = said.select(*key, "token").distinct().withColumn("_said", F.lit(True))
        lower = F.when(F.col("score") > 0, F.col("score") / penalty).otherwise(F.col("score") * penalty)
        rows = rows.join(seen, [*key, "token"], "left").withColumn("score", F.when(F.col("_said"), lower).otherwise(F.col("score"))).drop("_said")
    if temperature > 1e-6:
        rows = rows.withColumn("score", F.col("score") / temperature)
    if no_end is not None:
        rows = rows.where(~(no_end & (F.col("token") == EOS)))
    if "allowed" in rows.columns:
        # where nothing may follow, the grammar says nothing
        rows = rows.withColumn("_any", F.max("allowed").over(Window.partitionBy(*key))).where(F.col("allowed") | ~F.col("_any")).drop("_any")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "token"))
    rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= max(1, k))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key, "token"), 11) + 0.5) * 2.0**-53
    drawn = F.col("score") - F.log(-F.log(u)) if k > 1 else F.col("score")
    return rows.groupBy(*key).agg(F.max_by("token", F.struct(drawn.alias("s"), -F.col("token"))).alias("token"))


def limits(most: Column, least: Column, prefix: Column, context: int = 4096) -> tuple[Column, Column]:
    """How many tokens to generate at most and at least: as asked for, or, where 0 asks for no limit, what a context has left behind its prefix (one at least)."""
    room = F.when(most > 0, most).otherwise(F.greatest(F.lit(1), F.lit(context) - prefix - 1))
    return room, F.least(F.greatest(least, F.lit(0)), room)
