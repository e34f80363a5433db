"""Properties and JSON: canonical text, typed equality, tolerant parsing and recovery from free text."""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .coords import CRS84

# Punctuation that models write for JSON's own. The first line is read in any text, the second only in relaxed reading.
STRICT_MARKS = {"，": ",", "：": ":"}
RELAXED_MARKS = {"；": ",", "“": '"', "”": '"', "‘": "'", "’": "'"}

MILLIONTH = 1e-6


def canonical(props: dict) -> str:
    """Sorted keys, no spaces, non-ASCII kept."""
    return json.dumps(props, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _number(x) -> float:
    try:
        return float(x)
    except (TypeError, ValueError, OverflowError):
        return math.nan


def alike(x, y) -> bool:
    """Whether two values mean the same: where a floating number takes part, both as numbers within a millionth (what is no number is unlike all); else the values themselves."""
    return abs(_number(x) - _number(y)) <= MILLIONTH if float in (type(x), type(y)) else x == y


def equal(a: dict, b: dict) -> bool:
    """The same names with values alike; for state functions, where properties are Python's. ``props_equal`` says the same in columns."""
    return a.keys() == b.keys() and all(alike(v, b[k]) for k, v in a.items())


def _object(read, text: str) -> dict | None:
    """What ``read`` makes of a text, if that is an object; nesting beyond what the reader can follow is none."""
    try:
        out = read(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    return out if isinstance(out, dict) else None


def _literal(text: str):
    """A Python literal in which JSON's three words, in any case, stand for Python's."""
    names = {"true": "True", "false": "False", "null": "None"}
    return ast.literal_eval(re.sub(r"\b(true|false|null)\b", lambda m: names[m[0].lower()], text, flags=re.IGNORECASE))


def _tidy(text: str, marks: dict[str, str]) -> str:
    """Marks as JSON has them, and no comma before a closing bracket: one pass, in which a comma and the white space behind it are held back until it is known what follows."""
    out: list[str] = []
    held = ""
    for c in text:
        c = marks.get(c, c)
        if held and c in "}]":
            out.append(held[1:])
            held = ""
        elif held and not c.isspace():
            out.append(held)
            held = ""
        if c == "," or (held and c.isspace()):
            held += c
        else:
            out.append(c)
    return "".join(out) + held


def _readings(raw: str, marks: dict[str, str]) -> Iterator[dict | None]:
    """Readings of a text, the most faithful first: JSON as it stands, JSON once tidied (only where the text was JSON already, but no object), and a Python literal."""
    plain = _object(json.loads, raw)
    yield plain
    tidy = _tidy(raw, marks)
    if plain is None and _is_json(raw):
        yield _object(json.loads, tidy)
    yield _object(_literal, tidy)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _first(readings: Iterator[dict | None]) -> dict | None:
    return next((r for r in readings if r is not None), None)


def parse(text: str | None) -> dict:
    """The first reading that is an object, else the raw text under one key; nothing for an empty text."""
    raw = (text or "").strip()
    found = _first(_readings(raw, STRICT_MARKS)) if raw else {}
    return {"_raw_text": raw} if found is None else found


def _braced(name: str, value: str) -> str:
    """A list of members that lacks its braces, or one of them, as an object."""
    return "{" + name.lstrip("{}") + ":" + value.rstrip("{}") + "}" if name.strip("{}") and value.strip("{}") else "{" + f"{name}:{value}".strip("{}") + "}"


def parse_relaxed(text: str | None) -> dict:
    """As ``parse``, with more marks folded first, and braces put round bare ``key: value`` lists."""
    raw = (text or "").strip()
    if not raw:
        return {}
    tidy = _tidy(raw, STRICT_MARKS | RELAXED_MARKS)
    forms = [tidy] + [_braced(name, value) for name, colon, value in [tidy.strip().strip(",").partition(":")] if colon and name[:1] != "{"]
    found = _first(r for form in forms for r in _readings(form.strip(), STRICT_MARKS))
    return {"_raw_text": raw} if found is None or "_raw_text" in found else found


def first_object(text: str | None) -> str | None:
    """The first JSON object that some brace begins, as compact JSON; what follows it does not matter. A text nested deeper than the reader can follow holds none."""
    text = text or ""
    read = json.JSONDecoder()
    for brace in re.finditer("{", text):
        try:
            return json.dumps(read.raw_decode(text, brace.start())[0], ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
        except RecursionError:
            return None
    return None


class _Odd(Exception):
    """JSON that only the reader of whole texts judges, as numbers that are none or very long."""


def _odd(text: str):
    raise _Odd(text)


class Answer:
    """The features of the collection that a text's first brace begins, one at a time, from a text that comes in pieces: of the text only what is not yet read is held.

    It reads what is plain: one object of type FeatureCollection, with one list of features, that ends in the text. All else is left to ``first_object`` (``settled`` is false), and so are the features that were given before that was known."""

    _SPACE = re.compile(r"[ \t\n\r]*")

    def __init__(self):
        self.read = json.JSONDecoder(parse_constant=_odd, parse_int=lambda t: int(t) if len(t) <= 18 else _odd(t))
        self.left, self.state, self.need, self.key, self.names = "", "before", 0, "", set()
        self.blank, self.failed, self.kind, self.listed = True, False, None, False

    def feed(self, text: str) -> list[str | None]:
        """Features that the piece completes, as compact JSON; None for elements that are no objects."""
        if self.failed or self.state == "done":
            return []
        if self.state == "before":
            self.blank = self.blank and not text.strip(" ")
            brace = text.find("{")
            if brace < 0:
                return []
            text, self.state = text[brace + 1 :], "first name"
        self.left += text
        out: list[str | None] = []
        # a piece that cannot be read yet is tried again when twice as much is there
        if len(self.left) >= self.need:
            try:
                at = self._advance(out)
            except (_Odd, RecursionError):
                self.failed, self.left = True, ""
                return []
            self.left = self.left[at:]
            self.need = 2 * len(self.left) if self.stuck else 0
        return out

    def ended(self) -> list[str | None]:
        """Features that are complete as nothing follows."""
        self.need = 0
        return self.feed("")

    def _value(self, at: int):
        """The value that begins at a place and where what follows it begins; None if it is not there as a whole."""
        try:
            value, end = self.read.raw_decode(self.left, at)
        except ValueError:
            self.stuck = True
            return None
        end = self._SPACE.match(self.left, end).end()
        if end == len(self.left):
            return None
        try:
            text = json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":"))
            text.encode()
        except ValueError as odd:
            raise _Odd from odd
        return value, text, end

    def _advance(self, out: list) -> int:
        at, self.stuck = 0, False
        while True:
            at = self._SPACE.match(self.left, at).end()
            if at == len(self.left) or self.state == "done":
                return at
            sign = self.left[at]
            if self.state == "after":  # a member
                self.state = {",": "name", "}": "done"}.get(sign) or _odd(sign)
                at += 1
            elif self.state == "beside":  # a feature
                self.state = {",": "feature", "]": "after"}.get(sign) or _odd(sign)
                at += 1
            elif self.state == "first name" and sign == "}":
                self.state, at = "done", at + 1
            elif self.state == "first feature" and sign == "]":
                self.state, at = "after", at + 1
            elif self.state == "value" and self.key == "features":
                self.state, at, self.listed = "first feature" if sign == "[" else _odd(sign), at + 1, True
            else:
                name = self.state.endswith("name")
                if name and sign != '"':
                    _odd(sign)
                got = self._value(at)
                if got is None:
                    return at
                value, text, at = got
                if name:
                    if self.left[at] != ":" or value in self.names:
                        _odd(value)
                    self.names.add(value)
                    self.key, self.state, at = value, "value", at + 1
                elif self.state == "value":
                    self.kind = value if self.key == "type" else self.kind
                    self.state = "after"
                else:
                    if isinstance(value, str):
                        _odd(value)
                    out.append(text if isinstance(value, dict) else None)
                    self.state = "beside"

    @property
    def settled(self) -> bool:
        return self.state == "before" or (self.state == "done" and self.listed and isinstance(self.kind, str) and self.kind.strip(" ") == "FeatureCollection")

    @property
    def decoded(self) -> bool:
        """Of a settled text: there is a collection, or nothing."""
        return self.state == "done" or self.blank


def _mapped(f):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, StringType())


first_object_udf = _mapped(first_object)
parse_udf = _mapped(lambda t: canonical(parse(t)))
parse_relaxed_udf = _mapped(lambda t: canonical(parse_relaxed(t)))
indented_udf = _mapped(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=2))
canonical_udf = _mapped(lambda t: (lambda o: None if o is None else canonical(o))(_object(json.loads, t)))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def collection(text: Column, name: str = "") -> Column:
    """A feature collection's JSON from that of a collection, of one feature, or of anything with a list of features; null for all else.
    Names and reference systems that lack are filled in; a collection keeps its other members."""
    v = F.try_parse_json(text)
    member = lambda k, kind="variant": F.try_variant_get(v, f"$.{k}", kind)
    has = lambda k: F.map_contains_key(F.try_variant_get(v, F.lit("$"), "map<string,variant>"), k)
    listed = F.coalesce(F.schema_of_variant(member("features")).startswith("ARRAY"), F.lit(False))
    kind = F.trim(member("type", "string"))
    own, crs = quoted(F.lit(name)), F.lit(f'{{"type":"name","properties":{{"name":"{CRS84}"}}}}')
    glue = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    body = F.to_json(v)
    lacking = lambda k, value: F.when(~has(k), glue(f'"{k}":', value, ",")).otherwise("")
    whole = glue("{", lacking("name", own), lacking("crs", crs), F.substring(body, F.lit(2), F.length(body)))
    built = lambda label, system, features: glue('{"type":"FeatureCollection","name":', label, ',"crs":', system, ',"features":', features, "}")
    given = quoted(F.coalesce(F.nullif(member("name", "string"), F.lit("")), F.lit(name)))
    loose = built(given, F.when(has("crs"), F.coalesce(F.to_json(member("crs")), F.lit("null"))).otherwise(crs), F.to_json(member("features")))
    return F.when((kind == "FeatureCollection") & listed, whole).when(kind == "Feature", built(own, crs, glue("[", body, "]"))).when(listed, loose)


def props_equal(a: Column, b: Column) -> Column:
    """Typed equality of two JSON objects, without Python: the same names, and values alike. Where a value is a floating number, both count as numbers within a millionth, and null or a text that is none is unlike
    all; whole numbers and truth values compare as numbers; other values must have one kind and one canonical JSON, nested ones included. Null if a side is null, false if one is no object."""
    members = lambda c: F.try_variant_get(F.try_parse_json(c), F.lit("$"), "map<string,variant>")

    def same(x: Column, y: Column) -> Column:
        kx, ky = F.schema_of_variant(x), F.schema_of_variant(y)
        floating = lambda k: k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")
        whole = lambda k: k.isin("BIGINT", "BOOLEAN")
        number = lambda v, kind: F.try_variant_get(v, F.lit("$"), kind)
        near = F.abs(number(x, "double") - number(y, "double")) <= MILLIONTH
        exact = F.when(whole(kx) & whole(ky), number(x, "bigint") == number(y, "bigint")).otherwise((kx == ky) & (F.to_json(x) == F.to_json(y)))
        return F.coalesce(F.when(floating(kx) | floating(ky), near).otherwise(exact), F.lit(False))

    ma, mb = members(a), members(b)
    names = F.array_sort(F.map_keys(ma)) == F.array_sort(F.map_keys(mb))
    typed = F.coalesce(names, F.lit(False)) & F.coalesce(F.forall(F.map_keys(ma), lambda k: same(ma[k], mb[k])), F.lit(False))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(typed)


def props_bucket(props: Column) -> Column:
    """A hash that is equal for objects that ``props_equal`` takes for equal: of their names, and of texts that are no number, which are equal only to themselves. Null for what is no object, as that equals nothing."""
    members = F.try_variant_get(F.try_parse_json(props), F.lit("$"), "map<string,variant>")
    number = lambda v: F.try_variant_get(v, F.lit("$"), "double")
    told = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("k"), F.when((F.schema_of_variant(e["value"]) == "STRING") & number(e["value"]).isNull(), F.to_json(e["value"])).alias("v")))
    return F.when(members.isNotNull(), F.xxhash64(F.to_json(F.array_sort(told))))


def fixed(x: Column, places: int) -> Column:
    """Decimal text with half-even ties, as in most languages' formatting."""
    scale = 10**places
    return F.format_string(f"%.{places}f", F.rint(x * scale) / scale)


def geo_context(crs: Column, t: list[Column], patch_px: Column, patch_world: Column) -> Column:
    a, _, c, _, e, f = t
    return F.concat_ws(" ", F.lit("GeoMeta"), F.concat(F.lit("crs="), crs), F.concat(F.lit("origin="), fixed(c, 3), F.lit(","), fixed(f, 3)), F.concat(F.lit("pixel_size="), fixed(a, 6), F.lit(","), fixed(e, 6)), F.concat(F.lit("patch_px="), patch_px), F.concat(F.lit("patch_world="), patch_world))


def cache_key(fields: list[Column]) -> Column:
    """First 16 hexadecimal digits of SHA-1 over the fields joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *(f.cast("string") for f in fields)).cast("binary")), 1, 16)


def truth(text: Column, default: bool) -> Column:
    """Configuration text as a flag."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off", ""), False).otherwise(default)
