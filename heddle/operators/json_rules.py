"""Rules over the paths of JSON documents of any shape.

flatten() makes a row of every value of a document: its path, the path's pattern, its type and its text. Rules are
declared over patterns ('views.*.radius', 'steps.*[*].factor', '*' for any key, '[*]' for any place). Rules of one value are
columns over its row; rules that look at other values of the document (keys that must exist, lists as long as a span, fields
that go together) are columns over what these values say, which is set beside it. What is wrong comes out as one table:
id, path, rule, value.

checked() judges documents: as each lies in one row, what a rule looks at is set beside a value where the document is read,
and values that no rule is about, or that are surely in order, never leave it; nothing is shuffled or written between. violations() judges a table of ROWS
that may come from anywhere: there it takes joins and sums by document and path. Both end in the same columns (_judged).
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.lineage import cut

ROWS = "id string, path string, pattern string, parent string, name string, type string, value string, size int"
VIOLATIONS = ["id", "path", "rule", "value"]
#: A value that a rule (by number) is about. Of the keys that the rule looks for, `has` are there and `numbers` are their values, in
#: the rule's order; `limit` is the size of the array that it looks at, `known` whether the value is one of those known, `first` the
#: least path of an equal value. Null where the rule doesn't ask.
FACTS = "id string, path string, rule int, type string, value string, size int, has array<string>, numbers array<double>, limit int, known boolean, first string"
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
#: A document's rows that are given at a time.
PART = 20_000
#: Rows of FACTS, and documents, that are taken at a time: few, so that they stay in a core's cache.
FEW = 1_000
#: Keys that are remembered of a pattern's objects.
KEYS = 4_096


def _parsed(text: str | None) -> tuple[object, str | None]:
    """A document, or why and where the text is none."""
    try:
        return json.loads(text or ""), None
    except json.JSONDecodeError as e:
        return None, f"{e.msg} (line {e.lineno}, column {e.colno})"
    except RecursionError:
        return None, "too deep"
    except ValueError as e:  # an integer of thousands of digits
        return None, str(e)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; the last columns are null where rows are short."""
    columns = []
    for c, f in zip(zip(*rows), schema):
        try:
            columns.append(pa.array(c, f.type))
        except UnicodeEncodeError:  # half a surrogate pair
            columns.append(pa.array([x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in c], f.type))
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(rows), f.type) for f in list(schema)[len(columns) :]], schema=schema)


def _text(x: object, kind: str) -> str | None:
    """A value as it stands in a document; None for objects and arrays."""
    if kind == "string":
        return x
    if kind == "object" or kind == "array":
        return None
    if kind == "number" and x - x == 0:
        return repr(x)
    return json.dumps(x)


def _walk(document: object, hidden: str) -> Iterator[tuple]:
    """Rows of a document, parents first, without recursion."""
    todo = [("", "", None, None, document)]
    while todo:
        path, pattern, parent, name, x = todo.pop()
        kind = KINDS.get(type(x), "number")
        yield path, pattern, parent, name, kind, _text(x, kind), len(x) if kind in ("object", "array", "string") else None
        if kind == "object":
            for k, v in reversed(x.items()):
                if not (hidden and k.startswith(hidden)):
                    todo.append((f"{path}.{k}" if path else k, f"{pattern}.{k}" if pattern else k, path, k, v))
        elif kind == "array":
            for i in range(len(x) - 1, -1, -1):
                todo.append((f"{path}[{i}]", f"{pattern}[*]", path, str(i), x[i]))


def flatten(docs: DataFrame, hidden: str = "_") -> DataFrame:
    """ROWS of a table (id, json). Keys that begin with `hidden` are left out at every level. A text that isn't JSON (or is
    null) has one row of type invalid, whose value tells why and where; of a key given twice the last counts."""

    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.string()) for c in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                document, why = _parsed(text.as_py())
                if why is not None:
                    rows.append((i, "", "", None, None, "invalid", why, None))
                    continue
                for r in _walk(document, hidden):
                    rows.append((i, *r))
                    if len(rows) >= PART:
                        yield _batch(rows, schema)
                        rows = []
            yield _batch(rows, schema)

    return docs.select(F.col("id").cast("string").alias("id"), F.col("json").cast("string").alias("json")).mapInArrow(run, ROWS)


def _expression(pattern: str) -> str:
    """A regular expression of a pattern."""
    parts = [re.escape(p).replace(r"\*", r"[^.\[\]]+") if "[*]" not in p else re.escape(p).replace(r"\[\*\]", "\0").replace(r"\*", r"[^.\[\]]+").replace("\0", r"\[\*\]") for p in pattern.split(".")]
    return r"\.".join(parts)


def matching(pattern: str, column: str = "pattern") -> Column:
    """Rows of a pattern: '*' stands for one key."""
    if "*" not in pattern.replace("[*]", ""):
        return F.col(column) == pattern
    return F.col(column).startswith(pattern.split("*")[0]) & F.col(column).rlike("^" + _expression(pattern) + "$")


@dataclass
class Rule:
    """name and pattern, and what must hold of the values there:

    types: their type is one of these; number: (least, most), either None, where true and false are no numbers; like: the text
    matches a regular expression; one_of: the text is one of these; least: so many items, keys or letters; needs: an object
    has these keys; together: it has all of these keys or none; rising: of two of its keys with numbers the first is less;
    known: the text is a value at one of these patterns of the same document; unique: no other value at the pattern is equal;
    place: a number from 0 to the size of the array at this pattern less one; as_long: an array has as many items as the array
    at this pattern; span: an array in an object has `to` - `from` + 1 items, for the object's two keys of these names.
    """

    name: str
    pattern: str
    types: tuple[str, ...] = ()
    number: tuple[float | None, float | None] | None = None
    like: str | None = None
    one_of: tuple[str, ...] = ()
    least: int | None = None
    needs: tuple[str, ...] = ()
    together: tuple[str, ...] = ()
    rising: tuple[str, str] | None = None
    known: tuple[str, ...] = ()
    unique: bool = False
    place: str | None = None
    as_long: str | None = None
    span: tuple[str, str] | None = None


def _number(c: str = "value") -> Column:
    return F.when(F.col("type") == "number", F.col(c).try_cast("double"))


def _alone(rule: Rule) -> Column:
    """Whether a row breaks the parts of a rule that look at it alone."""
    bad = F.lit(False)
    if rule.types:
        bad |= ~F.col("type").isin(*rule.types)
    if rule.number is not None:
        low, high = rule.number
        bad |= _number().isNull()
        for limit, beyond in ((low, _number() < low if low is not None else None), (high, _number() > high if high is not None else None)):
            if limit is not None:
                bad |= F.coalesce(beyond, F.lit(False))
    if rule.like is not None:
        bad |= (F.col("type") != "string") | ~F.col("value").rlike(f"^(?:{rule.like})$")
    if rule.one_of:
        bad |= (F.col("type") != "string") | ~F.col("value").isin(*rule.one_of)
    if rule.least is not None:
        bad |= F.coalesce(F.col("size"), F.lit(0)) < rule.least
    return bad


def _keys(rule: Rule) -> dict[str, str]:
    """Patterns of the keys that a rule looks for in an object, by key."""
    over = rule.pattern.rpartition(".")[0] if rule.span else rule.pattern
    return {k: f"{over}.{k}" if over else k for k in rule.needs + rule.together + (rule.rising or ()) + (rule.span or ())}


def _others(rule: Rule) -> list[str]:
    """Patterns of the values that a rule looks at besides its own: none if it looks at each value alone."""
    return [*_keys(rule).values(), *rule.known, *([rule.place or rule.as_long] if rule.place or rule.as_long else []), *([rule.pattern] if rule.unique else [])]


def _faults(rule: Rule) -> list[tuple[Column, Column]]:
    """What breaks a rule, over a row of FACTS, and what is said of it."""
    keys, value, size, has, limit = list(_keys(rule)), *map(F.col, ("value", "size", "has", "limit"))
    number = lambda k: F.element_at("numbers", keys.index(k) + 1)
    faults = []
    if rule.types or rule.number is not None or rule.like is not None or rule.one_of or rule.least is not None:
        faults.append((_alone(rule), value))
    if rule.needs:
        lacks = F.array_except(F.array(*map(F.lit, rule.needs)), has)
        faults.append((F.size(lacks) > 0, F.array_join(F.array_sort(lacks), ",")))
    if rule.together:
        n = F.size(F.array_intersect(F.array(*map(F.lit, rule.together)), has))
        faults.append(((n > 0) & (n < len(rule.together)), value))
    if rule.rising:
        faults.append((number(rule.rising[0]) >= number(rule.rising[1]), value))
    if rule.span:
        low, high = map(number, rule.span)
        faults.append(((low == F.floor(low)) & (high == F.floor(high)) & (size != high - low + 1), size.cast("string")))
    if rule.known:
        faults.append((~F.col("known") & (F.col("type") != "null"), value))
    if rule.unique:
        faults.append((F.col("path") != F.col("first"), value))
    if rule.place:
        faults.append((_number().isNull() | (limit < 2) | (_number() < 0) | (_number() > limit - 1), value))
    elif rule.as_long:
        faults.append(((F.col("type") != "array") | (size != limit), value))
    return faults


def _judged(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """VIOLATIONS of a table of FACTS."""
    no, invalid = F.col("rule"), F.col("type") == "invalid"
    said = F.when(invalid, F.array(F.struct(F.col("value"))))
    for i, r in enumerate(rules):
        if faults := _faults(r):
            said = said.when(no == i, F.array(*[F.when(bad, F.struct(x.alias("value"))) for bad, x in faults]))
    name = F.when(invalid, "json").otherwise(F.element_at(F.array(*[F.lit(r.name) for r in rules]), no + 1))
    return facts.select("id", "path", name.alias("rule"), F.inline(F.filter(said, lambda x: x.isNotNull()))).select(*VIOLATIONS)


def _in_order(rule: Rule) -> Callable[[str, object, int | None], bool]:
    """Whether a value (its type, itself, its size) surely breaks none of the parts of a rule that look at it alone. Where Python
    can't be certain of what Spark will say it says no."""
    types, number, one_of, least = rule.types, rule.number, rule.one_of, rule.least
    low, high = number or (None, None)
    like = None
    if rule.like is not None:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # what Java reads in another way
            try:
                like = re.compile(rule.like, re.ASCII)
            except (re.error, FutureWarning, DeprecationWarning):
                return lambda kind, x, size: False

    def fine(kind: str, x: object, size: int | None) -> bool:
        if types and kind not in types:
            return False
        if least is not None and (size or 0) < least:
            return False
        if number is not None and not (kind == "number" and (low is None or x >= low) and (high is None or x <= high)):
            return False
        if like is not None and not (kind == "string" and x.isascii() and x.isprintable() and like.fullmatch(x)):
            return False
        return not one_of or kind == "string" and x in one_of

    return fine


@dataclass(slots=True, eq=False)
class _Asks:
    """What a rule with number n looks for: keys in the object (or in the parent of an array, if it is a span), whose numbers it
    compares, the list of known values and the array by their numbers, and whether equal values are sought."""

    n: int
    fine: Callable[[str, object, int | None], bool]
    holds: str | None
    keys: list[str]
    every: frozenset[str]
    shown: bool
    ranks: bool
    span: bool
    known: int | None
    unique: bool
    sized: int | None
    place: bool


class _Place(dict):
    """What the rules want of the values at a pattern: the rules that look at the value alone, those that look for keys, those that
    look at the whole document, the lists of known values that it adds to, the arrays whose size is asked for. By keys the places
    of an object's values, by None that of an array's; None where no rule looks."""

    def __init__(self, reader: _Reader, pattern: str, own: list[_Asks], tells: list[int], sizes: list[int]):
        self.reader, self.pattern, self.tells, self.sizes = reader, pattern, tells, sizes
        self.far = [r for r in own if r.known is not None or r.unique or r.sized is not None]
        self.keyed = [r for r in own if r.holds and r not in self.far]
        self.alone = [(r.n, r.fine) for r in own if r not in self.far and r not in self.keyed]

    def __missing__(self, key: str | None) -> _Place | None:
        if len(self) >= KEYS:
            self.clear()
        hidden = key is not None and self.reader.hidden and key.startswith(self.reader.hidden)
        self[key] = to = None if hidden else self.reader.place(_join(self.pattern, key, "[*]"))
        return to


def _join(over: str, key: str | int | None, item: str = "[{}]") -> str:
    """The path of a key, or of an array's item, below a path."""
    return f"{over}.{key}" if over and type(key) is str else key if type(key) is str else over + item.format(key)


class _Reader:
    """Reads the FACTS of documents, one after another, but for values that are surely in order."""

    def __init__(self, rules: list[Rule], hidden: str):
        self.hidden = hidden
        known = list(dict.fromkeys(r.known for r in rules if r.known))
        sized = list(dict.fromkeys(r.place or r.as_long for r in rules if r.place or r.as_long))
        self.known, self.sized = [re.compile("|".join(map(_expression, k))) for k in known], [re.compile(_expression(p)) for p in sized]
        self.rules = []
        for n, r in enumerate(rules):
            keys, size = list(_keys(r)), r.place or r.as_long
            asks = _Asks(n, _in_order(r), None if not keys else "array" if r.span else "object", keys, frozenset(keys), not any(hidden and k.startswith(hidden) for k in keys),
                         bool(r.rising or r.span), bool(r.span), known.index(r.known) if r.known else None, r.unique, sized.index(size) if size else None, r.place is not None)
            self.rules.append((re.compile(_expression(r.pattern)), asks))
        over = {p[: m.start()] for r in rules for p in (r.pattern, *r.known, r.place or r.as_long or "") for m in re.finditer(r"\.|\[\*\]", p)}
        self.over = re.compile("|".join(map(_expression, ["", *sorted(over)])))
        self.root = self.place("")

    def place(self, pattern: str) -> _Place | None:
        own = [asks for p, asks in self.rules if p.fullmatch(pattern)]
        tells, sizes = ([i for i, p in enumerate(them) if p.fullmatch(pattern)] for them in (self.known, self.sized))
        if own or tells or sizes or self.over.fullmatch(pattern):  # or a rule looks below
            return _Place(self, pattern, own, tells, sizes)

    def keys(self, asks: _Asks, kind: str, x: object, parent: object) -> tuple[bool, list[str] | None, list[float | None] | None]:
        """Whether no key that a rule asks for is missing or has a number to compare; those that are there, and their numbers."""
        if kind != asks.holds:
            return True, None, None
        holder = parent if asks.span else x
        if type(holder) is not dict:
            return False, [], [None] * len(asks.keys)
        if not asks.ranks and asks.shown and asks.every <= holder.keys():
            return True, asks.keys, None
        has = [k for k in asks.keys if k in holder and not (self.hidden and k.startswith(self.hidden))]
        numbers = [_float(holder[k]) if k in has else None for k in asks.keys] if asks.ranks else None
        return len(has) == len(asks.keys) and not asks.ranks, has, numbers

    def facts(self, docs: Iterable[tuple[str, str | None]]) -> Iterator[list[tuple]]:
        """Parts of the FACTS of documents. Rows that need the rest of their document come at its end; those that look at the value
        alone are shorter, in parts of their own."""
        short, rows = [], []
        for id_, text in docs:
            document, why = _parsed(text)
            if why is not None:
                short.append((id_, "", None, "invalid", why, None))
                continue
            known, limits, seen, twice, late = [set() for _ in self.known], [0] * len(self.sized), set(), {}, []
            todo = [(self.root, "", None, "", document)]
            while todo:
                at, over, parent, name, x = todo.pop()
                t = type(x)
                kind, size = KINDS.get(t, "number"), None
                if t is str:
                    size = len(x)
                elif t is dict:
                    size, path = len(x), _join(over, name)
                    todo += [(to, path, x, k, v) for k, v in x.items() if (to := at[k]) is not None]
                elif t is list:
                    size = len(x)
                    for i in at.sizes:
                        limits[i] = max(limits[i], size)
                    if (to := at[None]) is not None:
                        path = _join(over, name)
                        todo += [(to, path, x, i, v) for i, v in enumerate(x)]
                if at.tells and kind != "boolean" and kind != "null":
                    for i in at.tells:
                        known[i].add(x if t is str else str(name))
                for n, fine in at.alone:
                    if not fine(kind, x, size):
                        short.append((id_, _join(over, name), n, kind, _text(x, kind), size))
                        if len(short) >= FEW:
                            yield short
                            short = []
                for asks in at.keyed:
                    ok, has, numbers = self.keys(asks, kind, x, parent)
                    if not (ok and asks.fine(kind, x, size)):
                        rows.append((id_, _join(over, name), asks.n, kind, _text(x, kind), size, has, numbers, None, None, None))
                for asks in at.far:
                    late.append((asks, over, parent, name, kind, x, size))
                    if asks.unique and kind != "object" and kind != "array":
                        same = asks.n, kind, x if t is str else _text(x, kind)
                        if same in seen:
                            twice[same] = None
                        seen.add(same)
            if twice:
                for asks, over, _, name, kind, x, _ in late:
                    if asks.unique and (same := (asks.n, kind, _text(x, kind))) in twice:
                        twice[same] = min(_join(over, name), twice[same] or _join(over, name))
            for asks, over, parent, name, kind, x, size in late:
                text, limit, there, first = _text(x, kind), None, None, None
                ok, has, numbers = self.keys(asks, kind, x, parent) if asks.holds else (True, None, None)
                ok = ok and asks.fine(kind, x, size)
                if asks.sized is not None:
                    limit = limits[asks.sized]
                    ok = ok and (kind == "number" and limit >= 2 and 0 <= x <= limit - 1 if asks.place else kind == "array" and size == limit)
                if asks.known is not None:
                    there = text is not None and text in known[asks.known]
                    ok = ok and there
                if asks.unique and twice:
                    first = twice.get((asks.n, kind, text))
                    ok = ok and first is None
                if not ok:
                    rows.append((id_, _join(over, name), asks.n, kind, text, size, has, numbers, limit, there, first))
            if len(rows) >= FEW:
                yield rows
                rows = []
        yield short
        yield rows


def _float(x: object) -> float | None:
    """A number as Spark casts its text; None if it is none."""
    if type(x) not in (int, float):
        return None
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def checked(docs: DataFrame, rules: list[Rule], hidden: str = "_") -> DataFrame:
    """VIOLATIONS of a table (id, json), each document by itself. Keys that begin with `hidden` are left out at every level; a
    text that isn't JSON (or is null) breaks the rule 'json', whose value tells why and where."""
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FACTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(rules, hidden)
        for b in batches:
            for few in (b.slice(n, FEW) for n in range(0, b.num_rows, FEW)):
                for rows in reader.facts(zip(few.column(0).to_pylist(), few.column(1).to_pylist())):
                    yield _batch(rows, schema)

    return _judged(docs.select(F.col("id").cast("string").alias("id"), F.col("json").cast("string").alias("json")).mapInArrow(run, FACTS), rules)


def violations(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """VIOLATIONS of a table of ROWS, which is read three times: give a written table if it is costly to make. Rows of a
    document that isn't JSON break the rule 'json'.

    Each different pattern is held against the rules' patterns once; rows are then written by the rules' patterns, and a rule
    reads those of its own only. Patterns that no document has are left out."""
    slots = {p: i for i, p in enumerate(dict.fromkeys(p for r in rules for p in (r.pattern, *_others(r))))}
    slot = F.array_compact(F.array(*[F.when(matching(p), F.lit(i)) for p, i in slots.items()]))
    meant = cut(rows.select("pattern").distinct().select("pattern", F.explode(slot).alias("slot")))
    held = cut(rows.where("type <> 'invalid'").join(meant, "pattern").select("id", "path", "parent", "name", "type", "value", "size", "slot"), "slot")
    there_are = {r.slot for r in meant.select("slot").distinct().collect()}
    at = lambda pattern: held.where(F.col("slot") == slots[pattern]).drop("slot")
    asked = {c: k for c, k in (x.split() for x in FACTS.split(", "))}
    given = lambda d, rule: d.select(*[F.lit(rule).cast(k).alias(c) if c == "rule" else (F.col(c) if c in d.columns else F.lit(None)).cast(k).alias(c) for c, k in asked.items()])
    out = given(rows.where("type = 'invalid'").select("id", "path", "type", "value"), None)
    for n, r in enumerate(rules):
        if slots[r.pattern] not in there_are:
            continue
        d = at(r.pattern)
        keys = _keys(r)
        if keys:
            inside = held.where(F.col("slot").isin([slots[p] for p in keys.values()])).groupBy("id", F.col("parent").alias("over")).agg(
                F.collect_set("name").alias("there"), F.array(*[F.max(F.when(F.col("name") == k, _number())) for k in keys]).alias("numbers")
            )
            d = d.withColumn("over", F.when(F.col("type") == ("array" if r.span else "object"), F.col("parent" if r.span else "path"))).join(inside, ["id", "over"], "left")
            d = d.withColumn("has", F.when(F.col("type") == ("array" if r.span else "object"), F.coalesce("there", F.array().cast("array<string>"))))
        if r.known:
            there = held.where(F.col("slot").isin([slots[p] for p in r.known]) & F.col("type").isin("string", "object", "array", "number"))
            there = there.select("id", F.when(F.col("type") == "string", F.col("value")).otherwise(F.col("name")).alias("value")).distinct()
            d = d.join(there.withColumn("known", F.lit(True)), ["id", "value"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
        if r.unique:
            d = d.join(at(r.pattern).groupBy("id", "type", "value").agg(F.min("path").alias("first")), ["id", "type", "value"], "left")
        if r.place or r.as_long:
            sizes = at(r.place or r.as_long).where("type = 'array'").groupBy("id").agg(F.max("size").alias("limit"))
            d = d.join(sizes, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))
        if faults := _faults(r):
            out = out.unionByName(given(d, n).where(reduce(or_, [bad for bad, _ in faults])))
    return _judged(out, rules)


COLOUR = "#[0-9a-fA-F]{6}"
#: What a viewer's document must hold to: structures, course, views, spots, flow, steps and resection.
VIEWER = [
    Rule("structures", "estructuras", types=("array",), least=1),
    Rule("structure", "estructuras[*]", types=("object",), needs=("k", "n")),
    Rule("structure key", "estructuras[*].k", like="[A-Za-z0-9_-]+", unique=True),
    Rule("structure name", "estructuras[*].n", types=("string",), like=r"(?s).*\S.*"),
    Rule("structure colour", "estructuras[*].c", like=COLOUR),
    Rule("structure opacity", "estructuras[*].a", number=(0, 1)),
    Rule("structure with", "estructuras[*].con", known=("estructuras[*].k",)),
    Rule("hidden in focus", "foco_ocultar[*]", known=("estructuras[*].k",)),
    Rule("hidden list", "foco_ocultar", types=("array",)),
    Rule("course", "ruta.puntos", types=("array",), least=2),
    Rule("course radii", "ruta.radios", as_long="ruta.puntos"),
    Rule("course speed", "ruta.vel", number=(0.01, None)),
    Rule("zone from", "ruta.zonas[*].desde", place="ruta.puntos"),
    Rule("zone to", "ruta.zonas[*].hasta", place="ruta.puntos"),
    Rule("narrow span", "ruta.estrechez", types=("object",), needs=("desde", "hasta"), rising=("desde", "hasta")),
    Rule("narrow from", "ruta.estrechez.desde", place="ruta.puntos"),
    Rule("narrow to", "ruta.estrechez.hasta", place="ruta.puntos"),
    Rule("narrow light", "ruta.estrechez.luz_normal", span=("desde", "hasta")),
    Rule("narrow key", "ruta.estrechez.clave", known=("estructuras[*].k",)),
    Rule("views", "vistas", types=("object",)),
    Rule("view direction", "vistas.*.dir", types=("array",), least=3),
    Rule("view direction number", "vistas.*.dir[*]", number=(None, None)),
    Rule("view radius", "vistas.*.radio", number=(0.01, None)),
    Rule("first view", "vista_inicial", known=("vistas.*",)),
    Rule("spot", "hotspots[*]", types=("object",), needs=("n", "t", "p")),
    Rule("spot number", "hotspots[*].n", number=(None, None), unique=True),
    Rule("spot title", "hotspots[*].t", types=("string",)),
    Rule("spot key", "hotspots[*].k", known=("estructuras[*].k",)),
    Rule("flow view", "flujo.vista", known=("vistas.*",)),
    Rule("steps", "secuencias.*", types=("array",), least=1),
    Rule("step", "secuencias.*[*]", types=("object",), needs=("t",), together=("luz", "pared")),
    Rule("step factor", "secuencias.*[*].escala.*", number=(0.01, None)),
    Rule("step light", "secuencias.*[*].luz", span=("desde", "hasta")),
    Rule("resection", "reseccion", types=("object",), needs=("opciones",)),
    Rule("resection taken", "reseccion.opciones.*.saca", types=("array",)),
    Rule("resection key", "reseccion.opciones.*.saca[*]", known=("estructuras[*].k",)),
    Rule("resection side", "reseccion.opciones.*.planos[*].queda[*].queda", one_of=("antes", "despues")),
    Rule("stage seconds", "seg_etapa", number=(1, 60)),
]
