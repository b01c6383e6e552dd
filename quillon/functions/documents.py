"""JSON document functions over text columns.

Objects keep their members' order and numbers keep their digits. Paths are ``$`` followed
by ``.key`` (any characters up to ``.`` or ``[``), ``."quoted key"`` and ``[n]``, with white
space around them. Results print with ``", "`` and ``": "``. Building objects and arrays and
``unquoted`` stay in the JVM. The others go to Python in Arrow batches: Spark's own functions
lose the order of members or the digits of numbers, or take text for JSON that isn't.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[\]"]+))|\[\s*(\d+)\s*\]')


class Number(str):
    """A number as it was written."""


class BadDocument(ValueError):
    pass


def parse(text: str):
    def refuse(name):
        raise BadDocument(f"not JSON: {name}")

    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=refuse)
    except (ValueError, RecursionError) as e:
        raise BadDocument(str(e)) from e


def render(node) -> str:
    if isinstance(node, Number):
        return str(node)
    if isinstance(node, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {render(v)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + ", ".join(map(render, node)) + "]"
    return json.dumps(node, ensure_ascii=False)


def parse_path(path: str) -> list[str | int]:
    path = path.strip()
    if not path.startswith("$"):
        raise BadDocument(f"a path starts with $: {path}")
    steps, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise BadDocument(f"bad path {path!r} at {at}")
        steps.append(int(m[3]) if m[3] is not None else (json.loads(f'"{m[1]}"') if m[1] is not None else m[2]))
        at = m.end()
    return steps


MISSING = object()


def walk(node, steps: list[str | int]):
    for step in steps:
        if isinstance(step, int):
            node = node[step] if isinstance(node, list) and step < len(node) else MISSING
        else:
            node = node.get(step, MISSING) if isinstance(node, dict) else MISSING
        if node is MISSING:
            break
    return node


def to_node(value):
    """A SQL value as a document node."""
    if value is None or isinstance(value, (bool, dict, list, Number)):
        return value
    if isinstance(value, (int, Decimal)):
        return Number(format(value, "f") if isinstance(value, Decimal) else value)
    if isinstance(value, float):
        return Number(repr(value))
    return str(value)


def put(node, steps: list[str | int], value):
    """The document with ``value`` at the path: replaces, adds a member, or appends when
    the index is the length; a path through something missing changes nothing."""
    if not steps:
        return value
    step, rest = steps[0], steps[1:]
    if isinstance(step, str) and isinstance(node, dict):
        if step in node or not rest:
            return node | {step: put(node.get(step), rest, value)}
    elif isinstance(step, int) and isinstance(node, list):
        if step < len(node):
            return [*node[:step], put(node[step], rest, value), *node[step + 1 :]]
        if step == len(node) and not rest:
            return [*node, value]
    return node


def _each(f: Callable, kind: str, *columns: Column) -> Column:
    """``f`` of each row's values, in Arrow batches; null if the first is null."""

    @F.pandas_udf(kind)
    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else f(*row) for row in zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)], dtype=object)

    return batch(*columns)


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid(document) -> Column:
    """1 for well-formed JSON, 0 for other text, null for null."""

    def check(text: str) -> int:
        try:
            parse(text)
        except BadDocument:
            return 0
        return 1

    return _each(check, "bigint", _column(document))


def extract(document, *paths: str) -> Column:
    """One path: the value's JSON text (strings keep their quotes) or null if it is missing.
    Several: a JSON array with null for those missing. Malformed JSON is an error."""
    steps = [parse_path(p) for p in paths]

    def get(text: str) -> str | None:
        found = [walk(parse(text), s) for s in steps]
        if len(found) == 1:
            return None if found[0] is MISSING else render(found[0])
        return render([None if x is MISSING else x for x in found])

    return _each(get, "string", _column(document))


def _plain(text: str) -> str:
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    try:
        return json.loads(text)
    except ValueError:
        return text


def unquote(document) -> Column:
    """The text of a JSON string; other text unchanged."""
    return _each(_plain, "string", _column(document))


def unquoted(document, path: str) -> Column:
    """``unquote(extract(document, path))`` for documents known to be well formed: stays in
    the JVM."""
    return F.get_json_object(_column(document), path)


def _kind(text: str) -> str:
    node = parse(text)
    if isinstance(node, Number):
        return "DOUBLE" if set(node) & set(".eE") else "INTEGER"
    return {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", type(None): "NULL"}[type(node)]


def kind(document) -> Column:
    """OBJECT, ARRAY, STRING, INTEGER, DOUBLE, BOOLEAN or NULL."""
    return _each(_kind, "string", _column(document))


def function(f: Callable, kind: str = "string"):
    """``f`` of one text as a function that can be registered by name."""

    @F.pandas_udf(kind)
    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return batch


def unquote_function():
    return function(_plain)


def kind_function():
    return function(_kind)


def length(document, path: str = "$") -> Column:
    """Members or elements at a path, 1 for a scalar, null if it is missing."""
    steps = parse_path(path)

    def count(text: str) -> int | None:
        node = walk(parse(text), steps)
        return None if node is MISSING else len(node) if isinstance(node, (dict, list)) else 1

    return _each(count, "bigint", _column(document))


def build_object(*pairs) -> Column:
    """JSON text of key, value, key, value ... in order."""
    pairs = [x if isinstance(x, Column) else F.lit(x) for x in pairs]
    members = [F.concat(printed(k.cast("string")), F.lit(": "), printed(v)) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def printed(value: Column) -> Column:
    """The JSON text of a plain value; null prints as such."""
    one = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def build_array(*values) -> Column:
    """JSON text of an array of the values."""

    return F.concat(F.lit("["), F.concat_ws(", ", *(printed(x if isinstance(x, Column) else F.lit(x)) for x in values)), F.lit("]"))


def assign(document, path: str, value) -> Column:
    """The document with a value replaced or added at a path."""
    steps = parse_path(path)

    def change(text: str, new) -> str:
        return render(put(parse(text), steps, to_node(new)))

    return _each(change, "string", _column(document), value if isinstance(value, Column) else F.lit(value))
