"""JSON objects read token by token, true to their text, as SQL expressions.

A text is cut into tokens by one regular expression; a fold over the tokens with a stack of open
objects and lists checks the grammar and prints every value anew: keys sorted, of a repeated key
the last value, ``, `` and ``: `` between parts at every depth, whole numbers digit by digit,
other numbers in their shortest form (``1`` and ``1.0`` differ, ``1e2`` is ``100.0``), strings
with the fewest escapes.

Functions with a leading underscore take and give SQL text, which one call turns into a Column:
a tree of this size, built Column by Column, would take a second of round trips to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar's tokens (fixed values); possessive, so that long strings need no backtracking.
STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?"
TOKEN = rf"{STRING}|{NUMBER}|true|false|null|[\[\]{{}}:,]"
BLANK = r"[ \t\n\r]++"

_ITEMS = "array<struct<key:string,at:int,text:string>>"
_STACK = f"array<struct<open:string,want:string,key:string,items:{_ITEMS}>>"
_NONE = f"CAST(array() AS {_ITEMS})"
_NO_KEY = "CAST(NULL AS STRING)"
_SLASH = "char(92)"
#: Short escapes of control characters (fixed values).
_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _let(value: str, name: str, body: str) -> str:
    """The same in SQL text: ``name`` stands for the value in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _decoded(token: str) -> str:
    """The text that a JSON string token stands for."""
    return (f"IF(contains({token}, {_SLASH}), get_json_object(concat('{{\"a\":', {token}, '}}'), '$.a'), "
            f"substr({token}, 2, length({token}) - 2))")


def _quoted(text: str) -> str:
    """A text as JSON string: quotes, backslashes and control characters escaped, nothing else."""
    out = f"replace(replace({text}, {_SLASH}, concat({_SLASH}, {_SLASH})), '\"', concat({_SLASH}, '\"'))"
    short = "q"
    for code, letter in _SHORT.items():
        short = f"replace({short}, char({code}), concat({_SLASH}, '{letter}'))"
    every = (f"aggregate(sequence(0, 31), {short}, (acc, code) -> "
             f"replace(acc, char(code), concat({_SLASH}, 'u', lpad(lower(hex(code)), 4, '0'))))")
    body = _let(out, "q", f"IF(q RLIKE r'[\\x00-\\x1f]', {every}, q)")
    return f"concat('\"', {body}, '\"')"


def _float_text(number: str) -> str:
    """A double in its shortest form: plain from 1e-4 to below 1e16, else with an exponent of two digits or more."""
    sign, first, rest, power = (f"regexp_extract(s, r'^(-?)(\\d+)\\.(\\d+)E(-?\\d+)$', {k})" for k in range(1, 5))
    mantissa = "concat(substr(p.d, 1, 1), IF(length(p.d) > 1, concat('.', substr(p.d, 2)), ''))"
    exponent = "concat(IF(p.e < 0, 'e-', 'e+'), IF(abs(p.e) > 99, CAST(abs(p.e) AS STRING), lpad(CAST(abs(p.e) AS STRING), 2, '0')))"
    large = "concat(rpad(p.d, p.e + 1, '0'), '.', IF(length(p.d) > p.e + 1, substr(p.d, p.e + 2), '0'))"
    scaled = f"CASE WHEN p.e BETWEEN 7 AND 15 THEN {large} WHEN p.e = -4 THEN concat('0.000', p.d) ELSE concat({mantissa}, {exponent}) END"
    parts = f"named_struct('d', concat({first}, IF({rest} = '0', '', {rest})), 'e', CAST({power} AS INT))"
    return _let(f"CAST(CAST({number} AS DOUBLE) AS STRING)", "s", f"IF(contains(s, 'E'), concat({sign}, {_let(parts, 'p', scaled)}), s)")


def _scalar(token: str) -> str:
    """The canonical form of a string, number or word; null for a number beyond all doubles."""
    number = (f"CASE WHEN {token} RLIKE '[.eE]' THEN IF(abs(CAST({token} AS DOUBLE)) < CAST('Infinity' AS DOUBLE), {_float_text(token)}, NULL) "
              f"WHEN {token} = '-0' THEN '0' ELSE {token} END")
    return (f"CASE WHEN startswith({token}, '\"') THEN IF(contains({token}, {_SLASH}), {_quoted(_decoded(token))}, {token}) "
            f"WHEN {token} RLIKE '^[-0-9]' THEN {number} ELSE {token} END")


def _frame(opened: str, want: str, key: str, items: str) -> str:
    return f"named_struct('open', {opened}, 'want', {want}, 'key', {key}, 'items', {items})"


def _put(frame: str, text: str) -> str:
    """The frame after a value has ended in it."""
    item = f"named_struct('key', {frame}.key, 'at', size({frame}.items), 'text', {text})"
    return _frame(f"{frame}.open", f"IF({frame}.open = '', 'end', 'comma')", _NO_KEY, f"concat({frame}.items, array({item}))")


def _last_of_each(items: str) -> str:
    """Items by key, of each key the last one."""
    return _let(f"sort_array({items})", "o", "filter(o, (x, i) -> NOT coalesce(get(o, i + 1).key = x.key, FALSE))")


def _printed(items: str) -> str:
    return f"concat('{{', array_join(transform({items}, x -> concat({_quoted('x.key')}, ': ', x.text)), ', '), '}}')"


def _step() -> str:
    """(state, token) -> state; a null stack stands for a text that breaks the grammar."""
    closed = f"IF(b.top.open = '{{', {_printed(_last_of_each('b.top.items'))}, concat('[', array_join(transform(b.top.items, x -> x.text), ', '), ']'))"
    parent = _let("named_struct('up', get(s.stack, size(s.stack) - 2), 't', " + closed + ")", "z", _put("z.up", "z.t"))

    def on(frame: str) -> str:
        return f"concat(slice(s.stack, 1, size(s.stack) - 1), array({frame}))"

    def again(want: str, key: str = "b.top.key") -> str:
        return on(_frame("b.top.open", want, key, "b.top.items"))

    scalar = _let(_scalar("t"), "v", f"IF(v IS NULL, NULL, {on(_put('b.top', 'v'))})")
    value = "b.top.want IN ('value', 'first value')"
    stack = f"""CASE
        WHEN t = '{{' THEN IF({value}, concat(s.stack, array({_frame("'{'", "'first key'", _NO_KEY, _NONE)})), NULL)
        WHEN t = '[' THEN IF({value}, concat(s.stack, array({_frame("'['", "'first value'", _NO_KEY, _NONE)})), NULL)
        WHEN t IN ('}}', ']') THEN IF(b.ends, concat(slice(s.stack, 1, size(s.stack) - 2), array({parent})), NULL)
        WHEN t = ',' THEN IF(b.top.want = 'comma', {again("IF(b.top.open = '{', 'key', 'value')")}, NULL)
        WHEN t = ':' THEN IF(b.top.want = 'colon', {again("'value'")}, NULL)
        WHEN {value} THEN {scalar}
        WHEN startswith(t, '"') AND b.top.want IN ('key', 'first key') THEN {again("'colon'", _decoded('t'))} END"""
    ends = ("(u.open = '{' AND t = '}' AND u.want IN ('first key', 'comma')) "
            "OR (u.open = '[' AND t = ']' AND u.want IN ('first value', 'comma'))")
    bound = _let("get(s.stack, size(s.stack) - 1)", "u", f"named_struct('top', u, 'ends', {ends})")
    # held: what the last closed frame held; at the end, the items of the outermost one
    return _let(bound, "b", f"named_struct('stack', CAST({stack} AS {_STACK}), 'held', IF(b.ends, b.top.items, s.held))")


def _value(text: str) -> str:
    """struct<text, items, object>: the canonical text of a JSON value, and the items of an object.

    Null where the text (or null) is no JSON value by the strict grammar. NaN and Infinity, and
    numbers beyond all doubles, are none.
    """
    first = _frame("''", "'value'", _NO_KEY, _NONE)
    done = ("IF(size(s.stack) = 1 AND get(s.stack, 0).want = 'end', named_struct('text', get(get(s.stack, 0).items, 0).text, "
            "'items', s.held, 'object', startswith(get(get(s.stack, 0).items, 0).text, '{')), NULL)")
    return (f"IF(regexp_replace({text}, r'{TOKEN}|{BLANK}', '') = '', aggregate(regexp_extract_all({text}, r'{TOKEN}', 0), "
            f"named_struct('stack', CAST(array({first}) AS {_STACK}), 'held', {_NONE}), (s, t) -> {_step()}, s -> {done}), NULL)")


def arguments(text: str) -> Column:
    """The entries (key, canonical text) of a call's arguments, by key; ``text`` names the column.

    Text that is no JSON becomes the entry ``raw``, a value that is no object the entry ``value``,
    a missing text the entry ``value`` null.
    """

    def one(key: str, value: str) -> str:
        return f"array(named_struct('key', '{key}', 'text', {value}))"

    items = f"transform({_last_of_each('f.items')}, x -> named_struct('key', x.key, 'text', x.text))"
    missing, raw, value = one("value", "'null'"), one("raw", _quoted(text)), one("value", "f.text")
    chosen = f"CASE WHEN {text} IS NULL THEN {missing} WHEN f IS NULL THEN {raw} WHEN f.object THEN {items} ELSE {value} END"
    return F.expr(_let(_value(text), "f", chosen))


def object_entries(text: str) -> Column:
    """The entries (key, canonical text) of a JSON object; null for any other text. ``text`` names the column."""
    items = f"transform({_last_of_each('f.items')}, x -> named_struct('key', x.key, 'text', x.text))"
    return F.expr(_let(_value(text), "f", f"IF(f.object, {items}, NULL)"))


def text_values(entries: str) -> Column:
    """The values of the entries that are strings, decoded."""
    return F.expr(f"transform(filter({entries}, x -> startswith(x.text, '\"')), x -> {_decoded('x.text')})")


def entry_text(entries: str, key: str) -> Column:
    """A value as plain text: strings decoded, the words null, true and false as None, True and False; null if missing."""
    words = "CASE e WHEN 'null' THEN 'None' WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE e END"
    return F.expr(_let(f"get(filter({entries}, x -> x.key = '{key}'), 0).text", "e", f"IF(startswith(e, '\"'), {_decoded('e')}, {words})"))


def printed(entries: str) -> Column:
    """The object of the entries; ``entries`` names the column or is SQL text."""
    return F.expr(_printed(entries))


def float_text(number: str) -> Column:
    """A double column in the form that JSON numbers are printed in."""
    return F.expr(_float_text(number))
