"""The token reader against Python's own JSON library."""

import json
import math
import random

import pytest
from runlens.functions import json_text as jt


def want(text):
    """Entries as sorted, printed anew by the json library; what it refuses is raw text."""
    if text is None:
        return {"value": "null"}
    try:
        value = json.loads(text)
        if "Infinity" in json.dumps(value) or "NaN" in json.dumps(value):
            raise ValueError
    except ValueError:
        value = {"raw": text}
    value = value if isinstance(value, dict) else {"value": value}
    return {k: json.dumps(v, sort_keys=True, ensure_ascii=False) for k, v in sorted(value.items())}


def check(spark, texts):
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", jt.arguments("t").alias("e")).select("*", jt.printed("e").alias("p")).collect()
    for r in out:
        expected = want(texts[r.i])
        assert [(x.key, x.text) for x in r.e] == list(expected.items()), texts[r.i]
        assert r.p == "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in expected.items()) + "}"


CASES = [
    '{"a": 1}', '{"a": 1.0}', '{"a":1e2}', '{"a":1,"a":2}', '{"b":{"y":1,"x":[1, 2.50,{"k":null,"j":true}]},"a":"t"}', "{}", "[]", "[[],{}]",
    '{"a":{"x":1,"x":{"z":1,"z":2}}}', "null", "true", "12", "-0", "-0.0", '"text"', "", "   ", None, "not json", "[1, 2]", "[1,]", "{,}", '{"a"}', '{"a":}',
    '{"a":1,}', '{"a" 1}', '{1:2}', "[1 2]", "[1,,2]", "{}{}", "1 2", "01", "1.", ".5", "+1", "--1", "tru", "'a'", "{'a':1}", '{"a":1', '{"a":1]', "[1}",
    '"a\nb"', '"a\\nb"', '"\\u0041\\/\\u00e9\\ud83d\\ude00"', '"\\u0000\\u001f\\u007f"', '"\\x"', '"\\u12"', '{"\\u0061":1,"a":2}', '{"é":1,"z":2,"a\\"b":3}',
    "123456789012345678901234567890", "1e16", "1e15", "12345678.5", "0.0001", "0.00001", "1e-7", "1.5e300", "-2.5E+10", "1E400", "NaN", "-Infinity",
    '{"a":NaN}', '\t{ "a"\n:\r[ ] } ', '{"a":"' + "x\\n" * 20000 + '"}', "[" * 40 + "]" * 40, '{"text":"a, b: {c} [d]"}', "\ufeff{}", "{\"a\":\u00a01}",
]


def test_cases(spark):
    check(spark, CASES)


def test_random_values(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind >= 7:
            return {rng.choice(["a", "b", "c", "ü", "\U0001f600", ""]): value(depth - 1) for _ in range(rng.randrange(4))}
        if kind == 6:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return [None, True, rng.randrange(-10**12, 10**12), rng.uniform(-1, 1) * 10.0 ** rng.randrange(-3, 7),
                "".join(rng.choice("ab\"\\\n\t/é\x01{}[]:, ") for _ in range(rng.randrange(6))), False][kind]

    texts = [json.dumps(value(3), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(300)]
    broken = []
    for t in texts:
        at = rng.randrange(len(t))
        broken.append(t[:at] + rng.choice(['"', "{", "}", ",", ":", "1", "\\", ""]) + t[at + 1:])
    check(spark, texts + broken)


@pytest.mark.parametrize("text,value", [('{"k":"a\\tb"}', "a\tb"), ('{"k":1.0}', "1.0"), ('{"k":null}', "None"), ('{"k":true}', "True"),
                                        ('{"k":[1,2]}', "[1, 2]"), ("{}", None), ('{"k":"null"}', "null")])
def test_plain_text_of_an_entry(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(jt.arguments("t").alias("a")).select(
        jt.entry_text("a", "k")).first()[0] == value


def test_floats_print_as_repr(spark):
    numbers = [0.0, -0.0, 1.0, 123456.789, 1e7, 9999999.0, 12345678.25, 1e15, 9.007199254740993e15, 1e16, 1.5e16, 1e22, 1e-3, 1e-4, 1.25e-4, 1e-5,
               -3.75e-9, 1e100, 1.7976931348623157e308, math.pi]
    out = spark.createDataFrame([(x,) for x in numbers], "x double").select(jt.float_text("x")).collect()
    assert [r[0] for r in out] == [repr(x) for x in numbers]
