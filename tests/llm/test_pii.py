"""Pseudonyms: format, exact return, one pseudonym per value, an independent finder."""

import datetime
import itertools

import numpy as np
import pytest

from runlens.llm import pii
from tests.llm.tables import FOLDER

VALUES = {
    "card": ["4929348385146306", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "41111111 11111111"],
    "phone": ["+1 (499) 555-6503", "+49 30 1234567", "0044 20 7946 0958", "+44 20 7946 0958"],
    "national": ["(212) 555-0123", "212-555-0123", "212.555.0123", "555 223 4567"],
    "ip": ["97.51.17.173", "0.0.0.0", "255.255.255.255"],
    "email": ["und.34@mail7.example.com"],
    "iso_date": ["2001-02-28", "1999-12-31"], "year_date": ["2020/12/31", "2020.01.02"], "year_date_short": ["2020/1/2"],
    "day_date": ["31.12.1999", "28/02/2001", "31-12-2020"], "day_date_short": ["5/12/2020", "5.1.2020", "1-1-2020"],
    "month_date": ["12/31/2020"], "month_date_short": ["1/31/2020"],
    "day_name_date": ["31 December 2020", "5. May 2021"], "day_name_date_short": ["5 Jan 2020"], "day_name_date_padded": ["05 March 2020"],
    "name_day_date": ["December 31, 2020"], "name_day_date_short": ["Dec 31, 2020", "Jan 5 2020"], "name_day_date_short_padded": ["Feb 05, 2020"],
    "ipv6_full": ["2001:db8:85a3:1:2:8a2e:370:7334"], "ipv6_padded": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
    "ipv6_short": ["2001:db8::1", "fe80::1ff:fe23:4567:890a"], "ipv6_full_upper": ["2001:DB8:85A3:1:2:8A2E:370:7334"],
    "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], "ssn": ["078-05-1120"],
    "secret": ['token = "bc0a5302762f37969011b69180d661037b374f6e"'],
}


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_the_format_and_come_back(kind):
    for value, key in itertools.product(VALUES[kind], ("k", "l", "m")):
        text = f"é before {value} behind"
        new, found = pii.replaced(text, key)
        assert [f[0] for f in found] == [kind], value
        assert value not in new and new.startswith("é before ") and new.endswith(" behind")
        pseudonym = new[found[0][1]:found[0][2]]
        shape = lambda v: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in v)
        if kind in ("card", "phone", "national", "iso_date", "year_date", "day_date", "month_date", "email", "iban", "ssn"):
            assert shape(pseudonym) == shape(value)
        assert pii.restored(new, found, key) == text


def digits_of(text, found):
    return "".join(c for c in text[found[1]:found[2]] if c.isdigit())


def card_numbers(n, seed):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        body = [4, *(int(d) for d in rng.integers(0, 10, 14))]
        yield rng, "".join(map(str, [*body, pii.luhn(body)]))


def test_a_card_behind_other_numbers_has_its_own_pseudonym():
    """No digit of the card stays, whatever number stands before or behind it."""
    for rng, number in card_numbers(1500, 6):
        card = " ".join(number[k:k + 4] for k in range(0, 16, 4))
        alone, found = pii.replaced(f"is {card}.", "k")
        want = digits_of(alone, found[0])
        for text in (f"{rng.integers(10**7, 10**8)} {card} {rng.integers(0, 999):03d}", f"{rng.integers(100, 1000)} {card}, 03/{rng.integers(13, 29)}/1999",
                     f"no {number} {rng.integers(100, 9999)}", f"{rng.integers(1, 99)} {card} {rng.integers(10**5, 10**6)}"):
            new, found = pii.replaced(text, "k")
            assert [digits_of(new, f) for f in found if f[0] == "card"] == [want], text
            assert pii.restored(new, found, "k") == text


def test_equal_values_have_equal_pseudonyms_in_every_notation():
    def value(text, key="k"):
        new, found = pii.replaced(f"at {text} x", key)
        return new[3:-2], found[0][0]

    notations = {"iso_date": "%Y-%m-%d", "day_date": "%d/%m/%Y", "month_date": "%m/%d/%Y"}
    for days in range(0, 73_000, 61):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(days=days)
        if day.day <= 12:  # such a date in slashes is read day first
            continue
        read = set()
        for kind, form in notations.items():
            text, found = value(day.strftime(form))
            assert found == kind
            read.add(datetime.datetime.strptime(text, form).date())
        assert len(read) == 1
    assert value("+44 20 7946 0958")[0][4:] == value("0044 20 7946 0958")[0][5:]
    assert value("4111-1111-1111-1111")[0].replace("-", " ") == value("4111 1111 1111 1111")[0]
    assert value("212-555-0123")[0].replace("-", ".") == value("212.555.0123")[0]
    assert value("5 January 2020")[0][-4:] == value("2020-01-05")[0][:4] == value("Jan 5, 2020")[0][-4:]


@pytest.mark.parametrize("value, behind", [
    ("4111 1111 1111 1111", " 12/25"), ("4111111111111111", " 737"), ("3782 822463 10005", " 1234"), ("41111111 11111111", " 12"),
    ("+1 555 123 4567", " 20 units"), ("+49 30 1234567", " x"), ("2021-03-04", "T10:00"), ("12/31/2020", " x"), ("28/02/2001", " x"),
    ("+1 212 555 0123", " 4111 1111 1111 1112"),
])
def test_values_before_other_numbers(value, behind):
    for before in ("é ", "at "):
        new, found = pii.replaced(before + value + behind, "k")
        assert len(found) == 1 and new.startswith(before) and new.endswith(behind) and new != before + value + behind
        assert pii.restored(new, found, "k") == before + value + behind
        assert new == pii.replaced(before + value, "k")[0] + behind


def test_what_does_not_validate_stays():
    text = ("9807915762804490 999.1.1.1 2001-02-29 31.02.1999 13/13/2000 DE88370400440532013000 000-12-3456 1.2.3 123456 12:30 x@y 1,234,567 "
            "00:1a:2b:3c:4d:5e 2001:db8:1:2:3 a::b::c 31 June 2020 Smarch 5, 2020 1:2 std::vector 100 200 3000 32.1.2020 2020-13-01 2020/5-1")
    assert pii.replaced(text, "k") == (text, [])


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + " 1", "1 " * 150_000, "12-" * 100_000, "AB12 " * 60_000, "a.b-c%" * 50_000 + "@", "1:" * 150_000, "+1 23 " * 50_000):
        new, found = pii.replaced(text, "k")
        assert len(new) == len(text) and pii.restored(new, found, "k") == text


def brute_cards(text):
    """Maximal digit groups by hand: (start, end) of every 4-4-4-4 reading with a valid check digit."""
    out, groups, i = [], [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j].isdigit():
            j += 1
        if j > i:
            groups.append((i, j))
        i = max(j, i + 1)
    for four in zip(groups, groups[1:], groups[2:], groups[3:]):
        gaps = {text[a[1]:b[0]] for a, b in zip(four, four[1:])}
        if all(b - a == 4 for a, b in four) and len(gaps) == 1 and gaps <= {" ", "-"}:
            total = 0
            for k, c in enumerate(reversed([x for a, b in four for x in text[a:b]])):
                n = int(c) * (1 + k % 2)
                total += n - 9 * (n > 9)
            if total % 10 == 0:
                out.append((four[0][0], four[3][1]))
    return out


def test_cards_against_an_independent_finder():
    """Every valid reading of four groups of four is replaced, or overlaps one that is."""
    rng = np.random.default_rng(9)
    seen = 0
    for _, number in card_numbers(400, 8):
        groups = [str(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for _ in range(rng.integers(0, 6))]
        at = int(rng.integers(0, len(groups) + 1))
        mark = rng.choice([" ", "-"])
        text = " ".join([*groups[:at], mark.join(number[k:k + 4] for k in range(0, 16, 4)), *groups[at:], "end"])
        found = {(start, end) for kind, start, end in pii.replaced(text, "k")[1] if kind == "card"}
        for start, end in brute_cards(text):
            seen += 1
            assert any(a < end and start < b for a, b in found), text
    assert seen >= 400


def test_feistel_is_a_bijection():
    p = pii.Permuter("k")
    assert sorted(p.number(v, 1000, "t") for v in range(1000)) == list(range(1000))
    back = pii.Permuter("k", inverse=True)
    assert all(back.number(p.number(v, 97, "t"), 97, "t") == v for v in range(97))
    assert len({tuple(p.digits([a, b, c], [10, 26, 10], "t")) for a in range(10) for b in range(26) for c in range(10)}) == 2600


def test_round_trip_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    done = pii.pseudonymise(docs, "secret key", report="found").cache()
    assert done.where("size(found) > 0").count() > 0
    back = pii.originals(done, "found", "secret key")
    assert back.exceptAll(docs).count() == 0 and docs.exceptAll(back).count() == 0
    with pytest.raises(ValueError, match="there already"):
        pii.pseudonymise(done, report="found")


def test_null_texts_and_reports(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "1.2.3.4"), (None, "1.2.3.4")], "doc_id long, text string")
    out = pii.pseudonymise(docs, report="f").collect()
    assert [r["text"] for r in out[:2]] == [None, ""] and out[2]["text"] == out[3]["text"] != "1.2.3.4"
    broken = spark.createDataFrame([(None, None), ("x", None)], f"text string, f {pii.REPORT}")
    assert [r["text"] for r in pii.originals(broken, "f").collect()] == [None, "x"]
