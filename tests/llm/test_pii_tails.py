"""Valid numbers with other text right before or behind them, against pseudonyms that are made again by hand."""

import datetime as dt
import hashlib
import itertools
import re

import pytest

from quaystone.llm import pii

KEY = pii.derived_key("key")


def feistel(values, radices, tweak):
    h = len(values) // 2
    x, y, rx, ry = values[:h], values[h:], radices[:h], radices[h:]
    for i in range(1, pii.ROUNDS + 1):
        seen = ",".join(map(str, y))
        moved = [(v + int(hashlib.sha256("|".join([KEY, tweak, str(i), str(j), seen]).encode()).hexdigest()[:12], 16)) % rx[j] for j, v in enumerate(x)]
        x, y, rx, ry = y, moved, ry, rx
    return x + y


def sign(c):
    return (ord(c) - 48, 10, 48) if c.isdigit() else (ord(c) - 97, 26, 97) if c.islower() else (ord(c) - 65, 26, 65)


def permuted(signs, tweak):
    parts = [sign(c) for c in signs]
    if len(parts) == 1:
        v, r, base = parts[0]
        a, b = feistel([v % 2, v // 2], [2, r // 2], tweak)
        return chr(base + 2 * b + a)
    return "".join(chr(base + n) for (_, _, base), n in zip(parts, feistel([p[0] for p in parts], [p[1] for p in parts], tweak), strict=True))


def with_signs(shape, signs):
    left = iter(signs)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in shape)


def card(m):
    d = re.sub("[^0-9]", "", m)
    body = d[0] + permuted(d[1:-1], "card")
    check = next(str(c) for c in range(10) if luhn(body + str(c)))
    return with_signs(m, body + check)


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(m):
    flat = m.replace(" ", "")
    body = permuted(flat[4:], "iban" + flat[:2])
    number = int("".join(str(int(c, 36)) for c in body + flat[:2] + "00"))
    return with_signs(m, flat[:2] + f"{98 - number % 97:02d}" + body)


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    a, g, n = feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
    return f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{n + 1:04d}"


def phone(m):
    digits = re.sub("[^0-9]", "", m)
    code = re.match(pii.COUNTRY_CODES, digits).group() if m.startswith("+") else ""
    own = digits[len(code) :]
    us = code == "1" or (not code and len(own) == 10 and own[0] != "0")
    still = 2 if own[0] == "0" else 1
    values, radices, add = [], [], []
    for k, c in enumerate(own[still:]):
        lead = us and k == 3 - still
        low, r = (50, 8) if lead and c >= "2" else (48, 2) if lead else (48, 10)
        values.append(ord(c) - low)
        radices.append(r)
        add.append(low)
    moved = feistel(values, radices, "phone" + ("1" if us else code) + own[:still])
    return with_signs(m, code + own[:still] + "".join(chr(a + v) for a, v in zip(add, moved, strict=True)))


def ipv4(m):
    return ".".join(map(str, feistel([int(x) for x in m.split(".")], [256] * 4, "ipv4")))


def email(m):
    local, domain = m.split("@")
    return with_signs(local, permuted(re.sub("[^A-Za-z0-9]", "", local), "email@" + domain.lower())) + "@" + domain


def date(m):
    form = "%d.%m.%Y" if m[2] == "." else "%Y/%m/%d" if "/" in m else "%Y-%m-%d"
    n = (dt.datetime.strptime(m, form).date() - dt.date(1900, 1, 1)).days
    a, b = feistel([n % 17, n // 17], [17, 4297], "date")
    return (dt.date(1900, 1, 1) + dt.timedelta(days=17 * b + a)).strftime(form)


VALUES = {
    card: ["4041894974608795", "4041 8949 7460 8795", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005", "4222222222222"],
    iban: ["ES9121000418450200051332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    ssn: ["123-45-6789", "899-01-0001"],
    phone: [
        "+1 (988) 555-2485", "+1 415-555-2671", "+14155552671", "+33 1 42 68 53 00", "+33142685300", "+34 612 345 678", "+49 30 1234567", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+41 44 668 18 00", "+351 21 123 4567",
        "(415) 555-2671", "415-555-2671", "555-123-4567", "415.555.2671", "(020) 7946 0958", "030 12345678", "0151/23456789", "(030) 1234567", "01 42 68 53 00", "01.42.68.53.00", "0142685300", "612 345 678", "912 34 56 78",
    ],
    ipv4: ["144.35.254.1", "10.0.0.255"],
    email: ["bob.42@mail8.example.com", "a@x.io", "b@x.io", "7@x.io", "A.b-c@Example.COM"],
    date: ["1984-02-29", "2024/12/31", "29.02.1984"],
}
AROUND = [("", ""), ("pay ", " now"), ("ref no, ", ", 12/27"), ("(", ")"), ("word:", ".")]
#: Numbers right beside one another, where a match could run on.
BESIDE = {card: [("", " 12/25"), ("12 ", " 123"), ("", " 2024-01-05")], iban: [("", " EUR 50"), ("", " 2024"), ("", " A1")], phone: [("", ", 50")], date: [("4 ", " 5")], email: [("12 ", " 5")], ssn: [("5 ", " 5")], ipv4: [("5 ", " 5")]}


def test_every_kind_beside_other_text(spark):
    rows, expected = [], []
    for make, values in VALUES.items():
        for value, (before, behind) in itertools.product(values, AROUND + BESIDE[make]):
            if make is phone and not value.startswith(("+", "(")) and before == "(":
                continue
            tail = date("2024-01-05") if behind == " 2024-01-05" else None
            rows.append((len(rows), before + value + behind))
            expected.append((before + make(value) + (" " + tail if tail else behind), {make.__name__: 1, **({"date": 1} if tail else {})}))
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), "key").collect()}
    wrong = [(rows[i][1], out[i].text, expected[i][0], out[i].found) for i in range(len(rows)) if (out[i].text, out[i].found) != expected[i]]
    assert not wrong


@pytest.mark.parametrize(("a", "b"), [("+1 (415) 555-2671", "+14155552671"), ("+33 1 42 68 53 00", "+33142685300"), ("4111 1111 1111 1111", "4111111111111111"), ("415-555-2671", "(415) 555-2671")])
def test_one_number_in_two_forms(spark, a, b):
    out = pii.pseudonymise(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string"), "key").collect()
    assert len({re.sub("[^0-9]", "", r.text) for r in out}) == 1 and {r.text for r in out}.isdisjoint({a, b})


def test_single_letters_are_permuted(spark):
    """All of them, and not by one shift."""
    rows = [(i, f"{c}@x.io") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    out = [r.text[0] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), "key").orderBy("doc_id").collect()]
    assert sorted(out) == list("abcdefghijklmnopqrstuvwxyz") and len({(ord(c) - 97 - i) % 26 for i, c in enumerate(out)}) > 3


def test_numbers_that_are_none_stay(spark):
    texts = ["4041894974608796", "+1 (155) 555-2485", "+33 1 42", "in 2024 12 345", "1 234 567 890 123", "12.05", "page 0123", "3.14159265358979", "900-12-3456", "999.999.999.999", "2024-13-45", "00 11 22 33 44"]
    out = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "key").collect()
    assert {r.doc_id: (r.text, r.found) for r in out} == {i: (t, {}) for i, t in enumerate(texts)}


def test_the_secret_is_not_in_the_plan(spark):
    table = pii.pseudonymise(spark.createDataFrame([(1, "a@x.io")], "doc_id bigint, text string"), "very-secret-word")
    assert "very-secret-word" not in table._jdf.queryExecution().toString()
