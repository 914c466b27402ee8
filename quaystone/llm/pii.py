"""Format-preserving pseudonyms for personal data, by keyed Feistel networks inside Spark's own expressions.

A match becomes a vector of numbers, each with its own radix (a digit 10, a letter 26, an octet 256, the day of
a date two mixed digits). The vector is cut into halves; in every round a keyed hash of one half, the round
and the position is added to the other half modulo its radices. That is a permutation of all vectors with
these radices, so equal values get equal pseudonyms in every document, different values different ones, and
every pseudonym has the format of what it replaces.

Kinds, each validated before it is touched:

* card:  13 to 19 digits with a correct Luhn digit, in whole groups of a longer run of digits too. The first digit stays; the Luhn digit is made anew.
* iban:  correct modulus 97. The country stays; check digits are made anew; letters stay letters.
* ssn:   a valid area, group and serial number, permuted within the valid ones.
* phone: a country code with the number of national digits that it allows, or a number as the US, Germany, France, Spain or
         Great Britain write it at home. The country code, the first national digit and all marks stay, in the
         US also that an exchange begins with 2 to 9. A number is the same however it is grouped.
* ipv4:  four octets, each from 0 to 255, as one vector.
* email: letters and digits of the local part within their class; marks and the domain stay.
* date:  year-month-day with - or /, day.month.year, of a real date from 1900 to 2099; permuted within these.

A match that fails validation stays as it is.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _ibans() -> str:
    """Numbers of their country's length first, so that a word behind them is not taken in; then any others."""
    known = []
    for n, codes in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        known.append("(?:" + codes.replace(" ", "|") + ")[0-9]{2}(?: ?[A-Z0-9]{4}){" + str(fours) + "}" + (" ?[A-Z0-9]{" + str(rest) + "}" if rest else ""))
    other = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return "(?<![A-Za-z0-9])(?:" + "|".join([*known, other]) + ")(?![A-Za-z0-9])"


#: Country codes of one and of two digits; all others have three.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
#: National digits by country code, where they are fixed or within narrow bounds; others have 6 to 12.
NATIONAL_DIGITS = {"1": (10, 10), "7": (10, 10), "33": (9, 9), "34": (9, 9), "44": (9, 10), "49": (6, 11)}


def _phones() -> str:
    """With a country code, as many digits as it allows, in any groups; at home, the groups and marks that are usual there."""
    mark = r"[ .\-/()]{0,2}"
    bounds = [*((c, low, high) for c, (low, high) in NATIONAL_DIGITS.items()), (f"(?:{COUNTRY_CODES})", 6, 12)]
    out = [rf"(?<![0-9+])\+{c}{mark}(?:\(0\) ?)?[1-9](?:{mark}[0-9]){{{low - 1},{high - 1}}}(?![0-9])" for c, low, high in bounds]
    edge, end = r"(?<![0-9+(]|[0-9][ .\-/])", r"(?![0-9]|[ .\-/][0-9])"
    # US: area, exchange, line; in brackets or with one mark throughout
    out += [rf"(?<![0-9])\([2-9][0-9]{{2}}\) ?[0-9]{{3}}[ \-][0-9]{{4}}(?![0-9])", *(rf"{edge}[2-9][0-9]{{2}}{m}[0-9]{{3}}{m}[0-9]{{4}}{end}" for m in ("-", r"\.", " "))]
    # area codes with their 0 in brackets (Great Britain, Germany), or before a slash, blank or hyphen (Germany, Great Britain)
    out += [rf"(?<![0-9])\(0[1-9][0-9]{{1,4}}\) ?[0-9]{{3,8}}(?:[ \-][0-9]{{2,5}})?(?![0-9])", rf"{edge}0[1-9][0-9]{{1,4}}[ /\-][0-9]{{3,9}}(?:[ \-][0-9]{{2,5}})?{end}"]
    # France: five pairs; Spain: nine digits from 6 on in threes, or three and then pairs
    out += [rf"{edge}0[1-9](?:{m}[0-9]{{2}}){{4}}{end}" for m in (" ", r"\.", "-", "")]
    out += [rf"{edge}[6-9][0-9]{{2}} [0-9]{{3}} [0-9]{{3}}{end}", rf"{edge}[6-9][0-9]{{2}}(?: [0-9]{{2}}){{3}}{end}"]
    return "|".join(out)


_DATES = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}"
#: Earlier kinds win where two begin at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "iban": _ibans(),
    "phone": _phones(),
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9\-/.])(?:{_DATES})(?![0-9]|[\-/.][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    # a date behind a blank is not part of a card's run
    "card": rf"(?<![0-9])[0-9](?:(?! (?:{_DATES})(?![0-9]))[ \-]?[0-9]){{12,18}}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

FIRST_DAY, DAYS = "DATE'1900-01-01'", 73049
#: 17 * 4297 = 73049 days, so that a date is exactly a vector of these two radices.
DAY_RADICES = (17, 4297)
SSN_RADICES = (898, 99, 9999)


def _quote(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _feistel(vector: str, tweak: str, key: str) -> str:
    """SQL for the permuted vector: array<int> from array<struct<v int, r int>>; halves swap in each round."""
    half = f"int(size({vector}) / 2)"
    hashed = f"sha2(concat_ws('|', {key}, {tweak}, string(i), string(j), array_join(transform(s.y, t -> t.v), ',')), 256)"
    moved = f"transform(s.x, (e, j) -> named_struct('v', int(pmod(e.v + bigint(conv(substring({hashed}, 1, 12), 16, 10)), e.r)), 'r', e.r))"
    begin = f"named_struct('x', slice({vector}, 1, {half}), 'y', slice({vector}, {half} + 1, size({vector})))"
    run = f"aggregate(sequence(1, {ROUNDS}), {begin}, (s, i) -> named_struct('x', s.y, 'y', {moved}), s -> concat(s.x, s.y))"
    return f"transform({run}, e -> e.v)"


def _feistel_any(vector: str, tweak: str, key: str) -> str:
    """As _feistel, also for a vector of one element: its radix (10 or 26) is cut into 2 and a half, so that neither half is empty."""
    two = f"array({_element('w[0].v % 2', '2')}, {_element('int(w[0].v / 2)', 'int(w[0].r / 2)')})"
    alone = f"element_at(transform(array({_feistel(two, tweak, key)}), n -> array(n[1] * 2 + n[0])), 1)"
    return f"element_at(transform(array({vector}), w -> CASE WHEN size(w) = 1 THEN {alone} ELSE {_feistel('w', tweak, key)} END), 1)"


def _element(v: str, r: str) -> str:
    return f"named_struct('v', int({v}), 'r', int({r}))"


def _luhn_sum(digits: str, shift: int) -> str:
    """Luhn sum of a string of digits; shift 1 if a check digit is still to follow."""
    n = f"length({digits})"
    d = f"int(substring({digits}, {n} - i, 1))"
    twice = f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"
    return f"aggregate(sequence(0, {n} - 1), 0, (a, i) -> a + CASE WHEN (i + {shift}) % 2 = 1 THEN {twice} ELSE {d} END)"


def _mod97(s: str) -> str:
    """The modulus 97 of a string of digits and upper-case letters (10 to 35)."""
    return (
        f"aggregate(split({s}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(c)) % 97 "
        "ELSE (a * 100 + ascii(c) - 55) % 97 END)"
    )


#: One character as an element: digits and letters within their class, all else fixed.
_CHAR = (
    "CASE WHEN c BETWEEN '0' AND '9' THEN " + _element("ascii(c) - 48", "10") + " WHEN c BETWEEN 'a' AND 'z' THEN " + _element("ascii(c) - 97", "26")
    + " WHEN c BETWEEN 'A' AND 'Z' THEN " + _element("ascii(c) - 65", "26") + " ELSE " + _element("0", "1") + " END"
)


def _chars(s: str) -> str:
    return f"filter(split({s}, ''), c -> c <> '')"


def _written(s: str, numbers: str) -> str:
    """Characters of s with those of digits and letters replaced by the numbers, position by position."""
    back = (
        "CASE WHEN c BETWEEN '0' AND '9' THEN char(48 + v) WHEN c BETWEEN 'a' AND 'z' THEN char(97 + v) "
        "WHEN c BETWEEN 'A' AND 'Z' THEN char(65 + v) ELSE c END"
    )
    return f"array_join(zip_with({_chars(s)}, {numbers}, (c, v) -> {back}), '')"


def _permute_chars(s: str, tweak: str, key: str) -> str:
    """Only letters and digits are in the vector: marks neither move nor weigh in."""
    inner = f"regexp_replace({s}, '[^0-9A-Za-z]', '')"
    moved = f"element_at(transform(array({inner}), u -> {_written('u', _feistel_any(f'transform({_chars("u")}, c -> {_CHAR})', tweak, key))}), 1)"
    return _with_signs(s, moved)


def _with_signs(shape: str, signs: str) -> str:
    """shape with its letters and digits replaced by those of ``signs``, in order."""
    step = (
        "(a, c) -> CASE WHEN c RLIKE '[0-9A-Za-z]' THEN named_struct('o', concat(a.o, substring(z, a.k, 1)), 'k', a.k + 1) "
        "ELSE named_struct('o', concat(a.o, c), 'k', a.k) END"
    )
    return f"element_at(transform(array({signs}), z -> aggregate({_chars(shape)}, named_struct('o', '', 'k', 1), {step}, a -> a.o)), 1)"


def _card(m: str, key: str) -> tuple[str, str]:
    # the longest valid run of whole groups: numbers before or behind a card can be in the match
    part = f"substring({m}, -r.b, r.n)"
    digits = f"regexp_replace({part}, '[^0-9]', '')"
    begins = f"filter(sequence(1, length({m})), p -> p = 1 OR substring({m}, p - 1, 1) IN (' ', '-'))"
    ends = f"filter(sequence(1, length({m})), q -> q = length({m}) OR substring({m}, q + 1, 1) IN (' ', '-'))"
    runs = f"filter(flatten(transform({begins}, p -> transform({ends}, q -> named_struct('n', q - p + 1, 'b', -p)))), r -> r.n >= 13 AND length({digits}) BETWEEN 13 AND 19 AND {_luhn_sum(digits, 0)} % 10 = 0)"
    body = f"substring({digits}, 2, length({digits}) - 2)"
    new = f"concat(substring({digits}, 1, 1), {_permute_chars(body, _quote('card'), key)})"
    full = f"element_at(transform(array({new}), b -> concat(b, string(pmod(-({_luhn_sum('b', 1)}), 10)))), 1)"
    made = _with_signs(part, full)
    whole = f"concat(substring({m}, 1, -r.b - 1), {made}, substring({m}, r.n - r.b))"
    return f"size({runs}) > 0", f"element_at(transform(array(array_max({runs})), r -> {whole}), 1)"


def _iban(m: str, key: str) -> tuple[str, str]:
    flat = f"replace({m}, ' ', '')"
    valid = f"length({flat}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substring({flat}, 5), substring({flat}, 1, 4))')} = 1"
    body = _permute_chars(f"substring({flat}, 5)", f"concat('iban', substring({flat}, 1, 2))", key)
    mod = _mod97(f"concat(b, substring({flat}, 1, 2), '00')")
    made = f"element_at(transform(array({body}), b -> concat(substring({flat}, 1, 2), lpad(string(98 - {mod}), 2, '0'), b)), 1)"
    return valid, _with_signs(m, made)


def _ssn(m: str, key: str) -> tuple[str, str]:
    area, group, serial = (f"int(substring({m}, {a}, {n}))" for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    index = f"{area} - 1 - CASE WHEN {area} > 666 THEN 1 ELSE 0 END"
    vector = f"array({_element(index, SSN_RADICES[0])}, {_element(group + ' - 1', SSN_RADICES[1])}, {_element(serial + ' - 1', SSN_RADICES[2])})"
    new = _feistel(vector, _quote("ssn"), key)
    parts = "concat(lpad(string(n[0] + CASE WHEN n[0] >= 665 THEN 2 ELSE 1 END), 3, '0'), '-', lpad(string(n[1] + 1), 2, '0'), '-', lpad(string(n[2] + 1), 4, '0'))"
    return valid, f"element_at(transform(array({new}), n -> {parts}), 1)"


def _phone(m: str, key: str) -> tuple[str, str]:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    abroad = f"startswith({m}, '+')"
    # p: the code (none at home) and the national digits
    code = f"CASE WHEN {abroad} THEN regexp_extract({digits}, '^(?:{COUNTRY_CODES})', 0) ELSE '' END"
    split = f"element_at(transform(array({code}), x -> named_struct('c', x, 'd', substring({digits}, length(x) + 1))), 1)"
    n = "length(regexp_replace(p.d, '^0', ''))"
    bounds = " ".join(f"WHEN '{c}' THEN {n} BETWEEN {low} AND {high}" for c, (low, high) in NATIONAL_DIGITS.items())
    us = "(p.c = '1' OR (p.c = '' AND length(p.d) = 10 AND NOT startswith(p.d, '0')))"
    home = "length(p.d) BETWEEN 9 AND 12 AND NOT startswith(p.d, '00')"
    good = f"CASE p.c {bounds} WHEN '' THEN {home} ELSE {n} BETWEEN 6 AND 12 END AND NOT ({us} AND substring(p.d, 1, 1) < '2')"
    valid = f"exists(array({split}), p -> {good})"
    # the first digit stays, with a 0 before it the next one too; the US exchange keeps to 2 to 9 or to 0 and 1
    still = "CASE WHEN startswith(p.d, '0') THEN 2 ELSE 1 END"
    lead = f"({us} AND k = 3 - {still})"
    element = f"CASE WHEN {lead} AND c >= '2' THEN {_element('ascii(c) - 50', '8')} WHEN {lead} THEN {_element('ascii(c) - 48', '2')} ELSE {_element('ascii(c) - 48', '10')} END"
    rest = f"substring(p.d, {still} + 1)"
    area = f"concat('phone', CASE WHEN {us} THEN '1' ELSE p.c END, substring(p.d, 1, {still}))"
    moved = _feistel(f"transform({_chars(rest)}, (c, k) -> {element})", area, key)
    back = f"array_join(transform({_chars(rest)}, (c, k) -> CASE WHEN {lead} AND c >= '2' THEN char(50 + n[k]) ELSE char(48 + n[k]) END), '')"
    made = f"element_at(transform(array({moved}), n -> concat(p.c, substring(p.d, 1, {still}), {back})), 1)"
    return valid, _with_signs(m, f"element_at(transform(array({split}), p -> {made}), 1)")


def _ipv4(m: str, key: str) -> tuple[str, str]:
    octets = f"split({m}, '[.]')"
    valid = f"forall({octets}, o -> int(o) <= 255)"
    vector = f"transform({octets}, o -> {_element('o', '256')})"
    return valid, f"array_join(transform({_feistel(vector, _quote('ipv4'), key)}, v -> string(v)), '.')"


def _email(m: str, key: str) -> tuple[str, str]:
    local, domain = f"substring_index({m}, '@', 1)", f"substring({m}, length(substring_index({m}, '@', 1)) + 1)"
    return "true", f"concat({_permute_chars(local, f'concat({_quote("email")}, lower({domain}))', key)}, {domain})"


def _date(m: str, key: str) -> tuple[str, str]:
    dotted = f"substring({m}, 3, 1) = '.'"
    iso = f"CASE WHEN {dotted} THEN concat(substring({m}, 7, 4), '-', substring({m}, 4, 2), '-', substring({m}, 1, 2)) ELSE replace({m}, '/', '-') END"
    day = f"try_cast({iso} AS DATE)"
    number = f"datediff({day}, {FIRST_DAY})"
    small, large = DAY_RADICES
    new = _feistel(f"array({_element(f'{number} % {small}', str(small))}, {_element(f'int({number} / {small})', str(large))})", _quote("date"), key)
    moved = f"date_add({FIRST_DAY}, n[1] * {small} + n[0])"
    out = f"element_at(transform(array({new}), n -> CASE WHEN {dotted} THEN date_format({moved}, 'dd.MM.yyyy') WHEN contains({m}, '/') THEN date_format({moved}, 'yyyy/MM/dd') ELSE date_format({moved}, 'yyyy-MM-dd') END), 1)"
    return f"coalesce({number} BETWEEN 0 AND {DAYS - 1}, false)", out


MAKERS = {"email": _email, "iban": _iban, "phone": _phone, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card}


def pseudonym_sql(match: str, key: str) -> str:
    """SQL for struct<kind, value> of a match; kind is null and value the match itself where none is valid."""
    cases = []
    for kind, make in MAKERS.items():
        valid, value = make(match, key)
        whole = _quote("^(?:" + PATTERNS[kind] + ")$")
        cases.append(f"WHEN {match} RLIKE {whole} AND {valid} THEN named_struct('kind', '{kind}', 'value', {value})")
    return f"CASE {' '.join(cases)} ELSE named_struct('kind', cast(null AS string), 'value', {match}) END"


def derived_key(key: str) -> str:
    """The key of the rounds, from which the secret cannot be told."""
    return hmac.new(key.encode(), b"feistel rounds", hashlib.sha256).hexdigest()


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with pseudonyms, found (a map from kind to how many were replaced).

    ``key`` is the secret of the permutation; equal values get equal pseudonyms wherever the key is the same. Plans and
    event logs hold a key derived from it, not the secret. A null text stays null with an empty map; an empty one
    stays empty. A very long text is read whole. Repeated rows and rows with equal or null ids are rewritten one by
    one, and alike. Other columns are ignored. No rows give no rows. No shuffle: rows are independent.
    """
    secret = "'" + derived_key(key) + "'"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # every kind needs a digit or an @: most texts have neither and skip the costly pattern
    some = F.col("text").rlike("[0-9@]")
    hits = F.when(some, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("hits", hits)
    rows = rows.withColumn("new", F.expr(f"transform(hits, m -> {pseudonym_sql('m', secret)})"))
    pieces = F.split("text", ANY, -1)
    n = F.size("hits")
    front = F.zip_with(F.slice(pieces, 1, n), "new", lambda p, r: F.concat(p, r["value"]))
    text = F.when(n > 0, F.concat(F.array_join(front, ""), F.element_at(pieces, -1))).otherwise(F.col("text"))
    kinds = F.array(*[F.lit(k) for k in MAKERS])
    counts = F.transform(kinds, lambda k: F.size(F.filter("new", lambda r: r["kind"].eqNullSafe(k))))
    found = F.map_filter(F.map_from_arrays(kinds, counts), lambda _, v: v > 0)
    return rows.select("doc_id", text.alias("text"), found.alias("found"))
