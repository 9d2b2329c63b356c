"""Pseudonyms of every kind against a plain version, and texts that are hard on patterns."""

from __future__ import annotations

import datetime
import hashlib
import random
import re

import pytest

from veilframe.llm import pii

KEY = "a test's key"
HEX, HEX_CAPITAL = "0123456789abcdef", "0123456789ABCDEF"
MIXED = (pii.DIGITS, pii.SMALL, pii.CAPITAL)


def amount(kind, step, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{step}|{half}".encode()).hexdigest()[:15], 16)


def plain_string(kind, value, alphabets):
    def moved(step, half, other):
        other = hashlib.sha256(other.encode()).hexdigest() if len(other) > pii.LONG_HALF else other
        out = ""
        for i, c in enumerate(half):
            letters = next((x for x in alphabets if c in x), None)
            out += c if letters is None else letters[(letters.index(c) + amount(kind, step, f"{i}|{other}")) % len(letters)]
        return out

    middle = -(-len(value) // 2)
    a, b = value[:middle], value[middle:]
    for step in range(pii.ROUNDS):
        a, b = (a, moved(step, b, a)) if step % 2 else (moved(step, a, b), b)
    return a + b


def plain_pair(kind, a, b, n_a, n_b):
    for step in range(pii.ROUNDS):
        a, b = (a, (b + amount(kind, step, a)) % n_b) if step % 2 else ((a + amount(kind, step, b)) % n_a, b)
    return a, b


def walk(value, permute, kind_of):
    new = permute(value)
    while kind_of(new) != kind_of(value):
        new = permute(new)
    return new


def fill(form, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in form)


def only(text):
    return re.sub("[^0-9]", "", text)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def unicast(ip):
    first = int(ip.split(".")[0])
    return 1 <= first < 224 and first != 127


def dialled(number):
    d = only(number)
    return d[:-10] != "1" or (d[-10] in "23456789" and d[-7] in "23456789")


def assignable(ssn):
    d = only(ssn)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def plain_ip(ip):
    def permute(v):
        p = list(map(int, v.split(".")))
        a, b = plain_pair("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"

    return walk(ip, permute, unicast)


def plain_date(day):
    n = (datetime.date.fromisoformat(day) - datetime.date(1900, 1, 1)).days
    a, b = plain_pair("date", n // 4297, n % 4297, 17, 4297)
    return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).isoformat()


def plain_phone(number):
    country = only(number)[:-10]
    new = walk(only(number)[-10:], lambda v: plain_string("phone", v, (pii.DIGITS,)), lambda v: dialled(country + v))
    return fill(number, country + new)


def plain_ssn(ssn):
    return fill(ssn, walk(only(ssn), lambda v: plain_string("ssn", v, (pii.DIGITS,)), assignable))


def plain_card(card):
    d = only(card)
    body = d[:4] + plain_string("card", d[4:-1], (pii.DIGITS,))
    return fill(card, body + next(c for c in "0123456789" if luhn(body + c)))


def plain_email(email):
    local, _, domain = email.partition("@")
    marks = re.match(r"[._%+-]*", local)[0]
    return marks + plain_string("email", local[len(marks) :], (*MIXED, pii.SMALL_MARKED, pii.CAPITAL_MARKED)) + "@" + domain


def plain_secret(text):
    head, body = re.fullmatch(r"(.*= |A[KS]IA|gh[oprsu]_)(\w+)", text).groups()
    alphabets = (HEX,) if re.fullmatch("[0-9a-f]+", body) and "=" in head else (HEX_CAPITAL,) if "=" in head else MIXED
    return head + plain_string("secret", body, alphabets)


def values(kind, made, n):
    digits = lambda k: "".join(made.choice("0123456789") for _ in range(k))
    while n:
        n -= 1
        if kind == "email":
            yield made.choice(["", "", "_", "-."]) + "".join(made.choice("abcXYZ019._éÖ") for _ in range(made.randrange(1, 90))).strip("._") + f"q{n}@m.example.co"
        elif kind == "secret":
            yield made.choice([f"key = {made.getrandbits(160):040x}", f"token = {made.getrandbits(300):075X}", f"AKIA{made.getrandbits(64):016X}", "ghp_" + "".join(made.choice("abcXYZ019") for _ in range(36))])
        elif kind == "ip":
            yield ".".join(str(made.randrange(256)) for _ in range(4))
        elif kind == "date":
            yield (datetime.date(1900, 1, 1) + datetime.timedelta(made.randrange(73_049))).isoformat()
        elif kind == "phone":
            yield made.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+49 {digits(3)} {digits(3)} {digits(4)}"])
        elif kind == "ssn":
            yield f"{digits(3)}-{digits(2)}-{digits(4)}"
        else:
            body = "4" + digits(14)
            yield body + next(c for c in "0123456789" if luhn(body + c))


VALID = {
    "email": lambda v: re.fullmatch(r"[\w.%+-]+@m\.example\.co", v),
    "secret": lambda v: True,
    "ip": lambda v: all(0 <= int(x) < 256 for x in v.split(".")),
    "date": lambda v: datetime.date.fromisoformat(v).year in range(1900, 2100),
    "phone": lambda v: True,
    "ssn": assignable,
    "card": luhn,
}
CLASS = {"ip": unicast, "phone": dialled}
PLAIN = {"email": plain_email, "secret": plain_secret, "ip": plain_ip, "date": plain_date, "phone": plain_phone, "ssn": plain_ssn, "card": plain_card}


@pytest.mark.parametrize("kind", sorted(PLAIN))
def test_ten_thousand_values(spark, kind):
    given = sorted(set(values(kind, random.Random(kind), 10_000)))
    frame = spark.createDataFrame([(v,) for v in given], "text string").repartition(4)
    got = {}
    for r in pii.pseudonymise(frame.withColumn("was", frame["text"]), KEY).collect():
        got[r.was] = r.text
        assert r[f"n_{kind}"] == (kind != "ssn" or assignable(r.was))
    made = {v: new for v, new in got.items() if kind != "ssn" or assignable(v)}
    assert all(new == v for v, new in got.items() if v not in made)
    assert len(set(made.values())) == len(made) > 8_000
    assert all(VALID[kind](new) and (kind not in CLASS or CLASS[kind](v) == CLASS[kind](new)) for v, new in made.items())
    for v in random.Random(1).sample(sorted(made), 1_500):
        assert made[v] == PLAIN[kind](v), v


def test_long_texts(spark):
    big = 1 << 20
    texts = ["a@" + "b." * 3000 + "com", "b." * (big // 2), "1" * big, "x" * big, " " * big, "@" * big, "a@" * (big // 2), "key =   " * (big // 8), "1." * (big // 2), "gh" * (big // 2), "token" * (big // 5)]
    got = pii.pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), KEY).collect()
    for r in got:
        assert len(r.text) == len(texts[r.i]) and sum(r[f"n_{k}"] for k in pii.KINDS) == (r.i == 0)
        assert (r.text == texts[r.i]) == (r.i > 0)


def test_nothing_is_left_behind(spark):
    local, digits = "verylong" * 9 + "1", "0f" * 36
    text = f'to {local}@x.com; token = "{digits}", key=   {digits.upper()}, +1 217 555 0123abc@x.com, u@10.2.3.4 and a@x.com.'
    new = pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), KEY).first()
    assert "verylong" not in new.text and "0f0f" not in new.text and "0F0F" not in new.text and "abc@" not in new.text and "10.2.3.4" not in new.text
    assert [new[f"n_{k}"] for k in pii.KINDS] == [3, 2, 1, 0, 1, 0, 0] and new.text.endswith("@x.com.")
    assert local not in new.text and f"{plain_email(local + '@x.com')};" in new.text


def test_own_counts_are_refused(spark):
    with pytest.raises(ValueError, match="n_ip"):
        pii.pseudonymise(spark.createDataFrame([("x", 1)], "text string, N_IP int"), KEY)
