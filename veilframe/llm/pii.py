"""Format-preserving pseudonyms for personal data.

Validated values are replaced by keyed permutations of their own format, so
that equal values stay equal across documents and nothing needs a table:

* card: 13 to 19 digits, optionally in groups, with an issuer's first digits
  and a right Luhn digit; the issuer's four digits stay, the account's are
  permuted, the Luhn digit is computed anew.
* date: a real calendar day from 1900 to 2099, as 2024-05-31, 2024/05/31,
  31.05.2024 or 31/05/2024; the days of that span are permuted.
* ip: an IPv4 address with four numbers up to 255; the 32 bits are permuted,
  unicast addresses (first number 1 to 223, but not 127) among themselves and
  the others among themselves.
* phone: +, a country code, and ten digits with a bracketed area code or in
  groups; the ten digits are permuted. Under country code 1, numbers whose area
  and exchange begin with 2 to 9 stay such numbers, and others stay others.
* ssn: three, two and four digits with dashes, with an area, group and serial
  that can be assigned; the nine digits are permuted among those values.
* email: the letters and digits of the local part are permuted within their
  own class (small and capital letters, with and without Latin-1's marks,
  digits); marks before its first letter or digit and the domain stay.
* secret: 32 or more hexadecimal digits of one case after a name like token,
  key, secret or password, whose digits are permuted; and access keys that begin
  with AKIA or ASIA, or with ghp_ and its like, whose other characters are permuted within their class.
  Keys of other forms are not looked for.

A permutation is an alternating Feistel network: one half is shifted by a
SHA-256 of the key, the kind, the round and the other half. Where not every
value of a format is valid, the permutation is applied until it gives a value
of the same class (cycle walking, which permutes each class). Values that fail
validation stay as they are.

No pattern repeats a group that can be left again, and each starts only where
a run of its characters starts, so a long text takes time in proportion and no
stack.

Defined results: a null text stays null with no findings; an empty one is
unchanged; equal rows get equal results; an empty table gives an empty one.
Other columns pass through, but for own columns called ``n_<kind>``, which are
refused. Matches never overlap: the text is scanned once,
from the left, with the kinds in the order of ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.quality_rules import let

ROUNDS = 8
#: 73,049 days from 1900-01-01 to 2099-12-31 are 17 times 4,297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297

#: Fixed values, one pattern a kind: what may not stand before a value, and the value. Later kinds don't match inside earlier ones' matches.
_LOCAL = r"\p{L}\p{N}._%+-"
KINDS = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)", rf"[._%+-]*+[\p{{L}}\p{{N}}][{_LOCAL}]*+@[A-Za-z0-9-]++(?:\.(?![A-Za-z]{{2}})[A-Za-z0-9-]++)*+\.[A-Za-z]{{2}}[A-Za-z0-9-]*+"),
    "secret": (
        "",
        r"(?:(?i:token|secret|password|passwd|api_?key|key)[\"']?\s*+[=:]\s*+[\"']?(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)"
        r"|(?<![0-9A-Za-z])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36,}+))(?![0-9A-Za-z])",
    ),
    "ip": (r"(?<![0-9.])", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    "date": (r"(?<![0-9])", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"),
    "phone": ("", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    "ssn": (r"(?<![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "card": (r"(?<![0-9])", r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
}
ANY = "|".join(f"(?:{before}{value})" for before, value in KINDS.values())
#: Every match holds one of these forms; most texts skip the scan.
HINT = r"@[A-Za-z0-9-]|[0-9]{13}|[0-9]{4}[ -][0-9]{4}|[0-9]\.[0-9]{1,3}\.[0-9]|[0-9]{4}[/-][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}|\+[0-9]|[0-9]{3}-[0-9]{2}-[0-9]|[0-9a-f]{32}|[0-9A-F]{32}|A[KS]IA[0-9A-Z]{16}|gh[oprsu]_"
#: Halves over so many characters count by their SHA-256; steps of a cycle walk at most (a class has at least an eighth of the values, so fewer than one walk in 10^11 is that long).
LONG_HALF, WALK = 64, 200


def _stream(key: Column, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), step.cast("string"), half), 256)


def _number(key: Column, kind: str, step: Column, half: Column) -> Column:
    """60 bits of the round function."""
    return F.conv(F.substring(_stream(key, kind, step, half), 1, 15), 16, 10).cast("long")


def _rounds(pair: Column, move) -> Column:
    """ROUNDS steps on struct(a, b): move(step, half, other, is_a) is the half's new value, a's at even steps."""

    def one(p: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(F.when(even, move(step, p["a"], p["b"], True)).otherwise(p["a"]).alias("a"), F.when(even, p["b"]).otherwise(move(step, p["b"], p["a"], False)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, one)


def permute_pair(key: Column, kind: str, a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """struct(a, b) of a permutation of the pairs with a < n_a and b < n_b."""

    def move(step: Column, half: Column, other: Column, is_a: bool) -> Column:
        return (half + _number(key, kind, step, other.cast("string"))) % (n_a if is_a else n_b)

    return _rounds(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), move)


def permute_string(key: Column, kind: str, value: Column, alphabets: tuple[str, ...]) -> Column:
    """A string with each character permuted inside its alphabet, other characters kept in place.

    The halves alternate; each character of one is shifted by a hash of the
    other half (of its SHA-256, if it is long) and of its own place.
    """

    def move(step: Column, half: Column, other: Column, is_a: bool) -> Column:
        return let(F.when(F.char_length(other) > LONG_HALF, F.sha2(other, 256)).otherwise(other), lambda x: shifted(step, half, x))

    def shifted(step: Column, half: Column, other: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            amount = _number(key, kind, step, F.concat_ws("|", i.cast("string"), other))
            out = c
            for letters in reversed(alphabets):
                at = F.instr(F.lit(letters), c)
                moved = F.substring(F.lit(letters), ((at - 1 + amount % len(letters)) % len(letters) + 1).cast("int"), F.lit(1))
                out = F.when(at > 0, moved).otherwise(out)
            return out

        chars = F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ""))
        return F.array_join(F.transform(chars, one), "")

    middle = F.ceil(F.char_length(value) / 2).cast("int")
    pair = F.struct(F.substring(value, F.lit(1), middle).alias("a"), F.substring(value, middle + 1, F.char_length(value)).alias("b"))
    return let(_rounds(pair, move), lambda p: F.concat(p["a"], p["b"]))


def walked(value: Column, permute, kind_of) -> Column:
    """permute(value), again and again until kind_of is what it is of value."""
    state = F.struct(permute(value).alias("v"), kind_of(value).alias("k"))

    def step(s: Column, _: Column) -> Column:
        return F.when(kind_of(s["v"]) == s["k"], s).otherwise(F.struct(permute(s["v"]).alias("v"), s["k"].alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), state, step, lambda s: s["v"])


DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL_MARKED, CAPITAL_MARKED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


def _luhn_sum(digits: Column, last_doubled: int) -> Column:
    """Luhn sum of a digit string; last_doubled 1 if its last digit counts twice."""
    chars = F.reverse(F.split(digits, ""))

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1 - last_doubled, twice).otherwise(d)

    return F.aggregate(F.transform(chars, one), F.lit(0), lambda total, x: total + x)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of a string of as many."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        nxt = F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], nxt).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), state, step, lambda s: s["out"])


def _card(key: Column, m: Column) -> Column:
    d = _digits(m)
    valid = d.rlike("^(?:[3-6]|22[2-9]|2[3-6]|27[01]|2720)") & (_luhn_sum(d, 0) % 10 == 0)

    def replaced(account: Column) -> Column:
        body = F.concat(F.substring(d, 1, 4), account)
        check = ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")
        return _fill(m, F.concat(body, check))

    account = permute_string(key, "card", F.substring(d, F.lit(5), F.char_length(d) - 5), (DIGITS,))
    return F.when(valid, let(account, replaced))


def _date(key: Column, m: Column) -> Column:
    year_first = m.rlike("^[0-9]{4}")
    mark = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    iso = F.when(year_first, F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))).otherwise(
        F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    )
    day = F.try_to_date(iso, "yyyy-MM-dd")
    first = F.lit(FIRST_DAY).cast("date")
    n = F.date_diff(day, first)

    def written(p: Column) -> Column:
        d = F.date_add(first, (p["a"] * DAYS_B + p["b"]).cast("int"))
        y, mo, dd = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
        return F.when(year_first, F.concat(y, mark, mo, mark, dd)).otherwise(F.concat(dd, mark, mo, mark, y))

    valid = day.isNotNull() & (n >= 0) & (n < DAYS_A * DAYS_B)
    return F.when(valid, let(permute_pair(key, "date", F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B), written))


def _ip(key: Column, m: Column) -> Column:
    parts = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    pair = let(parts, lambda p: F.struct((F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1))).cast("long").alias("a"), (F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3))).cast("long").alias("b")))
    unicast = lambda p: (p["a"] >= 256) & (p["a"] < 224 * 256) & (F.shiftright(p["a"], 8) != 127)
    new = let(pair, lambda p: walked(p, lambda v: permute_pair(key, "ip", v["a"], v["b"], 65536, 65536), unicast))
    text = let(new, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256)]))
    return F.when(F.forall(parts, lambda x: x < 256), text)


def _phone(key: Column, m: Column) -> Column:
    d = _digits(m)
    body = F.substring(d, F.char_length(d) - 9, F.lit(10))
    country = F.substring(d, F.lit(1), F.char_length(d) - 10)
    dialled = lambda v: (country != "1") | v.rlike("^[2-9]..[2-9]")
    return let(walked(body, lambda v: permute_string(key, "phone", v, (DIGITS,)), dialled), lambda x: _fill(m, F.concat(country, x)))


def _ssn(key: Column, m: Column) -> Column:
    assignable = lambda v: ~v.rlike("^(?:000|666|9)|^...00|0000$")
    d = _digits(m)
    return F.when(assignable(d), let(walked(d, lambda v: permute_string(key, "ssn", v, (DIGITS,)), assignable), lambda x: _fill(m, x)))


def _email(key: Column, m: Column) -> Column:
    marks = F.regexp_extract(m, r"^[._%+-]*", 0)
    rest = F.substring(m, F.char_length(marks) + 1, F.char_length(m))
    local = F.substring_index(rest, "@", 1)
    new = permute_string(key, "email", local, (DIGITS, SMALL, CAPITAL, SMALL_MARKED, CAPITAL_MARKED))
    return F.concat(marks, new, F.substring(rest, F.char_length(local) + 1, F.char_length(rest)))


def _secret(key: Column, m: Column) -> Column:
    of_its_own = r"^(?:A[KS]IA|gh[oprsu]_)"
    body = F.when(m.rlike(of_its_own), F.regexp_replace(m, of_its_own, "")).otherwise(F.regexp_extract(m, "([0-9a-f]{32,}+|[0-9A-F]{32,}+)$", 1))

    def replaced(x: Column) -> Column:
        letters = permute_string(key, "secret", x, (DIGITS, SMALL, CAPITAL))
        small = permute_string(key, "secret", x, ("0123456789abcdef",))
        large = permute_string(key, "secret", x, ("0123456789ABCDEF",))
        new = F.when(m.rlike(of_its_own), letters).when(x.rlike("[A-F]"), large).otherwise(small)
        return F.concat(F.substring(m, F.lit(1), F.char_length(m) - F.char_length(x)), new)

    return let(body, replaced)


_REPLACE = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _replaced(key: Column, m: Column) -> Column:
    """struct(kind, text) of a match; kind is null where the value is not valid."""
    same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))

    def valid(kind: str):
        return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("text"))).otherwise(same)

    out = same
    for kind, (_, pattern) in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), let(_REPLACE[kind](key, m), valid(kind))).otherwise(out)
    return out


def _of_kind(kind: str):
    return lambda n: n["kind"] == kind


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with personal data in text replaced, and n_<kind> counts of what was replaced.

    The key is a secret of the caller. It is joined as a one-row table, so that
    no plan shows it.
    """
    clashing = {c.lower() for c in docs.columns} & {f"n_{k}" for k in KINDS}
    if clashing:
        raise ValueError(f"columns of the result have these names: {', '.join(sorted(clashing))}")
    spark = docs.sparkSession
    secret = F.broadcast(spark.createDataFrame([(key,)], "__key string"))
    keyed = docs.crossJoin(secret)  # one row: a constant that the plan doesn't print
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(f"({ANY})"), F.lit(1)))
    new = F.transform(found, lambda m: _replaced(F.col("__key"), m))
    with_found = keyed.withColumn("__new", F.when(F.size(found) > 0, new))
    return _rebuilt(with_found, docs, text)


def _rebuilt(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    gaps = F.split(F.col(text), f"(?:{ANY})", -1)
    parts = F.zip_with(gaps, F.col("__new"), lambda gap, n: F.concat(gap, F.coalesce(n["text"], F.lit(""))))
    changed = F.when(F.col("__new").isNull(), F.col(text)).otherwise(F.array_join(parts, ""))
    counts = {f"n_{k}": F.coalesce(F.size(F.filter(F.col("__new"), _of_kind(k))), F.lit(0)) for k in KINDS}
    counts = {k: F.when(F.col("__new").isNull(), F.lit(0)).otherwise(v).cast("long") for k, v in counts.items()}
    return df.select(*[changed.alias(c) if c == text else F.col(c) for c in docs.columns], *[v.alias(k) for k, v in counts.items()])
