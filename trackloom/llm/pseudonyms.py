"""Format-preserving pseudonyms for personal data, in DataFrame operations alone.

One pattern finds e-mail addresses, IBANs, IPv4 addresses, dates, social security numbers, card numbers and phone numbers
in a text. What its kind's own rule proves valid (check digits, calendar, ranges) is replaced by a keyed permutation of
its value within its format: a Feistel network whose halves are numbers of the format's own ranges, so no value leaves
the format and no two values meet. Separators, layout and case stay. The permutation hangs on key, kind and value alone,
so a value has the same pseudonym in every document, however its digits are set apart, and who has the key can turn it
back. A phone number's value is what follows its country code, which is known by its first digits, so +1 366 555 9801,
+13665559801 and (366) 555-9801 stay linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

ROUNDS = 10
#: Days of the 400 years from 1700 on, the Gregorian cycle: 189 * 773 of them, the two ranges of the dates' network.
FIRST_DAY, DAY_RANGES = "1700-01-01", (189, 773)
#: Valid social security numbers: areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999.
SSN_RANGES = (898 * 99, 9999)

#: Country codes of two digits; 1 and 7 have one digit, all others three.
COUNTRY_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}|\d{4}([ -])\d{6}\4\d{5})(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once."""
    return F.transform(F.array(x), use)[0]


def feistel(a: Column, b: Column, a_range: Column, b_range: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < a_range and 0 <= b < b_range, as struct(a, b)."""

    def noise(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["a"] + noise(i, s["b"]), a_range).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), F.pmod(s["b"] + noise(i, s["a"]), b_range).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """Another string of as many digits; of 2 to 36 digits, one digit stays as it is."""

    def halves(s: Column) -> Column:
        left, n = F.floor(F.length(s) / 2).cast("int"), F.length(s)
        a, b = F.substring(s, F.lit(1), left).cast("long"), F.substring(s, left + 1, n - left).cast("long")
        ranges = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
        got = feistel(a, b, *ranges, key, F.concat(F.lit(kind), n.cast("string")))
        return _let(got, lambda r: F.concat(_padded(r["a"], left), _padded(r["b"], n - left)))

    return F.when(F.length(d) < 2, d).otherwise(_let(d, halves))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _laid_out(m: Column, new: Column) -> Column:
    """new's characters in the places of m's digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(m, ""), start, put)["out"]


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""
    places = F.split(F.reverse(d), "")
    value = F.transform(places, lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v)


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _let(whole, lambda w: _laid_out(m, w))).otherwise(m)

    return _let(_digits(m), valid)


def _iban_rest(body: Column, head: Column) -> Column:
    """The number that an IBAN spells, modulo 97."""
    letters = F.split(F.concat(body, head), "")
    return F.aggregate(letters, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    def valid(s: Column) -> Column:
        body, head = F.substring(s, F.lit(5), F.length(s) - 4), F.substring(s, 1, 4)
        new = _let(permute_digits(_digits(body), key, "iban"), lambda d: _laid_out(body, d))
        check = _let(new, lambda b: F.concat(_padded(98 - _iban_rest(b, F.concat(F.substring(s, 1, 2), F.lit("00"))), F.lit(2)), _digits(b)))
        return F.when(F.length(s).between(15, 34) & (_iban_rest(body, head) == 1), _let(check, lambda c: _laid_out(m, c))).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), valid)


def _ip(m: Column, key: str) -> Column:
    def turn(o: Column) -> Column:
        a, b = o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long")
        got = feistel(a, b, F.lit(65536), F.lit(65536), key, F.lit("ip"))
        return _let(got, lambda r: F.concat_ws(".", *(x.cast("string") for y in ("a", "b") for x in (F.floor(r[y] / 256), r[y] % 256))))

    return _let(F.split(m, r"\."), turn)


def _date(m: Column, key: str) -> Column:
    def turn(p: Column) -> Column:
        first = F.length(p[0]) == 4
        day_last = F.concat_ws("-", p[0], _padded(p[1], F.lit(2)), _padded(p[2], F.lit(2)))
        day_first = F.concat_ws("-", p[2], _padded(p[1], F.lit(2)), _padded(p[0], F.lit(2)))
        month_first = F.concat_ws("-", p[2], _padded(p[0], F.lit(2)), _padded(p[1], F.lit(2)))
        by_day, by_month = F.try_to_date(day_first, "yyyy-MM-dd"), F.try_to_date(month_first, "yyyy-MM-dd")
        read = F.struct(F.when(first, F.try_to_date(day_last, "yyyy-MM-dd")).otherwise(F.coalesce(by_day, by_month)).alias("day"), (~first & by_day.isNull()).alias("us"))

        def moved(r: Column) -> Column:
            at = F.datediff(r["day"], F.to_date(F.lit(FIRST_DAY))).cast("long")
            got = feistel(F.floor(at / DAY_RANGES[1]), at % DAY_RANGES[1], F.lit(DAY_RANGES[0]), F.lit(DAY_RANGES[1]), key, F.lit("date"))
            new = _let(got, lambda g: F.date_add(F.to_date(F.lit(FIRST_DAY)), (g["a"] * DAY_RANGES[1] + g["b"]).cast("int")))
            mark = F.substring(F.regexp_replace(m, r"\d", ""), 1, 1)
            short = (F.length(p[1]) == 1) | (F.length(F.when(first, p[2]).otherwise(p[0])) == 1)

            def written(d: Column) -> Column:
                wide = F.when(short, F.lit(1)).otherwise(2)
                part = {k: _let(f(d).cast("string"), lambda x: F.lpad(x, F.greatest(F.length(x), wide), F.lit("0"))) for k, f in (("d", F.dayofmonth), ("m", F.month))}
                year = F.year(d).cast("string")
                return F.when(first, F.concat_ws("-", year, part["m"], part["d"])).when(r["us"], F.concat_ws("-", part["m"], part["d"], year)).otherwise(F.concat_ws("-", part["d"], part["m"], year)).alias("x")

            inside = r["day"].isNotNull() & at.between(0, DAY_RANGES[0] * DAY_RANGES[1] - 1)
            return F.when(inside, _let(new, lambda d: F.replace(written(d), F.lit("-"), mark))).otherwise(m)

        return _let(read, moved)

    return _let(F.split(m, "[-/.]"), turn)


def _ssn(m: Column, key: str) -> Column:
    def turn(p: Column) -> Column:
        area, group, serial = (p[i].cast("long") for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        rank = area - 1 - (area > 666).cast("long")
        got = feistel(rank * 99 + group - 1, serial - 1, F.lit(SSN_RANGES[0]), F.lit(SSN_RANGES[1]), key, F.lit("ssn"))

        def written(g: Column) -> Column:
            rank = F.floor(g["a"] / 99)
            return F.concat_ws("-", _padded(rank + 1 + (rank >= 665).cast("long"), F.lit(3)), _padded(g["a"] % 99 + 1, F.lit(2)), _padded(g["b"] + 1, F.lit(4)))

        return F.when(valid, _let(got, written)).otherwise(m)

    return _let(F.split(m, "-"), turn)


def _phone(m: Column, key: str) -> Column:
    """All digits behind a country code; of numbers of 7 to 15 digits."""
    digits = _digits(m)
    long = F.when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(*COUNTRY_CODES), 2).otherwise(3)
    code = F.when(m.startswith("+"), long).otherwise(0)

    def turn(s: Column) -> Column:
        rest = F.substring(s["d"], s["c"] + 1, F.length(s["d"]))
        return F.when(F.length(s["d"]).between(7, 15), _let(F.concat(F.substring(s["d"], F.lit(1), s["c"]), permute_digits(rest, key, "phone")), lambda n: _laid_out(m, n))).otherwise(m)

    return _let(F.struct(digits.alias("d"), code.alias("c")), turn)


def _email(m: Column, key: str) -> Column:
    """The local part's letters and digits, each run permuted in its own alphabet; case by place, domain as it is."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    shift = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.concat_ws("@", F.regexp_replace(F.lower(local), "[a-z0-9]", "?"), F.lower(domain))), 256)
    low = F.lower(local)
    chars = F.filter(F.split(low, ""), lambda c: c.rlike("[a-z0-9]"))
    value = F.transform(chars, lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 97))
    radix = F.transform(chars, lambda c: F.when(c.between("0", "9"), 10).otherwise(26))

    def rounds(s: Column) -> Column:
        """A Feistel network over the two halves of the characters, each character added to in its own radix."""
        n = F.size(s["v"])
        cut_at = F.floor(n / 2).cast("int")

        def turn(v: Column, i: Column) -> Column:
            other = F.when(i % 2 == 0, F.slice(v, cut_at + 1, n - cut_at)).otherwise(F.slice(v, F.lit(1), cut_at))
            noise = F.sha2(F.concat_ws("|", s["k"], i.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 512)

            def moved(h: Column) -> Column:
                def add(x: Column, j: Column) -> Column:
                    mine = F.when(i % 2 == 0, j < cut_at).otherwise(j >= cut_at)
                    step = F.conv(F.substring(F.sha2(F.concat_ws("|", h, j.cast("string")), 256), 1, 8), 16, 10).cast("long")
                    return F.when(mine, F.pmod(x + step, F.element_at(s["r"], j + 1)).cast("int")).otherwise(x)

                return F.transform(v, add)

            return _let(noise, moved)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s["v"], turn)

    new = _let(F.struct(value.alias("v"), radix.alias("r"), shift.alias("k")), rounds)

    def written(v: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def put(s: Column, c: Column) -> Column:
            digit, letter = c.rlike("[0-9]"), c.rlike("[A-Za-z]")
            got = F.try_element_at(v, s["at"])
            char = F.when(digit, got.cast("string")).when(c.rlike("[A-Z]"), F.char(got + 65)).when(letter, F.char(got + 97)).otherwise(c)
            return F.struct(F.concat(s["out"], char).alias("out"), (s["at"] + (digit | letter).cast("int")).alias("at"))

        return F.aggregate(F.split(local, ""), start, put)["out"]

    return F.concat(_let(new, written), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY; a match that its kind's rule refuses stays."""
    full = {k: m.rlike(rf"^(?:{p})$".replace(r"\3", r"\1").replace(r"\4", r"\2")) for k, p in PATTERNS.items()}
    turns = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    out = None
    for kind, turn in turns.items():
        out = F.when(full[kind], turn(m, key)) if out is None else out.when(full[kind], turn(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, count: str = "n_private") -> DataFrame:
    """docs, all columns, with pseudonyms in text, and a column of that name for how many values were replaced.

    A null text stays null and counts 0. Everything outside the matches stays byte for byte. Where docs has a column of
    that name already, underscores go before the new one's.
    """
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    old, new = fresh(docs, "_found"), fresh(docs, "_new")
    rows = docs.withColumn(old, found).withColumn(new, F.transform(old, lambda m: pseudonym(m, key)))
    parts = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.aggregate(F.arrays_zip(F.col(old).alias("was"), F.col(new).alias("now")), F.lit(0).cast("long"), lambda a, z: a + (z["was"] != z["now"]).cast("long"))
    rows = rows.withColumn(fresh(docs, count), F.coalesce(n, F.lit(0).cast("long")))
    rows = rows.withColumn("text", F.when(F.size(old) > 0, joined).otherwise(F.col("text")))
    return rows.drop(old, new)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="a key of the caller's own")
