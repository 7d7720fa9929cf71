"""PII: format-preserving Feistel pseudonyms, by DataFrame functions only.

Card numbers (Luhn), North American phone numbers, US social security numbers, IPv4 addresses, calendar dates and the
local parts of e-mail addresses are found and validated; each valid value is replaced by its image under a keyed
permutation of the values of its format. Equal values have equal images in all documents, and images are valid too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9(])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
ANY = "|".join((EMAIL, IPV4, DATE, SSN, PHONE, CARD))
#: Dates of the permutation: so many days from this one on.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 292, 250


def _prf(key: str, *of: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), *(x.cast("string") for x in of)), 256)
    return F.conv(F.substr(digest, F.lit(1), F.lit(12)), 16, 10).cast("bigint")


def feistel(key: str, tag: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A keyed permutation of the pairs below (left_size, right_size): each round adds to one half a keyed function of the other."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def one(acc: Column, k: Column) -> Column:
        return F.when(k % 2 == 0, F.struct(((acc.l + _prf(key, tag, k, acc.r)) % left_size).alias("l"), acc.r.alias("r"))).otherwise(F.struct(acc.l.alias("l"), ((acc.r + _prf(key, tag, k, acc.l)) % right_size).alias("r")))

    return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), start, one)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced one by one."""
    done = F.aggregate(
        F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a.out, F.substr(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a.out, c).alias("out"), a["at"].alias("at"))),
    )
    return done.out


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; from the right, digits at places of parity ``doubled`` count twice."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _card(h: Column, key: str) -> Column:
    d = _digits(h)
    body, n = F.substr(d, F.lit(1), F.length(d) - 1), F.length(d) - 1
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")
    x = feistel(key, F.concat(F.lit("card"), n.cast("string")), F.substr(body, F.lit(1), a), F.substr(body, a + 1, n - a), ten(a), ten(n - a))
    new = F.concat(F.lpad(x.l.cast("string"), a, F.lit("0")), F.lpad(x.r.cast("string"), n - a, F.lit("0")))
    check = ((10 - _luhn_sum(new, 0) % 10) % 10).cast("string")
    return _refill(h, F.concat(new, check))


def card(h: Column, key: str) -> Column:
    """The longest part of ``h`` between separators (the first of these) that is a card number is replaced; null if there is none."""
    parts = F.regexp_extract_all(h, F.lit("[0-9]+|[ -]"), F.lit(0))

    def cut_at(i: Column, j: Column) -> Column:
        own = F.array_join(F.slice(parts, i, j - i + 1), "")
        return F.struct(F.length(_digits(own)).alias("n"), (-i).alias("first"), own.alias("own"), F.array_join(F.slice(parts, 1, i - 1), "").alias("before"), F.array_join(F.slice(parts, j + 1, F.size(parts)), "").alias("after"))

    odd = lambda first: F.sequence(first, F.size(parts), F.lit(2))  # noqa: E731  digits and separators take turns
    cuts = F.flatten(F.transform(odd(F.lit(1)), lambda i: F.transform(odd(i), lambda j: cut_at(i, j))))
    valid = F.filter(cuts, lambda c: c.n.between(13, 19) & (_luhn_sum(_digits(c.own), 1) % 10 == 0))
    # One element or none: the image is of a bound value, not of this whole expression.
    best = F.transform(F.slice(F.reverse(F.array_sort(valid)), 1, 1), lambda c: F.concat(c.before, _card(c.own, key), c.after))
    return F.get(best, 0)


def phone(h: Column, key: str) -> Column:
    d = F.substr(_digits(h), F.length(_digits(h)) - 9, F.lit(10))
    part = lambda at, n: F.substr(d, F.lit(at), F.lit(n)).cast("bigint")
    x = feistel(key, F.lit("phone"), part(1, 6), part(7, 4), F.lit(1_000_000), F.lit(10_000))
    new = F.concat(F.lpad(x.l.cast("string"), 6, "0"), F.lpad(x.r.cast("string"), 4, "0"))
    return _refill(h, F.when(F.length(_digits(h)) == 11, F.concat(F.lit("1"), new)).otherwise(new))


def ssn(h: Column, key: str) -> Column:
    part = lambda k: F.element_at(F.split(h, "-"), k).cast("bigint")
    valid = (part(1) > 0) & (part(1) < 900) & (part(1) != 666) & (part(2) > 0) & (part(3) > 0)
    x = feistel(key, F.lit("ssn"), part(1) - 1 - (part(1) > 666).cast("bigint"), (part(2) - 1) * 9999 + part(3) - 1, F.lit(898), F.lit(99 * 9999))
    area = x.l + 1 + (x.l >= 665).cast("bigint")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(area, 3), pad(F.floor(x.r / 9999) + 1, 2), pad(x.r % 9999 + 1, 4)))


def ipv4(h: Column, key: str) -> Column:
    part = lambda k: F.element_at(F.split(h, r"\."), k).cast("bigint")
    valid = (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256)
    x = feistel(key, F.lit("ipv4"), part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536))
    return F.when(valid, F.concat_ws(".", *(v.cast("string") for v in (F.floor(x.l / 256), x.l % 256, F.floor(x.r / 256), x.r % 256))))


def date(h: Column, key: str) -> Column:
    iso = F.coalesce(F.try_to_timestamp(h, F.lit("yyyy-MM-dd")), F.try_to_timestamp(h, F.lit("dd/MM/yyyy"))).cast("date")
    day = F.date_diff(iso, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    x = feistel(key, F.lit("date"), F.floor(day / DAYS_LOW), day % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (x.l * DAYS_LOW + x.r).cast("int"))
    return F.when((day >= 0) & (day < DAYS_HIGH * DAYS_LOW), F.when(h.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd")))


def email(h: Column, key: str) -> Column:
    local, domain = F.substring_index(h, "@", 1), F.substr(h, F.instr(h, "@"))
    n = F.ceil(F.length(local) / 2).cast("int")

    def moved(own: Column, other: Column, k: Column) -> Column:
        def shift(c: Column, i: Column) -> Column:
            add, code = _prf(key, F.lit("email"), k, i, other), F.ascii(c)
            turn = lambda first, size: F.char(F.lit(first) + (code - first + add) % size)
            return F.when(code.between(48, 57), turn(48, 10)).when(code.between(65, 90), turn(65, 26)).when(code.between(97, 122), turn(97, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(own, ""), shift), "")

    def one(a: Column, k: Column) -> Column:
        return F.when(k % 2 == 0, F.struct(moved(a.l, a.r, k).alias("l"), a.r.alias("r"))).otherwise(F.struct(a.l.alias("l"), moved(a.r, a.l, k).alias("r")))

    x = F.aggregate(F.array(*(F.lit(k) for k in range(4))), F.struct(F.substr(local, F.lit(1), n).alias("l"), F.substr(local, n + 1).alias("r")), one)
    return F.concat(x.l, x.r, domain)


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and ``n_values`` (valid values found); all other columns stay.

    Null texts stay null with zero values; empty texts stay empty. What only looks like a value (a wrong check digit, an
    octet above 255, a day that does not exist or lies outside 1900 to 2099) is left alone. Ids play no part, so repeated
    rows stay equal; an empty table stays empty. Who has ``key`` can reverse the pseudonyms. A column of ``docs`` named
    ``n_values`` stays, and the new one's name ends in an underscore. A text of any length is worked off whole.
    """

    def image(h: Column) -> Column:
        kinds = ((EMAIL, email), (IPV4, ipv4), (DATE, date), (SSN, ssn), (PHONE, phone), (CARD, card))
        out = F.lit(None).cast("string")
        for pattern, f in reversed(kinds):
            out = F.when(h.rlike(f"^(?:{pattern})$"), f(h, key)).otherwise(out)
        return out

    hits, new, values = fresh(docs, "hits", "new", "n_values")
    text = F.col("text").cast("string")
    found = docs.withColumn(hits, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn(new, F.when(F.size(hits) > 0, F.transform(hits, image)))
    parts = F.zip_with(F.split(text, ANY, -1), F.zip_with(hits, new, lambda h, n: F.coalesce(n, h)), lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    whole = F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(text)
    return found.withColumns({"text": whole, values: F.greatest(F.coalesce(F.size(F.filter(new, lambda x: x.isNotNull())), F.lit(0)), F.lit(0)).cast("bigint")}).drop(hits, new)
