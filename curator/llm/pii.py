"""PII: format-preserving pseudonyms, in DataFrame expressions only.

Card and account numbers, phone numbers, IPv4 addresses and dates that pass their validation are permuted within their
format by a keyed Feistel network, so that equal values stay equal across documents and different ones different:

* numbers: the digits in two halves, each round adding a keyed hash of one half to the other, modulo its power of ten;
  what separates the digits stays. Cards keep a valid check digit, IBANs valid check digits, phone numbers their
  country code;
* IPv4 addresses: two halves of 16 bits;
* mail addresses: the letters of the name, and those of the host but for its top-level domain, as numbers of base 26, and
  the digits of each; case and punctuation stay where they are, so labels do;
* dates: the day within its 400 years of the calendar (189 * 773 days), so every result is a date; one that doesn't fit
  the spelling (month first, or one digit for day or month) is permuted again until it does.

Access keys and secrets get a keyed hash spelled in their own alphabet and length, which keeps equal values linked. The ``key`` is a secret of the caller.

Edge cases: a null text stays null; an empty one empty; values that fail validation stay (a 16-digit number with a
wrong check digit, 31 February, 300.1.1.1); repeated rows get equal results; an empty table gives an empty result;
other columns pass through; no internal columns are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

ROUNDS = 8

# Each pattern matches a whole value; what stands around it may not continue it.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?i:(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|token|passw(?:or)?d|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?=[A-Za-z+/_.~-]*\d)[A-Za-z0-9+/_.~-]{6,})"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?:(?=T\d\d)|(?![\w/-]|\.\d))"
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])\d(?:[ -]?\d){11,18}(?![\w]|-\d)"
ANY = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, DATE, IPV4, PHONE, SSN, CARD))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _keyed(key: str, kind: str, step: int, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a bigint."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(step)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, m: Column, n: Column, key: str, kind: str) -> Column:
    """A keyed permutation of pairs 0 <= left < m, 0 <= right < n; struct(l, r)."""
    state = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(step: int):
        def left_moves(s: Column) -> Column:
            return F.struct(F.pmod(s["l"] + F.pmod(_keyed(key, kind, step, s["r"], m, n), m), m).cast("bigint").alias("l"), s["r"].alias("r"))

        def right_moves(s: Column) -> Column:
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_keyed(key, kind, step, s["l"], m, n), n), n).cast("bigint").alias("r"))

        return right_moves if step % 2 else left_moves

    for step in range(ROUNDS):
        state = _let(state, turn(step))
    return state


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits (2 to 36 of them) permuted among those of equal length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    pair = feistel(F.left(digits, half).cast("bigint"), F.right(digits, rest).cast("bigint"), power(half), power(rest), key, kind)
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _respelled(value: Column, digits: Column) -> Column:
    """value with its digits replaced, one by one, by these."""
    chars = F.split(value, "")
    is_digit = lambda c: F.length(F.translate(c, "0123456789", "")) < F.length(c)
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(is_digit(c), F.struct(F.concat(a["text"], F.substr(digits, a["at"], F.lit(1))).alias("text"), (a["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at"))
    )
    return F.aggregate(chars, start, step, lambda a: a["text"])


#: Letters as digits of base 26, as conv() spells them.
_LETTERS, _BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: Letters of a piece that is permuted as one: both halves fit a bigint.
PIECE = 24


def permuted_letters(letters: Column, key: str, kind: str) -> Column:
    """Small letters permuted among those of equal length, in pieces of at most PIECE."""
    as_number = lambda t: F.when(t == "", 0).otherwise(F.conv(F.translate(t, _LETTERS, _BASE26), 26, 10)).cast("bigint")
    power = lambda k: F.conv(F.rpad(F.lit("1"), k + 1, "0"), 26, 10).cast("bigint")

    def spelled(number: Column, width: Column) -> Column:
        digits = F.translate(F.lower(F.conv(number.cast("string"), 10, 26)), _BASE26, _LETTERS)
        return F.when(width == 0, "").otherwise(F.lpad(digits, width, "a"))

    def moved(piece: Column) -> Column:
        half = F.ceil(F.length(piece) / 2).cast("int")
        rest = F.length(piece) - half
        pair = feistel(as_number(F.left(piece, half)), as_number(F.right(piece, rest)), power(half), power(rest), key, kind)
        return _let(pair, lambda p: F.concat(spelled(p["l"], half), spelled(p["r"], rest)))

    count = F.ceil(F.length(letters) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: moved(F.substr(letters, i * PIECE + 1, F.lit(PIECE))))
    return F.when(letters == "", letters).otherwise(F.array_join(pieces, ""))


def _put_back(value: Column, alphabet: str, moved: Column) -> Column:
    """value with its characters of this alphabet replaced, one by one, by these; capitals stay capitals."""
    chars = F.split(value, "")
    own = lambda c: c.rlike(f"(?i)^[{alphabet}]$")
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        new = F.substr(moved, a["at"], F.lit(1))
        new = F.when(c == F.lower(c), new).otherwise(F.upper(new))
        return F.when(own(c), F.struct(F.concat(a["text"], new).alias("text"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at")))

    return F.aggregate(chars, start, step, lambda a: a["text"])


def permuted_name(value: Column, key: str, kind: str) -> Column:
    """A name or host: its letters and its digits are permuted, each among their like."""
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    out = _put_back(value, "a-z", permuted_letters(letters, key, kind))
    digits = _digits(value)
    one = F.pmod(digits.try_cast("int") + F.pmod(_keyed(key, kind, -1), F.lit(10)), F.lit(10)).cast("string")
    moved = F.when(F.length(digits) == 1, one).when(F.length(digits).between(2, 36), permuted_digits(digits, key, kind)).otherwise(digits)
    return _put_back(out, "0-9", moved)


def _mail(value: Column, key: str) -> Column:
    host = F.substring_index(value, "@", -1)
    domain = F.substring_index(host, ".", -1)
    inner = F.left(host, F.length(host) - F.length(domain))
    return F.concat(permuted_name(F.substring_index(value, "@", 1), key, "mail"), F.lit("@"), permuted_name(inner, key, "host"), domain)


def _luhn_sum(digits: Column) -> Column:
    """The check sum of these digits, the last one counting once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def permuted_card(digits: Column, key: str) -> Column:
    body = permuted_digits(F.left(digits, F.length(digits) - 1), key, "card")
    return _let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))


def _card(value: Column, key: str) -> Column:
    """value with the card number in it permuted; None if it holds none.

    A run of digits may hold more than the number, such as an expiry or a count before or behind it. Any whole groups
    of it that have 12 to 19 digits and a valid check digit are one: a single group first, else the longest, the
    leftmost of equals.
    """

    def ranges(parts: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2))
        text = lambda lo, n: F.array_join(F.slice(parts, lo, n), "")
        one = lambda i, j: F.struct(
            (i != j).alias("several"), (-F.length(_digits(text(i + 1, j - i + 1)))).alias("n"), i.alias("i"),
            text(F.lit(1), i).alias("head"), text(i + 1, j - i + 1).alias("card"), text(j + 2, F.size(parts)).alias("tail"),
        )
        every = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j >= i), lambda j: one(i, j))))
        return F.sort_array(F.filter(every, lambda c: c["n"].between(-19, -12) & luhn_valid(_digits(c["card"]))))

    found = _let(F.regexp_extract_all(value, F.lit("[0-9]+|[ -]"), F.lit(0)), ranges)
    return _let(F.get(found, F.lit(0)), lambda c: F.concat(c["head"], _respelled(c["card"], permuted_card(_digits(c["card"]), key)), c["tail"]))


def permuted_ipv4(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    pair = _let(part, lambda p: feistel(F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), F.lit(65536), F.lit(65536), key, "ipv4"))
    octets = lambda x: [F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string")]
    return _let(pair, lambda p: F.concat_ws(".", *octets(p["l"]), *octets(p["r"])))


def permuted_day(day: Column, key: str) -> Column:
    """A date permuted within its 400 years, counted from 1600."""
    number = F.datediff(day, F.lit("1600-01-01").cast("date"))
    era, within = F.floor(number / 146097), F.pmod(number, F.lit(146097))
    pair = _let(within, lambda w: feistel(F.floor(w / 773), F.pmod(w, F.lit(773)), F.lit(189), F.lit(773), key, "date"))
    return _let(pair, lambda p: F.date_add(F.lit("1600-01-01").cast("date"), (era * 146097 + p["l"] * 773 + p["r"]).cast("int")))


#: Steps after which a walk among dates ends. Less than 10^-21 of the walks would need more, with one digit for day and month.
WALK = 200


def walked_day(day: Column, key: str, fits) -> Column:
    """A date that fits permuted among those that do: permuted_day again and again, until one fits (no two dates end at the same)."""
    start = F.struct(day.alias("day"), F.lit(False).alias("done"))
    step = lambda s: _let(permuted_day(s["day"], key), lambda d: F.struct(d.alias("day"), fits(d).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)), lambda s: s["day"])


def _ssn(value: Column, key: str) -> Column:
    """A social security number among such ones, a taxpayer's number of the same form (areas 900 to 999) among those; None if it can't be one: area 000 or 666, group 00 or serial number 0000."""

    def read(d: Column) -> Column:
        area, group, serial = F.left(d, F.lit(3)).cast("bigint"), F.substr(d, F.lit(4), F.lit(2)).cast("bigint"), F.right(d, F.lit(4)).cast("bigint")
        taxpayer = area >= 900
        place = F.when(taxpayer, area - 900).when(area > 666, area - 2).otherwise(area - 1)
        pair = feistel(place, (group - 1) * 9999 + serial - 1, F.when(taxpayer, 100).otherwise(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"), key, "ssn")
        padded = lambda number, width: F.lpad(number.cast("bigint").cast("string"), width, "0")

        def spelled(p: Column) -> Column:
            new_area = F.when(taxpayer, p["l"] + 900).when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
            return F.concat(padded(new_area, 3), padded(F.floor(p["r"] / 9999) + 1, 2), padded(F.pmod(p["r"], F.lit(9999)) + 1, 4))

        return F.when(~area.isin(0, 666) & (group > 0) & (serial > 0), _respelled(value, _let(pair, spelled)))

    return _let(_digits(value), read)


def _date(value: Column, key: str) -> Column:
    """A date in the order, digits and signs that it has; None if it is no date of the years 400 to 9999.

    Dates that can only be month first are read so, all others day first. A date stays in its form: one that can only
    be month first becomes such a one, and a day or month of one digit keeps one. So no two dates get one pseudonym.
    """

    def read(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        iso = F.length(a) == 4
        swapped = ~iso & made(c, b, a).isNull()
        day = F.when(iso, made(a, b, c)).otherwise(F.coalesce(made(c, b, a), made(c, a, b)))
        first = lambda d: F.when(swapped, F.month(d)).otherwise(F.dayofmonth(d))
        second = lambda d: F.when(swapped, F.dayofmonth(d)).otherwise(F.month(d))
        fits = lambda d: iso | (((F.length(a) == 2) | (first(d) < 10)) & ((F.length(b) == 2) | (second(d) < 10)) & (~swapped | (second(d) > 12)))
        spelled = lambda d: F.when(iso, F.date_format(d, "yyyyMMdd")).otherwise(
            F.concat(F.lpad(first(d).cast("string"), F.length(a), F.lit("0")), F.lpad(second(d).cast("string"), F.length(b), F.lit("0")), F.date_format(d, "yyyy"))
        )
        moved = _let(walked_day(day, key, fits), spelled)
        return F.when(day.isNotNull() & F.year(day).between(400, 9999), _respelled(value, moved))

    return _let(F.split(value, r"[./-]"), read)


def _spelled(value: Column, key: str, kind: str) -> Column:
    """A keyed hash of value in its own letters: digits for digits, hexadecimal for hexadecimal, letters for letters, the rest kept."""
    seed = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value), 256), 1, 8), 16, 10).cast("bigint")
    lower = value.rlike("[g-z]")
    upper = value.rlike("[G-Z]")
    pick = lambda alphabet, i: F.substr(F.lit(alphabet), (F.pmod(seed(i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    one = lambda c, i: (
        F.when(c.rlike("[0-9]"), pick("0123456789", i))
        .when(c.rlike("[a-z]"), F.when(lower, pick("abcdefghijklmnopqrstuvwxyz", i)).otherwise(pick("abcdef", i)))
        .when(c.rlike("[A-Z]"), F.when(upper, pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(pick("ABCDEF", i)))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _iban(value: Column, key: str) -> Column:
    """The account's digits permuted, letters kept, check digits made anew; None if the check digits are wrong."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    as_number = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    rest = lambda t: F.aggregate(F.split(as_number(t), ""), F.lit(0), lambda a, c: F.pmod(a * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97)).cast("int"))
    valid = rest(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))) == 1
    body = F.substr(plain, F.lit(5))
    own = _digits(body)
    moved = F.when(F.length(own) >= 2, _respelled(body, permuted_digits(own, key, "iban"))).otherwise(body)

    def checked(b: Column) -> Column:
        check = F.lpad((98 - rest(F.concat(b, F.left(plain, F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
        return _respelled(value, F.concat(check, _digits(b)))

    return F.when(valid, _let(moved, checked))


def pseudonym(value: Column, key: str) -> Column:
    """What stands for one match of ANY; the value itself where validation fails."""
    digits = _digits(value)
    at = F.instr(value, "@")
    secret = F.regexp_extract(value, r"^(.*?[:=]\s*[\"']?)(.*)$", 2)
    head = F.regexp_extract(value, r"^(.*?[:=]\s*[\"']?)(.*)$", 1)
    country = F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+(\d{1,3}?)(?=[ .(-]|\d{7,12}$)", 1))).otherwise(0)
    local = F.substr(digits, country + 1)
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    moved = (
        F.when(whole(SECRET), F.concat(head, _spelled(secret, key, "secret")))
        .when(at > 0, _mail(value, key))
        .when(whole(ACCESS_KEY), F.concat(F.left(value, F.lit(4)), _spelled(F.substr(value, F.lit(5)), key, "access")))
        .when(whole(DATE), _date(value, key))
        .when(whole(IPV4), F.when(F.forall(octets, lambda x: x <= 255), permuted_ipv4(value, key)))
        .when(whole(SSN), _ssn(value, key))
        .when(whole(PHONE), F.when(F.length(local).between(7, 15), _respelled(value, F.concat(F.left(digits, country), permuted_digits(local, key, "phone")))))
        .when(whole(CARD), _card(value, key))
        .when(whole(IBAN), _iban(value, key))
    )
    return F.coalesce(moved, value)


def pseudonymised(text: Column, key: str) -> Column:
    """text with every match of ANY replaced by its pseudonym."""
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))
    between = F.split(text, ANY, -1)
    moved = F.concat(F.transform(found, lambda v: pseudonym(v, key)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, moved, lambda a, b: F.concat(a, b)), "")
    hint = text.rlike(r"[0-9@]|(?i:token|secret|passw|pwd|api[_-]?key)")
    return F.when(hint, F.when(text.rlike(ANY), joined).otherwise(text)).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with their text pseudonymised (n_chars, where there is one, follows)."""
    out = spread(docs).withColumn(text, pseudonymised(F.col(text), key))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out
