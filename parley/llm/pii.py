"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Every number, date, address or secret that its type's check accepts is replaced by another of the same format. The
replacement is a keyed permutation of the type's values, a Feistel network: the value becomes a list of parts, each in a
range of its own; in turn one half of the parts is shifted, each part within its range, by digits of a keyed hash of the
other half. So equal values get equal pseudonyms in every document, different ones stay different, check digits stay
right, and whoever holds the key can turn it back.

=========  =====================================================  ==========================================================
type       accepted                                               kept
=========  =====================================================  ==========================================================
email      local part, domain of two labels or more               length, kind of every character, last label, separators
card       13 to 19 digits, check digit right                     length, separators; the check digit is made anew
phone      any ten digits after +1 or in (xxx) xxx-xxxx form;     +1 or the first three digits, separators
           8 to 15 digits after + and another country code
ssn        three, two and four digits, none of them unassigned    dashes
ip         four numbers up to 255                                 dots
ipv6       eight hexadecimal groups, or fewer around ::           colons, kind of every character
date       a day of 1800 to 2199, year first (- /) or last        form, order and number of digits
           (- / . between one or two digits for day and month)
iban       check digits right                                     country, length, kind of every character; check digits anew
secret     values named password, passphrase, secret, token, api  name, quotes, length, kind of every character,
           key or authorization, names in quotes or longer ones   other signs than letters and digits
           (db_password) too, up to the quote, blank or
           separator, of six characters or any more
secret     access key ids (AKIA, ASIA, ghp_, sk-, xoxb-, ...),    leading mark, length, kind of every character,
           web tokens (eyJ), bearer values, private key blocks    other signs
=========  =====================================================  ==========================================================

A date with the year last is read month first between slashes and day first between dots and dashes; if that is no date, the
other way round. Its pseudonym is read in the same way and has as many digits: the permutation of all days is repeated until
it comes to such a day.

Defined results: a null text stays null with no finds; an empty text stays empty; rows are independent of each other, so
repeated rows get the same text; other columns pass through unchanged, whatever their names (one
named n_replaced gives way). Text that no check accepts, such as a number with a wrong check digit or ten digits without any
sign of a phone number, is not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import packed, restored

ROUNDS = 8
#: Shifts that one digest gives, 16 bits each; a longer half takes a digest for each block of as many parts.
SHIFTS = 32

#: One pattern per type; the names are also the tweak of the permutation. Tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|authorization)[\"']?\s{0,3}[=:]\s{0,3}"
    r"(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|(?i:(?:bearer|basic)\s{1,3})?[^\s\"'`,;&<>(){}\[\]]{6,}+)"
    r"|(?:gh[oprsu]_|sk-|xox[abprs]-)(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}+"
    r"|eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+"
    r"|(?i:bearer)\s{1,3}(?=[A-Za-z._~+/-]*[0-9])[A-Za-z0-9._~+/-]{16,}+={0,2}"
    r"|-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:18|19|20|21)[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?![0-9A-Za-z/-])"
    r"|(?<![0-9A-Za-z/.-])(?:[0-9]{1,2}/[0-9]{1,2}/|[0-9]{1,2}\.[0-9]{1,2}\.|[0-9]{1,2}-[0-9]{1,2}-)(?:18|19|20|21)[0-9]{2}(?![0-9A-Za-z/-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{1,4}:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"\+(?<![0-9A-Za-z+]\+)(?!1[ .(-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]))[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9A-Za-z])|"
    r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?|\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of one whole cycle of the calendar, 1800 to 2199: 146,097 = 27 * 5,411.
FIRST_DAY, LAST_DAY, DAY_PARTS = "1800-01-01", "2199-12-31", (27, 5411)
#: Steps to a day of the same form. At least a fifth of the days have it, so that a walk of this length misses with a chance of 1e-38.
WALK = 400


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(parts: Column, ranges: Column, tweak: Column, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of lists of integers, part i in [0, range i). At least two parts; a range of 1 holds a part still."""
    turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def bound(b: Column) -> Column:  # what does not change from part to part is computed once
        return F.aggregate(F.array(*(F.lit(t) for t in turns)), b["parts"], lambda held, turn: _turn(held, turn, b["ranges"], b["half"], b["tweak"], key, inverse))

    return _let(F.struct(parts.alias("parts"), ranges.alias("ranges"), F.floor(F.size(parts) / 2).cast("int").alias("half"), tweak.alias("tweak")), bound)


def _turn(held: Column, turn: Column, ranges: Column, half: Column, tweak: Column, key: str, inverse: bool) -> Column:
    left = turn % 2 == 0  # this turn shifts the left half
    other = F.when(left, F.slice(held, half + 1, F.size(held))).otherwise(F.slice(held, 1, half))
    heard = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), F.array_join(other.cast("array<string>"), ","))
    blocks = F.sequence(F.lit(0), F.floor(F.size(held) / (2 * SHIFTS)).cast("int"))  # a half holds at most one more than these
    digests = _let(heard, lambda h: F.transform(blocks, lambda b: F.sha2(F.when(b == 0, h).otherwise(F.concat_ws("|", h, b.cast("string"))).cast("binary"), 512)))

    def shift(hexes: Column) -> Column:
        def move(v: Column, i: Column) -> Column:
            own = F.when(left, i < half).otherwise(i >= half)
            at = F.when(left, i).otherwise(i - half)
            step = F.conv(F.substring(F.get(hexes, F.floor(at / SHIFTS).cast("int")), F.pmod(at, F.lit(SHIFTS)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            step = -step if inverse else step
            return F.when(own, F.pmod(v + step, F.get(ranges, i))).otherwise(v)

        return F.transform(held, move)

    return _let(digests, shift)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _code(c: Column) -> Column:
    return F.ascii(c)


def permute_text(text: Column, tweak: Column, key: str, inverse: bool, hexadecimal: Column | None = None, fixed=None) -> Column:
    """Permutes digits among digits and letters among letters of the same case; the rest stays.

    hexadecimal: letters stay within a to f. fixed(c, i): further characters that stay.
    """

    def kind(c: Column, i: Column, letters: Column) -> tuple[Column, Column]:
        digit, lower, upper = c.rlike("^[0-9]$"), c.rlike("^[a-z]$"), c.rlike("^[A-Z]$")
        still = fixed(c, i) if fixed is not None else F.lit(False)
        size = F.when(still, 1).when(digit, 10).when(lower | upper, letters).otherwise(1)
        return size, F.when(digit, 48).when(lower, 97).when(upper, 65).otherwise(0)

    def body(b: Column) -> Column:
        chars, of = b["chars"], lambda c, i: kind(c, i, b["letters"])
        sizes = F.transform(chars, lambda c, i: of(c, i)[0].cast("int"))
        parts = F.transform(chars, lambda c, i: F.when(of(c, i)[0] > 1, _code(c) - of(c, i)[1]).otherwise(0).cast("int"))
        form = F.array_join(F.transform(chars, lambda c, i: F.when(of(c, i)[0] > 1, F.concat(of(c, i)[0].cast("string"), of(c, i)[1].cast("string"))).otherwise(c)), " ")
        moved = feistel(parts, sizes, F.concat_ws("|", tweak, form), key, inverse)
        return F.array_join(F.zip_with(chars, F.transform(moved, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda c, m: F.when(of(c, m["i"])[0] > 1, F.char(m["v"] + of(c, m["i"])[1])).otherwise(c)), "")

    letters = F.when(hexadecimal, 6).otherwise(26) if hexadecimal is not None else F.lit(26)
    return _let(F.struct(_chars(text).alias("chars"), letters.alias("letters")), body)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ints(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: c.cast("int"))


def _luhn_sum(digits: Column) -> Column:
    """Sum with every second digit doubled, the last of the list taken once."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by those of the list."""

    def body(new: Column) -> Column:
        walked = F.aggregate(
            _chars(form),
            F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
            lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.get(new, a["n"]).cast("string")).alias("out"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
        )
        return walked["out"]

    return _let(digits, body)


def _times(size: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value), size)


def _card(m: Column, key: str, inverse: bool) -> Column:
    def body(d: Column) -> Column:
        body_digits = F.slice(d, 1, F.size(d) - 1)
        moved = feistel(body_digits, _times(F.size(d) - 1, 10), F.concat(F.lit("card"), F.size(d).cast("string")), key, inverse)
        whole = _let(moved, lambda p: F.concat(p, F.array(F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(p, F.array(F.lit(0)))), F.lit(10)), F.lit(10)).cast("int"))))
        return F.when(_luhn_sum(d) % 10 == 0, _refill(m, whole)).otherwise(m)

    return _let(_ints(_digits(m)), body)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    def body(d: Column) -> Column:
        national = ~m.startswith("+") | (m.startswith("+1") & (F.size(d) == 11))
        n = F.when(national, 10).otherwise(F.size(d) - 3)  # digits that move
        moved = feistel(F.slice(d, F.size(d) - n + 1, n), F.array_repeat(F.lit(10), n), F.lit("phone"), key, inverse)
        return F.when(F.size(d) >= 8, _refill(m, F.concat(F.slice(d, 1, F.size(d) - n), moved))).otherwise(m)

    return _let(_ints(_digits(m)), body)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("int") for i in (1, 2, 3))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    parts = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = feistel(parts, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key, inverse)
    new = _let(moved, lambda p: F.format_string("%03d-%02d-%04d", F.when(F.get(p, 0) >= 665, F.get(p, 0) + 2).otherwise(F.get(p, 0) + 1), F.get(p, 1) + 1, F.get(p, 2) + 1))
    return F.when(good, new).otherwise(m)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    def body(o: Column) -> Column:
        moved = feistel(o, _times(F.lit(4), 256), F.lit("ip"), key, inverse)
        return F.when(F.forall(o, lambda x: x < 256), F.array_join(moved.cast("array<string>"), ".")).otherwise(m)

    return _let(F.split(m, r"\.").cast("array<int>"), body)


def _moved_day(day: Column, key: str, inverse: bool) -> Column:
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    wide, narrow = DAY_PARTS[1], DAY_PARTS[0]
    moved = feistel(F.array(F.floor(n / wide).cast("int"), (n % wide).cast("int")), F.array(F.lit(narrow), F.lit(wide)), F.lit("date"), key, inverse)
    return _let(moved, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(p, 0) * wide + F.get(p, 1)))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _year_first(m: Column, key: str, inverse: bool) -> Column:
    day = F.try_to_date(F.regexp_replace(m, "/", "-"), "yyyy-MM-dd")
    text = F.date_format(_moved_day(day, key, inverse), "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.when(m.contains("/"), F.regexp_replace(text, "-", "/")).otherwise(text)).otherwise(m)


def _year_last(m: Column, key: str, inverse: bool) -> Column:
    """Walks on through the days until one is written with as many digits and read in the same order."""

    def body(f: Column) -> Column:
        one, two, year = F.get(f, 0), F.get(f, 1), F.get(f, 2)
        slash = m.contains("/")
        usual = F.when(slash, _day(year, one, two)).otherwise(_day(year, two, one))
        other = F.when(slash, _day(year, two, one)).otherwise(_day(year, one, two))

        def walk(s: Column) -> Column:
            month_first = slash == s["usual"]

            def digits(v: Column, like: Column) -> Column:
                padded = F.length(like) == 2
                return F.when(padded, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))

            def fits(d: Column) -> Column:
                first = F.when(month_first, F.month(d)).otherwise(F.dayofmonth(d))
                second = F.when(month_first, F.dayofmonth(d)).otherwise(F.month(d))
                narrow = ((F.length(one) == 2) | (first < 10)) & ((F.length(two) == 2) | (second < 10))
                return narrow & (s["usual"] | (F.dayofmonth(d) > 12))  # a day up to 12 would be read in the usual order

            def step(a: Column, _: Column) -> Column:
                return F.when(a["done"], a).otherwise(_let(_moved_day(a["day"], key, inverse), lambda d: F.struct(d.alias("day"), fits(d).alias("done"))))

            def write(d: Column) -> Column:
                first = F.when(month_first, F.month(d)).otherwise(F.dayofmonth(d))
                second = F.when(month_first, F.dayofmonth(d)).otherwise(F.month(d))
                sign = F.substring(m, F.length(one) + 1, F.lit(1))
                return F.concat(digits(first, one), sign, digits(second, two), sign, F.date_format(d, "yyyy"))

            start = F.struct(s["day"].alias("day"), F.lit(False).alias("done"))
            end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)
            return F.when(s["day"].isNotNull(), _let(end["day"], write)).otherwise(m)

        return _let(F.struct(F.coalesce(usual, other).alias("day"), usual.isNotNull().alias("usual")), walk)

    return _let(F.split(m, "[/.-]"), body)


def _date(m: Column, key: str, inverse: bool) -> Column:
    return F.when(m.rlike("^[0-9]{4}"), _year_first(m, key, inverse)).otherwise(_year_last(m, key, inverse))


def _mod97(text: Column) -> Column:
    """Remainder of the number that the text spells, letters as 10 to 35."""
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + _code(c) - 55, F.lit(97))).cast("int"),
    )


def _iban(m: Column, key: str, inverse: bool) -> Column:
    def body(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
        good = _mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1
        moved = permute_text(F.substring(m, 5, 60), F.concat(F.lit("iban"), country), key, inverse)
        new = _let(moved, lambda p: F.concat(country, F.format_string("%02d", F.lit(98) - _mod97(F.concat(F.regexp_replace(p, " ", ""), country, F.lit("00")))), p))
        return F.when(good, new).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), body)


def _email(m: Column, key: str, inverse: bool) -> Column:
    head = F.regexp_extract(m, r"^(.*)\.[A-Za-z]+$", 1)
    return F.concat(permute_text(head, F.lit("email"), key, inverse), F.regexp_extract(m, r"\.[A-Za-z]+$", 0))


#: What stays before and behind a secret value.
BEFORE = (
    r"^(-----BEGIN [A-Z ]*PRIVATE KEY-----|(?:AKIA|ASIA)(?=[A-Z0-9]{16}$)|gh[oprsu]_|sk-|xox[abprs]-|eyJ(?=[A-Za-z0-9_-]+\.)|(?i:bearer)\s+"
    r"|[A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?(?i:(?:bearer|basic)\s+)?)"
)
BEHIND = r"(-----END [A-Z ]*PRIVATE KEY-----|[\"']|)$"


def _secret(m: Column, key: str, inverse: bool) -> Column:
    """The value between what names or marks it. Hexadecimal values stay hexadecimal."""

    def body(b: Column) -> Column:
        value = F.substring(m, F.length(b["name"]) + 1, F.length(m) - F.length(b["name"]) - F.length(b["end"]))
        return F.concat(b["name"], permute_text(value, F.lit("secret"), key, inverse, hexadecimal=value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")), b["end"])

    return _let(F.struct(F.regexp_extract(m, BEFORE, 1).alias("name"), F.regexp_extract(m, BEHIND, 1).alias("end")), body)


def _ipv6(m: Column, key: str, inverse: bool) -> Column:
    return permute_text(m, F.lit("ipv6"), key, inverse, hexadecimal=F.lit(True))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ipv6": _ipv6, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one match; the match itself if its type's check does not accept it."""
    out = F
    for name, make in MAKERS.items():
        out = out.when(m.rlike(f"^(?:{PATTERNS[name]})$"), make(m, key, inverse))
    return out.otherwise(m)


def pseudonymise(df: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """df with pseudonyms in its text column, and as last column ``n_replaced``, the number of values replaced."""
    rows = packed(df, text)
    whole = F.col(text)
    maybe = whole.rlike("[0-9@=:]|KEY-----|eyJ")  # no type goes without one of these
    rows = rows.withColumn("found", F.when(maybe, F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("new", F.transform("found", lambda m: pseudonym(m, key, inverse)))
    around = F.split(whole, ANY, -1)
    joined = F.array_join(F.zip_with(around, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    n = F.coalesce(F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x)), F.lit(0))
    changed = F.when(F.size("found") > 0, joined).otherwise(whole)
    return restored(rows, df, {text: changed}, {"n_replaced": F.when(F.col("found").isNull(), 0).otherwise(n).cast("int")})
