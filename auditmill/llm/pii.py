"""Format-preserving pseudonyms for personal data, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

ROUNDS = 8

#: Forms that are looked for; a find is replaced only if it is also valid (see validated()).
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
GROUPS = r"[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
NATIONAL = r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
#: Country code and number, 8 to 15 digits; those of NANP, France and Spain by their length. A card or date after it is left out.
ABROAD = (
    r"\+(?:1(?:[ .\-]?\(?[0-9]\)?){10}|3[34](?:[ .\-]?\(?[0-9]\)?){9}|(?!1|3[34])[2-9]"
    r"(?:(?![ .\-](?:[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]))[ .\-]?\(?[0-9]\)?){7,14})(?![0-9])"
)
FORMS = {
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "phone": rf"{NATIONAL}|{ABROAD}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
NUMBERS = r"(?<![A-Za-z0-9.])(?:" + "|".join(FORMS.values()) + ")"
KINDS = ("email", *FORMS)

#: Lengths of IBANs by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: Forms of one length or grouping, tried in this order at every start within a zone, before the open forms above.
SPECIFIC = [
    "|".join([*[FORMS[k] for k in ("date", "ip", "phone", "ssn")], IBAN]),
    r"[0-9]{13,19}(?![0-9])", GROUPS, r"[0-9]{4}([ \-])[0-9]{6}\1[0-9]{4,5}(?![0-9])", GROUPS.replace("(?![0-9])", r"\1[0-9]{1,3}(?![0-9])"),
]
#: What can hold finds side by side: numbers and capitals with one or two signs between. A find starts where STARTS splits it.
ZONE = r"(?<![A-Za-z0-9.])(?:[A-Z]{2}(?=[0-9]{2})|\+?\(?)[0-9][A-Z0-9]*+(?:[ ./()+\-]{1,2}+[A-Z0-9]++(?![a-z]))*+[A-Za-z]*+"
STARTS = r"(?<=[ /()+\-])|(?=[+(])"
#: More parts than any find has.
REACH = 48

#: Days from 1900-01-01 to 2099-12-31, and the two factors of that count.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def whole(value: Column, by: Column | int) -> Column:
    """The whole part of value / by; plain division is inexact above 2**53."""
    return F.call_function("div", value.cast("long"), by if isinstance(by, Column) else F.lit(by).cast("long"))


def permuted(value: Column, left: int | Column, right: int | Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the integers from 0 to left * right - 1.

    An alternating Feistel network: a value is (value / right, value % right); each round adds a
    keyed hash of one half to the other, modulo that half's range. No value leaves the range, so
    no walk through cycles is needed.
    """
    a = left if isinstance(left, Column) else F.lit(left)
    b = right if isinstance(right, Column) else F.lit(right)
    a, b = a.cast("long"), b.cast("long")

    def keyed(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), a, b, i, x), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + keyed(i, s["r"]) % a, a)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + keyed(i, s["l"]) % b, b)).alias("r"),
        )

    start = F.struct(whole(value, b).alias("l"), F.pmod(value, b).alias("r"))
    rounds = F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Digit strings of up to 18 digits are permuted among those of their length; '' stays."""
    n = F.length(digits)
    half = F.floor(n / 2)
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    value = permuted(digits.cast("long"), ten(half), ten(n - half), key, tweak)
    return F.when(n == 0, F.lit("")).otherwise(F.lpad(value.cast("string"), n.cast("int"), F.lit("0")))


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at")
        )

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The check sum of a number whose last digit is the check digit."""
    places = F.split(F.reverse(digits), "")
    value = lambda c, i: c.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (c >= "5"), 9).otherwise(0)
    return F.aggregate(F.transform(F.filter(places, lambda c: c != ""), value), F.lit(0), lambda s, x: s + x)


def with_luhn(digits: Column) -> Column:
    """digits and its check digit."""
    return F.concat(digits, F.pmod(-luhn_sum(F.concat(digits, F.lit("0"))), F.lit(10)).cast("string"))


def mod97(text: Column) -> Column:
    """The remainder of the number that digits and letters (A = 10) spell."""

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        value = F.when(digit, c.cast("int")).otherwise(F.ascii(c) - 55)
        return (s * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def date_form(text: Column, day_first: bool) -> Column:
    """The form of a date: ISO, day first with a dot; with a slash as day_first says, unless one of the two is above 12."""
    first = F.substring(text, 4, 2) <= "12" if day_first else F.substring(text, 1, 2) > "12"
    return F.when(F.substring(text, 5, 1) == "-", "yyyy-MM-dd").when(F.substring(text, 3, 1) == ".", "dd.MM.yyyy").when(first, "dd/MM/yyyy").otherwise("MM/dd/yyyy")


def day_of(text: Column, day_first: bool = False) -> Column:
    """The date that a find spells, null for none."""
    return F.to_date(F.try_to_timestamp(text, date_form(text, day_first)))


def kind_of(find: Column, day_first: bool = False) -> Column:
    """The kind of a find if it is valid, else null.

    card: 13 to 19 digits, Luhn. iban: mod 97. date: a day of 1900 to 2099. ip: octets up to 255.
    phone: the exchange code (the first of the last seven digits) starts with 2 to 9, or a country
    code is given; the area code is not judged. ssn: area 001 to 899 but not 666, group and serial
    not zero.
    """
    full = lambda name: find.rlike(f"^(?:{FORMS[name]})$")
    digits = digits_of(find)
    plain = F.replace(find, F.lit(" "), F.lit(""))
    octets = F.transform(F.split(find, r"\."), lambda x: x.cast("int"))
    day = day_of(find, day_first)
    area, group, serial = F.substring(find, 1, 3), F.substring(find, 5, 2), F.substring(find, 8, 4)
    local = F.substring(digits, -7, 1)
    return (
        F.when(full("date"), F.when(F.year(day).between(1900, 2099), "date"))
        .when(full("ip"), F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(full("ssn"), F.when((area < "900") & ~area.isin("000", "666") & (group != "00") & (serial != "0000"), "ssn"))
        .when(full("phone"), F.when((local >= "2") | F.startswith(find, F.lit("+")), "phone"))
        .when(full("iban"), F.when(mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1, "iban"))
        .when(full("card"), F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, "card"))
    )


def pseudonym(find: Column, kind: Column, key: str, day_first: bool = False) -> Column:
    """The pseudonym of a valid find, in its form.

    Cards keep the first digit, IBANs the country and letters, phones country and area code;
    check digits are made anew. Dates stay between 1900 and 2099.
    """
    digits = digits_of(find)
    n = F.length(digits)
    card = refilled(find, with_luhn(F.concat(F.substring(digits, 1, 1), permuted_digits(F.substring(digits, F.lit(2), n - 2), key, "card"))))
    origin = F.lit(FIRST_DAY).cast("date")
    day = F.date_add(origin, permuted(F.datediff(day_of(find, day_first), origin).cast("long"), *DAYS, key, "date").cast("int"))
    form = date_form(find, day_first)
    date = F.date_format(day, "MM/dd/yyyy")
    for pattern in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy"):
        date = F.when(form == pattern, F.date_format(day, pattern)).otherwise(date)
    packed = F.aggregate(F.split(find, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    ip = let(
        permuted(packed, 65536, 65536, key, "ip"),
        lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )
    # The last seven digits; those with an exchange code from 200 on stay so.
    seven = F.substring(digits, -7, 7).cast("long")
    local = F.when(seven >= 2_000_000, permuted(seven - 2_000_000, 8_000, 1_000, key, "phone") + 2_000_000).otherwise(permuted(seven, 2_000, 1_000, key, "phone0"))
    phone = refilled(find, F.concat(F.substring(digits, F.lit(1), n - 7), F.lpad(local.cast("string"), 7, "0")))
    # Areas 001 to 899 without 666 are numbered from 0 to 897.
    area, group, serial = (F.substring(digits, a, k).cast("long") for a, k in ((1, 3), (4, 2), (6, 4)))
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def social(v: Column) -> Column:
        s, rest = F.pmod(v, F.lit(9999)), whole(v, 9999)
        g, place = F.pmod(rest, F.lit(99)), whole(rest, 99)
        number = place + F.when(place >= 665, 2).otherwise(1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), k, "0") for x, k in ((number, 3), (g + 1, 2), (s + 1, 4))])

    ssn = let(permuted(index, 898 * 99, 9999, key, "ssn"), social)
    own = F.substring(digits, F.lit(3), n)
    moved = F.concat(permuted_digits(F.substring(own, 1, 16), key, "iban1"), permuted_digits(F.substring(own, 17, 18), key, "iban2"))

    def checked(form: Column) -> Column:
        plain = F.replace(form, F.lit(" "), F.lit(""))
        rest = mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 2), F.lit("00")))
        return F.concat(F.substring(form, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(form, 5, 60))

    iban = let(refilled(find, F.concat(F.lit("00"), moved)), checked)
    return F.when(kind == "card", card).when(kind == "date", date).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban)


def email_pseudonym(find: Column, key: str) -> Column:
    """The local part becomes twelve letters, keyed by the whole address without regard to case; the domain stays."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(find)), 256)
    return F.concat(F.translate(F.substring(digest, 1, 12), "0123456789abcdef", "abcdefghijklmnop"), F.substring(find, F.locate("@", find), F.length(find)))


def rewritten(text: Column, pattern: str, judge) -> Column:
    """struct(text, kinds): text with each find f of pattern as judge(f) has it, a struct(kinds, out).

    kinds are those of the finds, in order; a find that stays has none.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), judge).alias("finds"))
    joined = lambda p: F.array_join(F.zip_with(p["gaps"], p["finds"], lambda g, f: F.concat(g, F.coalesce(f["out"], F.lit("")))), "")
    kinds = lambda p: F.flatten(F.transform(p["finds"], lambda f: f["kinds"]))
    return let(parts, lambda p: F.struct(joined(p).alias("text"), kinds(p).alias("kinds")))


def listed(kind: Column) -> Column:
    return F.when(kind.isNotNull(), F.array(kind)).otherwise(F.array().cast("array<string>"))


def specific(text: Column, day_first: bool) -> Column:
    """struct(kind, find) of the first specific form that text starts with and that is valid, or null."""
    finds = F.filter(F.array(*[F.regexp_extract(text, f"^(?:{p})", 0) for p in SPECIFIC]), lambda x: x != "")
    valid = F.filter(F.transform(finds, lambda x: F.struct(kind_of(x, day_first).alias("kind"), x.alias("find"))), lambda v: v["kind"].isNotNull())
    return F.when(text.rlike("^(?:[0-9+(]|[A-Z]{2}[0-9]{2})"), F.get(valid, F.lit(0)))


def parted(zone: Column, day_first: bool) -> Column:
    """A zone as an array of struct(open, kind, find): valid specific finds, each with the text before it; the last has only text.

    Every start is tried, from left to right, so a form that is not valid takes nothing from the next one.
    """

    def over(tokens: Column) -> Column:
        start = F.struct(F.lit(0).alias("skip"), F.lit("").alias("open"), F.array().cast("array<struct<open:string,kind:string,find:string>>").alias("done"))

        def step(s: Column, i: Column) -> Column:
            token = F.element_at(tokens, i)
            got = F.when(s["skip"] == 0, specific(F.array_join(F.slice(tokens, i, REACH), ""), day_first))

            def after(v: Column) -> Column:
                new = v["got"].isNotNull()
                skip = F.when(new, F.length(v["got"]["find"])).otherwise(s["skip"])
                left = F.substring(v["token"], skip + 1, F.length(v["token"]))
                done = F.when(new, F.concat(s["done"], F.array(F.struct(s["open"].alias("open"), v["got"]["kind"].alias("kind"), v["got"]["find"].alias("find"))))).otherwise(s["done"])
                return F.struct(F.greatest(skip - F.length(v["token"]), F.lit(0)).alias("skip"), F.concat(F.when(new, "").otherwise(s["open"]), left).alias("open"), done.alias("done"))

            return let(F.struct(token.alias("token"), got.alias("got")), after)

        none = F.lit(None).cast("string")
        end = lambda s: F.concat(s["done"], F.array(F.struct(s["open"].alias("open"), none.alias("kind"), none.alias("find"))))
        return F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step, end)

    return let(F.split(zone, STARTS, -1), over)


def pseudonymised(text: Column, key: str, day_first: bool = False) -> Column:
    """struct(text, kinds) of a text: addresses first, then numbers and dates, zone by zone; open forms last."""
    none = F.array().cast("array<string>")

    def number(f: Column) -> Column:
        return let(F.struct(f.alias("f"), kind_of(f, day_first).alias("k")), lambda v: F.struct(listed(v["k"]).alias("kinds"), F.coalesce(pseudonym(v["f"], v["k"], key, day_first), v["f"]).alias("out")))

    def piece(p: Column) -> Column:
        before = F.when(F.length(p["open"]) < 7, F.struct(p["open"].alias("text"), none.alias("kinds"))).otherwise(rewritten(p["open"], NUMBERS, number))
        own = F.coalesce(pseudonym(p["find"], p["kind"], key, day_first), F.lit(""))
        return let(before, lambda b: F.struct(F.concat(b["kinds"], listed(p["kind"])).alias("kinds"), F.concat(b["text"], own).alias("out")))

    def zone(f: Column) -> Column:
        whole_zone = let(F.transform(parted(f, day_first), piece), lambda a: F.struct(F.flatten(F.transform(a, lambda x: x["kinds"])).alias("kinds"), F.array_join(F.transform(a, lambda x: x["out"]), "").alias("out")))
        return F.when(F.length(f) < 7, F.struct(none.alias("kinds"), f.alias("out"))).otherwise(whole_zone)

    def numbers(s: Column) -> Column:
        found = rewritten(s["text"], ZONE, zone)
        both = let(found, lambda v: F.struct(v["text"].alias("text"), F.concat(s["kinds"], v["kinds"]).alias("kinds")))
        return F.when(s["text"].rlike("[0-9]"), both).otherwise(s)

    mails = rewritten(text, EMAIL, lambda f: F.struct(F.array(F.lit("email")).alias("kinds"), email_pseudonym(f, key).alias("out")))
    first = F.when(F.contains(text, F.lit("@")), mails).otherwise(F.struct(text.alias("text"), none.alias("kinds")))
    return let(first, numbers)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", day_first: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of finds of each kind (n_email, n_card, ...).

    One pass without a shuffle. A value has one pseudonym for one key, in whatever document it
    stands and however its digits are spaced, and two numbers or days of one kind never share
    one. Addresses are the exception: 48 bits of a keyed hash, so two of one domain may meet. Dates
    with a slash are read month first, or with day_first day first; where that is no date the other
    way round, and they come out in the order in which they were read. Null text stays null with counts of 0. Repeated rows repeat; other columns are not read.
    """
    text = F.col(text_col)
    done = docs.select(F.col(id_col).alias("doc_id"), F.when(text.isNotNull(), pseudonymised(text, key, day_first)).alias("p"))
    count = lambda k: F.coalesce(F.size(F.filter("p.kinds", lambda x: x == k)), F.lit(0)).cast("long")
    return done.select("doc_id", F.col("p.text").alias("text"), *[F.greatest(count(k), F.lit(0)).alias(f"n_{k}") for k in KINDS])
