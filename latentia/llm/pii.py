"""Operator 1: format-preserving Feistel pseudonyms for personal data, in built-in functions only.

Each candidate of one pattern is validated by its kind (below), turned into digits of mixed radix, permuted by a keyed Feistel
network over two halves and written back in its own format; check digits are computed anew.  The permutation depends on
the key, the kind and the value alone, so equal values stay linked across documents and spellings, and it is a bijection within
a format.

* card: 13 to 19 digits with a right Luhn digit; the first digit stays.  Trailing digit groups that spoil it are left alone.
* iban: a country of COUNTRIES, its length, mod 97, in either case; what follows that length is left alone.
* ssn: 3-2-4 digits, no area 000, 666 or 900 and up, no zero group or serial.
* phone: 3-3-4 digits with or without a country code, or ``+``, a country code and 7 to 14 more digits in groups; the country code stays.
* ip: four octets.
* date: year first, day first, or month first where the day first reading is none, of 1900 to 2099 (17 * 4297 days).
* email: a local part without double or outer points and a top level of two letters or more; the domain stays.

A candidate that fails is searched once more for the other kinds within it (a phone number after other digits, say).

Defined cases: a null text stays null with counts 0; what fails validation stays as it is; texts without candidates are not rebuilt;
equal rows give equal rows; extra columns are kept by ``pseudonymize``, but a column named as a count gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For ``report``: a session's key is spark.latentia.pii.key; without one this open key is used, which hides nothing from its readers.
OPEN_KEY = "open-key"
ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
#: IBAN lengths by country.
COUNTRIES = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
    "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 "
    "PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()

#: Candidates; the first alternative that matches at a place decides, validation comes after.  No pattern has groups that capture but
#: the separators, which are numbered in the order of the alternatives.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"\b(?=[A-Za-z]{2}[0-9]{2})(?i:" + "|".join(c[:2] for c in COUNTRIES) + r")[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?\b"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9-])(?:\+[0-9]{1,3}[ .-]?|1[.-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
ABROAD = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,14})){1,6}(?![0-9])"
CARD = r"(?<![0-9])[0-9]{3}(?:[ -]?[0-9]){10,16}(?![0-9])"
#: Country codes of one and of two digits; all others have three.
CODE_1 = r"^\+[17]"
CODE_2 = r"^\+(?:20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98)"
#: Kind by pattern, in the order they are tried.
PATTERNS = (("email", EMAIL), ("iban", IBAN), ("ip", IPV4), ("date", DATE), ("ssn", SSN), ("phone", PHONE), ("abroad", ABROAD), ("card", CARD))
#: Kinds whose patterns reach over others; within their failed candidates the other kinds are searched.
REACHING = ("iban", "card", "abroad")
INNER = tuple(p for p in PATTERNS if p[0] not in REACHING)
#: A cheap sign that a text holds a candidate at all.
CUE = r"@|[0-9][0-9./ ()-]{5}[0-9]|\+[0-9]|[A-Za-z]{2}[0-9]{2}"

lit = F.lit


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def numbers(s: Column) -> Column:
    """The characters of a digit string as an array of int."""
    return F.transform(F.sequence(lit(1), F.length(s)), lambda i: F.substring(s, i, lit(1)).cast("int"))


def luhn_sum(d: Column) -> Column:
    """Luhn sum of digits whose last one has weight 1."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    parts = F.transform(d, lambda x, i: F.when((F.size(d) - 1 - i) % 2 == 1, doubled(x)).otherwise(x))
    return F.aggregate(parts, lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    """Remainder of an IBAN read as a number (rearranged, letters from 10 on)."""
    turned = F.concat(F.substring(s, 5, 99), F.substring(s, 1, 4))
    value = lambda i: F.conv(F.substring(turned, i, lit(1)), 36, 10).cast("int")
    return F.aggregate(F.sequence(lit(1), F.length(turned)), lit(0), lambda r, i: (r * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97)


def feistel(values: Column, radices: Column, kind: Column | str, key: str = OPEN_KEY) -> Column:
    """Keyed bijection of arrays of int with mixed radices: two halves, ROUNDS rounds.

    A round adds to each place of one half a number hashed from key, kind, round, place and the other half.
    """
    tag = lit(kind) if isinstance(kind, str) else kind
    n = F.size(values)
    cut = F.floor(n / 2).cast("int")
    half = lambda a, first: F.slice(a, lit(1), cut) if first else F.slice(a, cut + 1, n - cut)

    def mixed(own: Column, other: Column, radix: Column, r: int) -> Column:
        seen = F.array_join(other, ",")
        noise = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", lit(key), tag, lit(r), i, seen), 256), 1, 7), 16, 10).cast("int")
        return F.transform(own, lambda x, i: F.pmod(x + noise(i), F.get(radix, i)))

    ra, rb = half(radices, True), half(radices, False)
    state = F.struct(half(values, True).alias("a"), half(values, False).alias("b"))
    steps = F.sequence(lit(0), lit(ROUNDS - 1))

    def step(s: Column, r: Column) -> Column:
        even = F.struct(mixed(s["a"], s["b"], ra, r).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), mixed(s["b"], s["a"], rb, r).alias("b"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(steps, state, step, lambda s: F.concat(s["a"], s["b"]))


def fill(shape: Column, values: Column) -> Column:
    """shape with its digits replaced, in order, by the values."""
    rest = F.array_append(F.split(shape, "[0-9]", -1), "")
    return F.array_join(F.zip_with(F.slice(rest, lit(1), F.size(values) + 1), F.array_append(F.transform(values, lambda v: v.cast("string")), ""), lambda a, b: F.concat(F.coalesce(a, lit("")), F.coalesce(b, lit("")))), "")


def same(n: Column, radix: int) -> Column:
    return F.array_repeat(lit(radix), n)


def luhn_valid(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(13, 19) & (luhn_sum(numbers(d)) % 10 == 0) & ~d.rlike("^(.)\\1*$")


def card_head(m: Column) -> Column:
    """The longest valid part of up to two digit groups less; the last of them where none is valid."""
    less = lambda groups: F.regexp_extract(m, "^(.*?[0-9])(?:[ -][0-9]+){%d}$" % groups, 1)
    return F.when(luhn_valid(m), m).when(luhn_valid(less(1)), less(1)).otherwise(less(2))


def characters(s: Column) -> tuple[Column, Column]:
    """Codes and radices of characters: digits 10, letters 26 within their case, others 1 (they stay)."""
    chars = F.transform(F.sequence(lit(1), F.length(s)), lambda i: F.substring(s, i, lit(1)))
    code = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[A-Z]"), F.ascii(c) - 65).when(c.rlike("[a-z]"), F.ascii(c) - 97).otherwise(0))
    radix = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1))
    return code, radix


def respelled(s: Column, codes: Column) -> Column:
    char = lambda i: F.substring(s, i + 1, lit(1))
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)
    return F.array_join(F.transform(codes, lambda v, i: F.when(char(i).rlike("[A-Za-z0-9]"), F.chr(base(char(i)) + v)).otherwise(char(i))), "")


def iban_head(m: Column) -> Column:
    """The country's length of it; empty where it is shorter or goes on."""
    lengths = F.create_map(*[lit(x) for c in COUNTRIES for x in (c[:2], int(c[2:]))])
    size = F.element_at(lengths, F.upper(F.substring(m, 1, 2)))
    spots = F.filter(F.sequence(lit(1), F.length(m) + 1), lambda i: F.substring(m, i, lit(1)) != " ")
    last, after = F.get(spots, size - 1), F.get(spots, size)
    return F.when(after > F.length(m), m).when(after > last + 1, F.substring(m, lit(1), last)).otherwise("")


class Card:
    head = staticmethod(card_head)
    valid = staticmethod(luhn_valid)

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        d = numbers(digits(m))
        return F.slice(d, lit(2), F.size(d) - 2), same(F.size(d) - 2, 10)

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        body = F.concat(F.slice(numbers(digits(m)), 1, 1), out)
        return fill(m, F.array_append(body, F.pmod(lit(10) - F.pmod(luhn_sum(F.array_append(body, lit(0))), lit(10)), lit(10))))


class Iban:
    """Letter case and blanks stay."""

    head = staticmethod(iban_head)

    @staticmethod
    def valid(m: Column) -> Column:
        bare = F.replace(m, lit(" "))
        return (F.length(bare) >= 15) & (mod97(bare) == 1)

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        return characters(F.substring(F.replace(m, lit(" ")), 5, 99))

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        new = respelled(F.substring(F.replace(m, lit(" ")), 5, 99), out)
        check = lit(98) - mod97(F.concat(F.substring(m, 1, 2), lit("00"), new))
        plain = F.concat(F.substring(m, 1, 2), F.lpad(check.cast("string"), 2, "0"), new)
        letters = F.split(plain, "")
        blanks = F.split(m, "[A-Za-z0-9]", -1)
        return F.array_join(F.zip_with(blanks, letters, lambda a, b: F.concat(F.coalesce(a, lit("")), F.coalesce(b, lit("")))), "")


class Abroad:
    """All digits after the country code change, so a number keeps its link however it is grouped."""

    @staticmethod
    def code(m: Column) -> Column:
        """Digits of the country code, which its first digits decide."""
        return F.when(m.rlike(CODE_1), 1).when(m.rlike(CODE_2), 2).otherwise(3)

    @staticmethod
    def valid(m: Column) -> Column:
        n = F.length(digits(m))
        return (n - Abroad.code(m)).between(7, 14) & (n <= 15)

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        rest = numbers(F.substr(digits(m), Abroad.code(m) + 1))
        return rest, same(F.size(rest), 10)

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        return fill(m, F.concat(F.slice(numbers(digits(m)), lit(1), Abroad.code(m)), out))


class Phone:
    """The last 10 digits change, a country code stays."""

    @staticmethod
    def valid(m: Column) -> Column:
        return F.length(digits(m)) >= 10

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        return numbers(F.right(digits(m), lit(10))), same(lit(10), 10)

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        d = numbers(digits(m))
        return fill(m, F.concat(F.slice(d, lit(1), F.size(d) - 10), out))


class Ssn:
    @staticmethod
    def parts(m: Column) -> list[Column]:
        return [F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4))]

    @staticmethod
    def valid(m: Column) -> Column:
        area, group, serial = Ssn.parts(m)
        return (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        area, group, serial = Ssn.parts(m)
        return F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1), F.array(lit(898), lit(99), lit(9999))

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        area = F.get(out, lit(0)) + F.when(F.get(out, lit(0)) >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.get(out, lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(out, lit(2)) + 1).cast("string"), 4, "0"))


class Ip:
    @staticmethod
    def parts(m: Column) -> Column:
        return F.split(m, "\\.").cast("array<int>")

    @staticmethod
    def valid(m: Column) -> Column:
        return F.array_max(Ip.parts(m)) <= 255

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        return Ip.parts(m), same(lit(4), 256)

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        return F.array_join(out.cast("array<string>"), ".")


class Date:
    """Days from 1900 on, 17 * 4297 of them."""

    FIRST, HIGH, LOW = "1900-01-01", 17, 4297

    @staticmethod
    def month_first(m: Column) -> Column:
        return m.rlike("^(0[1-9]|1[0-2])/(1[3-9]|2[0-9]|3[01])/")

    @staticmethod
    def day(m: Column) -> Column:
        """Number of the day, null if there is none."""
        order = F.when(m.rlike("^[0-9]{4}"), F.regexp_replace(m, "/", "-")).when(Date.month_first(m), F.regexp_replace(m, "^(..).(..).(....)$", "$3-$1-$2")).otherwise(F.regexp_replace(m, "^(..).(..).(....)$", "$3-$2-$1"))
        return F.date_diff(F.try_to_date(order, "yyyy-MM-dd"), lit(Date.FIRST).cast("date"))

    @staticmethod
    def valid(m: Column) -> Column:
        return Date.day(m).between(0, Date.HIGH * Date.LOW - 1)

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        day = Date.day(m)
        return F.array(F.floor(day / Date.LOW).cast("int"), (day % Date.LOW).cast("int")), F.array(lit(Date.HIGH), lit(Date.LOW))

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        new = F.date_format(F.date_add(lit(Date.FIRST).cast("date"), F.get(out, lit(0)) * Date.LOW + F.get(out, lit(1))), "yyyy-MM-dd")
        sep = F.when(m.rlike("^[0-9]{4}"), F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
        swap = lambda to: F.regexp_replace(new, "^(....)-(..)-(..)$", to)
        turned = F.when(m.rlike("^[0-9]{4}"), new).when(Date.month_first(m), swap("$2-$3-$1")).otherwise(swap("$3-$2-$1"))
        return F.replace(turned, lit("-"), sep)


class Email:
    """The local part is permuted character class by character class; the domain stays."""

    @staticmethod
    def valid(m: Column) -> Column:
        return m.rlike(r"^[^@]*[^@.]@.*\.[A-Za-z]{2,}$") & ~m.rlike(r"\.\.")

    @staticmethod
    def places(m: Column) -> tuple[Column, Column]:
        return characters(F.substring_index(m, "@", 1))

    @staticmethod
    def written(m: Column, out: Column) -> Column:
        return F.concat(respelled(F.substring_index(m, "@", 1), out), lit("@"), F.substring_index(m, "@", -1))


RULES = {"email": Email, "iban": Iban, "ip": Ip, "date": Date, "ssn": Ssn, "phone": Phone, "abroad": Abroad, "card": Card}


def any_of(patterns: tuple[tuple[str, str], ...]) -> str:
    return "|".join(p for _, p in patterns)


def matched(m: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The first pattern that matches the whole of a candidate."""
    out = F.when(lit(False), "")
    for name, p in patterns:
        out = out.when(m.rlike(f"^(?:{p})$"), name)
    return out


def by_kind(x: Column, names: Iterable[str], value: Callable[[str], Column], otherwise: Column) -> Column:
    out = F.when(lit(False), otherwise)
    for name in names:
        out = out.when(x["kind"] == name, value(name))
    return out.otherwise(otherwise)


def item(pre: Column, m: Column, kind: Column, ok: Column) -> Column:
    return F.struct(pre.alias("pre"), m.alias("m"), kind.alias("kind"), ok.alias("ok"))


def with_items(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """rows plus __items: the text in order as structs of pre (what stays), new (a candidate's new text) and kind (null: not replaced).

    Each step is a projection of its own, so that no expression is repeated within another.  Kinds whose patterns reach over others are
    validated first: a valid one is its head and the rest after it, an invalid one is searched for the other kinds.
    """
    col, no, nothing = F.col("__items"), lit(False), lit(None).cast("string")
    ends = lambda c, p: F.zip_with(F.split(c, any_of(p), -1), F.array_append(F.regexp_extract_all(c, lit(any_of(p)), 0), ""), lambda a, m: item(a, m, matched(m, p), no))
    rows = rows.withColumn("__items", ends(text, PATTERNS))
    rows = rows.withColumn("__items", F.transform(col, lambda x: F.struct(x["pre"].alias("pre"), x["m"].alias("m"), x["kind"].alias("kind"), by_kind(x, ("iban", "card"), lambda n: RULES[n].head(x["m"]), x["m"]).alias("head"))))
    sure = lambda x: F.coalesce(by_kind(x, REACHING, lambda n: RULES[n].valid(x["head"]), no), no)
    rows = rows.withColumn("__items", F.transform(col, lambda x: F.struct(x["pre"].alias("pre"), x["m"].alias("m"), x["kind"].alias("kind"), x["head"].alias("head"), sure(x).alias("ok"))))
    valid = lambda x: F.array(item(x["pre"], x["head"], x["kind"], lit(True)), item(F.substr(x["m"], F.length(x["head"]) + 1), lit(""), nothing, no))
    inner = lambda x: F.concat(F.array(item(x["pre"], lit(""), nothing, no)), ends(x["m"], INNER))
    rows = rows.withColumn("__items", F.flatten(F.transform(col, lambda x: F.when(x["ok"], valid(x)).when(x["kind"].isin(*REACHING), inner(x)).otherwise(F.array(item(x["pre"], x["m"], x["kind"], no))))))
    rest = [n for n, _ in INNER]
    ok = lambda x: x["ok"] | F.coalesce(by_kind(x, rest, lambda n: RULES[n].valid(x["m"]), no), no)
    rows = rows.withColumn("__items", F.transform(col, lambda x: F.struct(x["pre"].alias("pre"), x["m"].alias("m"), F.when(ok(x), x["kind"]).alias("kind"))))
    spot = lambda x, i: by_kind(x, RULES, lambda n: RULES[n].places(x["m"])[i].cast("array<int>"), F.array().cast("array<int>"))
    rows = rows.withColumn("__items", F.transform(col, lambda x: F.struct(x["pre"].alias("pre"), x["m"].alias("m"), x["kind"].alias("kind"), spot(x, 0).alias("v"), spot(x, 1).alias("r"))))
    tag = lambda x: F.when(x["kind"] == "abroad", "phone").otherwise(x["kind"])
    rows = rows.withColumn("__items", F.transform(col, lambda x: F.struct(x["pre"].alias("pre"), x["m"].alias("m"), x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), feistel(x["v"], x["r"], tag(x), key)).alias("out"))))
    new = lambda x: by_kind(x, RULES, lambda n: RULES[n].written(x["m"], x["out"]), x["m"])
    return rows.withColumn("__items", F.transform(col, lambda x: F.struct(x["pre"].alias("pre"), new(x).alias("new"), tag(x).alias("kind"))))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", prefix: str = "n_") -> DataFrame:
    """docs with the text rewritten, plus one count for each kind (prefix + kind)."""
    text = F.col(f"__doc.`{text_col}`")
    work = with_items(docs.select(F.struct("*").alias("__doc")), F.when(text.rlike(CUE), text), key)
    new = F.coalesce(F.array_join(F.transform("__items", lambda x: F.concat(x["pre"], x["new"])), ""), text)
    count = lambda k: F.coalesce(F.size(F.filter("__items", lambda x: x["kind"] == k)), lit(0))
    counts = {f"{prefix}{k}": count(k) for k in KINDS}
    own = [(new if c == text_col else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns if c not in counts]
    return work.select(*own, *[F.greatest(n, lit(0)).cast("long").alias(c) for c, n in counts.items()])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text (rewritten), a count of each kind and n_pii."""
    out = pseudonymize(docs.select("doc_id", "text"), docs.sparkSession.conf.get("spark.latentia.pii.key", OPEN_KEY))
    return out.withColumn("n_pii", reduce(lambda a, b: a + b, [F.col(f"n_{k}") for k in KINDS]))
