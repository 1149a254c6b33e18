"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Validated card numbers, phone numbers, network addresses, social security numbers and dates
are written as a pair of residues (x mod a, y mod b) that covers exactly the valid values,
and the pair is permuted by Feistel rounds whose round function is a keyed hash: a valid
value becomes another valid value of the same format, equal values become equal pseudonyms
in every document, and no two values collide. Mail names and secret strings are permuted
character by character within their class by the same construction on halves.

Every row is rewritten alone: no shuffle, no lookup table.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.llm.columns import free, quoted

ROUNDS = 8
KEY_SETTING = "spark.braidlog.pii.key"
_KEYS: dict[str, str] = {}
#: Fixed patterns of the formats. Possessive repeats keep the scan linear on long texts.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,20})"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
PHONE = r"(?<![\d-])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
SECRET = r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,64}|(?:sk-|ghp_|AKIA)[A-Za-z0-9]{16,64})(?![A-Za-z0-9_-])"
#: Digit groups from 13 digits on that single blanks or hyphens join, up to a group that begins something of another kind.
_DOTTED = r"\d{3}(?:\.\d{3}[ .-]|[ -]\d{3}\.)\d{4}(?![\d-])"
RUN = rf"(?<!\d)(?=(?:\d[ -]?){{12}}\d)\d++(?:[ -](?!{MAIL}|{SECRET}|{ADDRESS}|{_DOTTED})\d++)*+"
ANY = "|".join((MAIL, SECRET, ADDRESS, PHONE, SOCIAL, DATE, RUN))
#: What stands beside cards in a run, and the groupings in which cards are usually written.
BESIDE = "|".join((PHONE, SOCIAL, DATE))
USUAL = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
#: Dates are permuted within their span: 200 * 365 days each from 1900-01-01 on, backwards too. The
#: calendar from 0001-01-01 to 9999-12-31 cuts the first and the last span short.
DATE_FIRST, DATE_SPAN, DATE_A, DATE_B = "0001-01-01", 73_000, 200, 365
DATE_HEAD, DATE_HEAD_A, DATE_HEAD_B = 36_595, 65, 563
DATE_TAIL, DATE_TAIL_A, DATE_TAIL_B = 3_613_595, 64, 601


def _hash(key: str, tag: str, turn: int, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(f"{key}|{tag}|{turn}"), *parts), 256), 1, 15), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_pair(x: Column, y: Column, a: int, b: int, key: str, tag: str) -> Column:
    """A keyed permutation of all pairs with 0 <= x < a and 0 <= y < b."""

    def turn(n: int) -> Callable[[Column], Column]:
        if n % 2:
            return lambda p: F.struct(p["x"].alias("x"), F.pmod(p["y"] + _hash(key, tag, n, p["x"].cast("string")), F.lit(b)).alias("y"))
        return lambda p: F.struct(F.pmod(p["x"] + _hash(key, tag, n, p["y"].cast("string")), F.lit(a)).alias("x"), p["y"].alias("y"))

    pair = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    for n in range(ROUNDS):
        pair = _let(pair, turn(n))
    return pair


def _pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """Put new digits into the places of the old ones."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), r"\D", ""))
    chars = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, seen(i), F.lit(1))).otherwise(c))
    return F.array_join(chars, "")


def luhn_sum(digits: Column) -> Column:
    """Checksum of a digit string, its last digit not doubled."""
    values = F.reverse(F.split(digits, ""))

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["odd"], 2).otherwise(1)
        return F.struct((acc["n"] + d - F.when(d > 9, 9).otherwise(0)).alias("n"), (~acc["odd"]).alias("odd"))

    return F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(False).alias("odd")), add, lambda a: a["n"])


def _card(text: Column, key: str) -> Column:
    """Valid cards of 13 to 19 digits: the digits before the check digit are permuted and a new one is set."""

    def change(digits: Column) -> Column:
        def by_size(n: int) -> Column:
            left = (n - 1) // 2
            pair = permute_pair(F.substring(digits, 1, left).cast("long"), F.substring(digits, left + 1, n - 1 - left).cast("long"), 10**left, 10 ** (n - 1 - left), key, f"card{n}")
            body = _let(pair, lambda p: F.concat(_pad(p["x"], left), _pad(p["y"], n - 1 - left)))
            return _let(body, lambda s: F.concat(s, F.pmod(10 - luhn_sum(F.concat(s, F.lit("0"))) % 10, F.lit(10)).cast("string")))

        out = F.lit(None).cast("string")
        for n in range(13, 20):
            out = F.when(F.length(digits) == n, by_size(n)).otherwise(out)
        return out

    digits = F.regexp_replace(text, r"\D", "")
    return F.when(luhn_sum(digits) % 10 == 0, _refill(text, _let(digits, change)))


def _cards(run: Column) -> Column:
    """``(start, size)`` of the cards of a run, in order: whole groups of 13 to 19 digits that pass the checksum.

    Of overlapping ones the usual groupings go first, then the most digits, then the leftmost.
    """

    def of(groups: Column) -> Column:
        def at(i: Column, w: Column) -> Column:
            text = F.regexp_replace(F.array_join(F.slice(groups, i + 1, w), ""), r"\D$", "")
            return F.struct((~text.rlike(USUAL)).alias("odd"), (-F.length(F.regexp_replace(text, r"\D", ""))).alias("less"), i.alias("i"), w.alias("w"), text.alias("text"))

        every = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), lambda w: at(i, w)))
        valid = F.filter(F.flatten(every), lambda x: x["less"].between(-19, -13) & (luhn_sum(F.regexp_replace(x["text"], r"\D", "")) % 10 == 0))
        first = lambda i: F.length(F.array_join(F.slice(groups, F.lit(1), i), "")) + 1
        short = F.transform(F.array_sort(valid), lambda x: F.struct(first(x["i"]).alias("start"), F.length(x["text"]).alias("size")))
        meets = lambda x, y: (x["start"] < y["start"] + y["size"]) & (y["start"] < x["start"] + x["size"])
        add = lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x)))
        return F.array_sort(F.aggregate(short, F.array().cast("array<struct<start:int,size:int>>"), add))

    return _let(F.regexp_extract_all(run, F.lit(r"\d+[ -]?"), F.lit(0)), of)


def _pieces(found: Column) -> Column:
    """``(text, own)`` pieces of one found string: a run is cut into cards, what else is found beside them, and the rest."""
    piece = lambda text, own: F.struct(text.alias("text"), F.lit(own).alias("own"))

    def beside(gap: Column) -> Column:
        others = F.concat(F.regexp_extract_all(gap, F.lit(BESIDE), F.lit(0)), F.array(F.lit("")))
        return F.flatten(F.zip_with(F.split(gap, BESIDE, -1), others, lambda g, o: F.array(piece(g, False), piece(o, True))))

    def cut(cards: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            gap = F.substring(found, acc["at"], c["start"] - acc["at"])
            return F.struct((c["start"] + c["size"]).alias("at"), F.concat(acc["out"], beside(gap), F.array(piece(F.substring(found, c["start"], c["size"]), True))).alias("out"))

        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,own:boolean>>").alias("out"))
        return F.aggregate(cards, start, add, lambda acc: F.concat(acc["out"], beside(F.substring(found, acc["at"], F.length(found)))))

    run = found.rlike(r"^\d[\d -]*$") & ~found.rlike(f"^(?:{SECRET}|{BESIDE})$")
    return F.when(run, _let(_cards(found), cut)).otherwise(F.array(piece(found, True)))


def _phone(text: Column, key: str) -> Column:
    """The last ten digits; area and exchange codes stay valid (200 to 999) where they were."""

    def change(d: Column) -> Column:
        area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
        good = _let(permute_pair(area - 200, rest - 2_000_000, 800, 8_000_000, key, "phone"), lambda p: F.concat(_pad(p["x"] + 200, 3), _pad(p["y"] + 2_000_000, 7)))
        odd = _let(permute_pair(area, rest, 1000, 10_000_000, key, "digits"), lambda p: F.concat(_pad(p["x"], 3), _pad(p["y"], 7)))
        return F.when((area >= 200) & (rest >= 2_000_000), good).otherwise(odd)

    digits = F.regexp_replace(text, r"\D", "")
    return _refill(text, F.concat(F.when(F.length(digits) > 10, "1").otherwise(""), _let(F.substring(digits, -10, 10), change)))


def _address(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda c: c.cast("long"))

    def change(p: Column) -> Column:
        pair = permute_pair(F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), 1 << 16, 1 << 16, key, "address")
        return _let(pair, lambda q: F.concat_ws(".", *[(F.floor(q[c] / 256) if high else q[c] % 256).cast("string") for c in "xy" for high in (True, False)]))

    return F.when(F.forall(parts, lambda v: v < 256), _let(parts, change))


def _social(text: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substring(text, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = area - F.when(area > 666, 2).otherwise(1)
    pair = permute_pair(x, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "social")
    back = lambda p: F.concat_ws("-", _pad(p["x"] + F.when(p["x"] >= 665, 2).otherwise(1), 3), _pad(F.floor(p["y"] / 9999) + 1, 2), _pad(p["y"] % 9999 + 1, 4))
    return F.when(valid, _let(pair, back))


def _date(text: Column, key: str) -> Column:
    """Every date from 0001-01-01 to 9999-12-31 becomes another date of its span."""
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(DATE_FIRST).cast("date")).cast("long")

    def change(d: Column) -> Column:
        def within(first: Column, a: int, b: int, tag: str) -> Column:
            return _let(permute_pair(F.floor((d - first) / b), (d - first) % b, a, b, key, tag), lambda p: first + p["x"] * b + p["y"])

        first = d - F.pmod(d - DATE_HEAD, F.lit(DATE_SPAN))
        moved = (
            F.when(d < DATE_HEAD, within(F.lit(0).cast("long"), DATE_HEAD_A, DATE_HEAD_B, "date-head"))
            .when(d >= DATE_TAIL, within(F.lit(DATE_TAIL).cast("long"), DATE_TAIL_A, DATE_TAIL_B, "date-tail"))
            .otherwise(within(first, DATE_A, DATE_B, "date"))
        )
        return F.date_format(F.date_add(F.lit(DATE_FIRST).cast("date"), moved.cast("int")), "yyyy-MM-dd")

    return F.when(day.between(0, DATE_TAIL + DATE_TAIL_A * DATE_TAIL_B - 1), _let(day, change))


def _shift(half: Column, stream: Column, hexadecimal: bool) -> Column:
    """Move every character within its class by its own part of a hash stream."""
    classes = (("0", 10), ("a", 6)) if hexadecimal else (("0", 10), ("a", 26), ("A", 26))

    def move(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(stream, F.pmod(i, F.lit(30)) * 2 + 1, F.lit(3)), 16, 10).cast("int")
        out = c
        for first, size in classes:
            code = F.ascii(c) - ord(first)
            out = F.when(code.between(0, size - 1), F.char(ord(first) + F.pmod(code + step + i, F.lit(size)))).otherwise(out)
        return out

    return F.when(F.length(half) > 0, F.array_join(F.transform(F.split(half, ""), move), "")).otherwise("")


def permute_text(text: Column, key: str, tag: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of strings that keeps the length and each character's class."""
    cut = F.floor(F.length(text) / 2).cast("int")
    pair = F.struct(F.substring(text, F.lit(1), cut).alias("x"), F.substring(text, cut + 1, F.length(text)).alias("y"))

    def turn(n: int) -> Callable[[Column], Column]:
        stream = lambda half: F.sha2(F.concat_ws("|", F.lit(f"{key}|{tag}|{n}"), half), 256)
        if n % 2:
            return lambda p: F.struct(p["x"].alias("x"), _shift(p["y"], stream(p["x"]), hexadecimal).alias("y"))
        return lambda p: F.struct(_shift(p["x"], stream(p["y"]), hexadecimal).alias("x"), p["y"].alias("y"))

    for n in range(4):
        pair = _let(pair, turn(n))
    return _let(pair, lambda p: F.concat(p["x"], p["y"]))


def _mail(text: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(text, "@", 1), key, "mail"), F.lit("@"), F.substring_index(text, "@", -1))


def _secret(text: Column, key: str) -> Column:
    prefix = F.regexp_extract(text, r"^(sk-|ghp_|AKIA)", 1)
    other = F.concat(prefix, permute_text(F.substring(text, F.length(prefix) + 1, F.length(text)), key, "secret"))
    return F.when(text.rlike("^[0-9a-f]+$"), permute_text(text, key, "hex", True)).otherwise(other)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found string; itself where its format does not validate."""
    whole = lambda p: found.rlike(f"^(?:{p})$")
    new = (
        F.when(F.contains(found, F.lit("@")), _mail(found, key))
        .when(whole(ADDRESS), _address(found, key))
        .when(whole(PHONE), _phone(found, key))
        .when(whole(SOCIAL), _social(found, key))
        .when(whole(DATE), _date(found, key))
        .when(whole(SECRET), _secret(found, key))
        .when(whole(CARD), _card(found, key))
    )
    return F.coalesce(new, found)


def session_key(spark: SparkSession) -> str:
    """The key in ``spark.braidlog.pii.key``; where it is unset, a random one of this application.

    With a key of its own every application makes pseudonyms of its own; set the key to link
    values over several runs, and keep it: whoever has it can undo the permutations.
    """
    app = spark.sparkContext.applicationId
    return spark.conf.get(KEY_SETTING, None) or _KEYS.setdefault(app, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced.

    ``count_col`` gets the number replaced, ``length_col`` the new length in code points.

    A null text stays null, an empty one empty; numbers that fail their check (card
    checksum, address range, calendar, social security areas) are left as they are. Rows
    are independent, so null ids are rows like others and repeated rows give equal results;
    an empty table gives an empty result; other columns pass through, whatever their names.
    The two counting columns replace columns of their names.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    own, found, made = quoted(text_col), free("found", docs.columns), free("made", docs.columns)

    def renew(value: Column) -> Column:
        new = F.transform(_pieces(value), lambda p: F.struct(p["text"].alias("old"), F.when(p["own"], pseudonym(p["text"], key)).otherwise(p["text"]).alias("new")))
        return _let(new, lambda ps: F.struct(F.array_join(ps["new"], "").alias("text"), F.size(F.filter(ps, lambda p: p["old"] != p["new"])).alias("n")))

    df = docs.withColumn(found, F.regexp_extract_all(own, F.lit(ANY), F.lit(0)))
    df = df.withColumn(made, F.when(F.size(found) > 0, F.transform(found, renew)))
    gaps = F.split(own, ANY, -1)
    parts = F.zip_with(gaps, F.col(made)["text"], lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    changed = F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(own)
    out = {text_col: changed}
    if length_col:
        out[length_col] = F.length(changed).cast("long")
    if count_col:
        total = F.aggregate(F.col(made)["n"], F.lit(0), lambda a, n: a + n)
        out[count_col] = F.when(F.size(found) > 0, total).otherwise(0).cast("long")
    return df.withColumns(out).drop(found, made)
