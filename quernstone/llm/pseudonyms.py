"""Format-preserving pseudonyms for personal data, in SQL functions only.

Numbers and dates that are valid for their kind are permuted within their format by a Feistel network whose round
function is a keyed SHA-256, so a value gets the same pseudonym in every document, different values of a format get
different ones, and `restore` undoes it for whoever holds the key. The key has no default; it comes into the rows as a scalar
subquery, so plans and event logs don't show it.

Kinds: e-mail addresses (the local part goes through the same kind of network: each half's letters and digits are
shifted within their alphabets by a keyed hash of the other half, so addresses that begin alike don't stay alike; capitals stay
capitals and don't change the hash, so Ann@ and ann@ stay linked), IBANs (in one piece or in groups of four, with a valid
remainder modulo 97, as pseudonyms have; the country stays), IPv4 addresses (each part at most
255), payment card numbers (13 to 19 digits in one piece or in groups, with a valid Luhn sum, as pseudonyms have), social
security numbers (no area of 000, 666 or 9xx, group 00 or serial 0000), telephone numbers (a plus and 8 to 15 digits with
any or no separators, area codes in brackets or set off, runs of 8 to 12 digits; a country code or a leading zero stays; a lone run
of digits is none if it writes a day, as 20231105, or a second of 2001 to 2033, as 1700000000)
and dates (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy; real days of 1900 to 2099 only). What has the form of a
kind but isn't valid stays as it is.

Nulls: a null text stays null with no findings; a null doc_id is kept. Empty texts, texts without personal data
and everything between the findings come back as they are. Overlapping kinds: the leftmost match, then the
kind listed first. Repeated rows are separate and get equal pseudonyms. An empty table gives no rows. The column of
findings is called `found`, with underscores if the rows have a column of that name. Signs and letters of other
alphabets than ALPHABETS stay in e-mail addresses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS, WALKS = 8, 24
# What each kind looks like.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "date": r"(?<![\d./-])(?:(?:19|20)\d\d(?<ymd>[-/])(?:0[1-9]|1[0-2])\k<ymd>(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?<dmy>[./])(?:0[1-9]|1[0-2])\k<dmy>(?:19|20)\d\d)(?![\d]|[./-]\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z\d]{11,30}|(?: [A-Z\d]{4}){2,7}(?: [A-Z\d]{1,3})?)(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)",
    "card": r"(?<![\d])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}(?<wide>[ -])\d{6}\k<wide>\d{4,5})(?![\d])",
    "phone": r"(?<![\p{L}\d])(?:"
    r"\+(?:\d{8,15}|1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}|\d(?:(?:[ ./-]|[ .-]?\(|\)[ .-]?)?\d){7,14})"
    r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}"
    r"|\(\d{2,5}\)(?:[ .-]?\d){4,11}"
    r"|0\d{1,4}[ ./-]\d{5,9}"
    r"|0\d(?<pair>[ .-])\d{2}\k<pair>\d{2}\k<pair>\d{2}\k<pair>\d{2}"
    r"|(?<!\d[.,]|_)\d{8,12}(?![\p{L}_]|[.,]\d)"
    r")(?![\d])",
}
# Codes of one and two digits; all others have three.
COUNTRY = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
# All kinds but e-mail addresses and IBANs begin with a digit, a plus or a bracket.
LETTERED = ("email", "iban")
ANY = "|".join(KINDS[k] for k in LETTERED) + "|(?=[\\d+(])(?:" + "|".join(p for k, p in KINDS.items() if k not in LETTERED) + ")"


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _draw(key: Column, kind: str, nth: Column, half: Column, modulus: Column) -> Column:
    """A number below the modulus from a keyed hash of the other half."""
    digest = F.sha2(F.concat_ws(":", key, F.lit(kind), nth.cast("string"), half.cast("string"), modulus.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: Column, kind: str, back: bool = False) -> Column:
    """A struct (l, r) of the permuted halves, or of those that were permuted; an even number of rounds leaves each half its own size."""
    start = F.struct(left.alias("l"), right.alias("r"), left_size.alias("ls"), right_size.alias("rs"))

    def turn(at: Column, nth: Column) -> Column:
        moved = F.pmod(at["l"] + _draw(key, kind, nth, at["r"], at["ls"]), at["ls"])
        return F.struct(at["r"].alias("l"), moved.alias("r"), at["rs"].alias("ls"), at["ls"].alias("rs"))

    def turn_back(at: Column, nth: Column) -> Column:
        moved = F.pmod(at["r"] - _draw(key, kind, nth, at["l"], at["rs"]), at["rs"])
        return F.struct(moved.alias("l"), at["l"].alias("r"), at["rs"].alias("ls"), at["ls"].alias("rs"))

    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, turn_back if back else turn)


def permute_digits(digits: Column, key: Column, kind: str, back: bool = False) -> Column:
    """A string of digits to another of the same length (2 to 36 digits; a lone digit is shifted)."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    rest = n - half
    done = feistel(
        F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, rest).cast("long"), _power(half), _power(rest), key, kind, back
    )
    shift = _draw(key, kind, F.lit(0), F.lit(0), F.lit(10).cast("long"))
    lone = F.pmod(digits.cast("long") + (-shift if back else shift), F.lit(10)).cast("string")
    return F.when(n < 2, lone).otherwise(
        F.transform(F.array(F.struct(done.alias("d"), half.alias("h"), rest.alias("k"))), lambda x: F.concat(F.lpad(x["d"]["l"].cast("string"), x["h"], "0"), F.lpad(x["d"]["r"].cast("string"), x["k"], "0")))[0]
    )


def walk(start: Column, step: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
    """Take a step, and further ones while the result isn't good (cycle walking); the good values are permuted among themselves."""
    return F.aggregate(F.array(*[F.lit(i) for i in range(WALKS)]), start, lambda at, nth: F.when((nth > 0) & good(at), at).otherwise(step(at)))


def refill(found: Column, digits: Column, sign: str = "[0-9]") -> Column:
    """The digits, or other signs, put in turn in the places where the found string has such."""
    return F.array_join(F.zip_with(F.split(found, sign, -1), F.split(digits, "(?!^)(?!$)"), lambda gap, digit: F.concat(gap, F.coalesce(digit, F.lit("")))), "")


def luhn(digits: Column) -> Column:
    """The remainder modulo 10 of the Luhn sum; 0 for valid numbers."""
    backwards = F.split(F.reverse(digits), "(?!^)(?!$)")
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _card(found: Column, key: Column, back: bool) -> Column:
    """The last digit is the one that makes the Luhn sum valid."""
    body = permute_digits(F.substr(_digits(found), F.lit(1), F.length(_digits(found)) - 1), key, "card", back)
    return refill(found, F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0])


def _good_ssn(digits: Column) -> Column:
    return ~digits.rlike("^(?:000|666|9)|^...00|0000$")


def _ssn(found: Column, key: Column, back: bool) -> Column:
    return refill(found, walk(_digits(found), lambda d: permute_digits(d, key, "ssn", back), _good_ssn))


def _stamp(found: Column) -> Column:
    """Whether a run of digits writes a real day of 1900 to 2099 or a second of 2001 to 2033."""
    day = F.when(found.rlike(r"^(?:19|20)\d{6}$"), F.try_to_date(found, "yyyyMMdd"))
    return day.isNotNull() | found.rlike(r"^1\d{9}$")


def _phone(found: Column, key: Column, back: bool) -> Column:
    """The country code is what stands before the first separator, or what the plus and the first digits say. Other numbers keep a leading zero or none.

    A lone run doesn't become a day or a second, which wouldn't be found again.
    """
    code = F.regexp_extract(found, rf"^(?:\+(?:\d{{1,3}}(?=[ .(/-])|{COUNTRY}|\d{{3}})|\(?0)", 0)
    rest = F.substr(found, F.length(code) + 1, F.length(found))
    moved = walk(_digits(rest), lambda d: permute_digits(d, key, "phone", back), lambda d: (code != "") | ~(d.startswith("0") | found.rlike("^[0-9]+$") & _stamp(d)))
    return F.concat(code, refill(rest, moved))


def _ip(found: Column, key: Column, back: bool) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: p.cast("long"))
    wide = F.lit(65536).cast("long")
    done = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], wide, wide, key, "ip", back)
    return F.transform(F.array(done), lambda d: F.concat_ws(".", (d["l"] / 256).cast("long"), d["l"] % 256, (d["r"] / 256).cast("long"), d["r"] % 256))[0]


DAYS, SIDE = 73_049, 271  # days of 1900 to 2099; a square that holds them


def _day(found: Column) -> Column:
    """The date that is written, null if there is no such day."""
    iso = F.when(found.rlike(r"^\d{4}"), F.translate(found, "/", "-")).otherwise(F.concat_ws("-", F.substring(found, 7, 4), F.substring(found, 4, 2), F.substring(found, 1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def _date(found: Column, key: Column, back: bool) -> Column:
    """Permute the day's number among those of all days."""
    pattern = F.when(found.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(found.rlike(r"^\d{4}/"), "yyyy/MM/dd").when(found.contains("."), "dd.MM.yyyy").otherwise("dd/MM/yyyy")
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(_day(found), first).cast("long")
    side = F.lit(SIDE).cast("long")

    def step(at: Column) -> Column:
        return F.transform(F.array(feistel((at / SIDE).cast("long"), at % SIDE, side, side, key, "date", back)), lambda d: d["l"] * SIDE + d["r"])[0]

    moved = walk(day, step, lambda at: at < DAYS)
    return F.transform(F.array(F.date_add(first, moved.cast("int")).cast("string")), lambda d: F.when(pattern == "yyyy-MM-dd", d)
        .when(pattern == "yyyy/MM/dd", F.translate(d, "-", "/"))
        .when(pattern == "dd.MM.yyyy", F.concat_ws(".", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4)))
        .otherwise(F.concat_ws("/", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4))))[0]


# First and last letters of alphabets whose code points follow each other.
ALPHABETS = ("az", "AZ", "09", "àö", "øþ", "ÀÖ", "ØÞ", "αω", "ΑΡ", "ая", "АЯ", "את", "ぁゖ", "ァヺ", "一鿿", "가힣")


def _shifted(letter: Column, shift: Column, alphabets: tuple[str, ...]) -> Column:
    """A letter moved on within its alphabet; others stay."""
    code, ranges = F.ascii(letter), F.expr(f"array({', '.join(f'struct({ord(a)} AS f, {ord(z)} AS l)' for a, z in alphabets)})")

    def moved(own: Column) -> Column:
        place = F.pmod(code - own["f"] + shift, own["l"] - own["f"] + 1) + own["f"]
        return F.decode(F.unhex(F.lpad(F.hex(place), 4, "0")), "UTF-16BE")

    return F.coalesce(F.try_element_at(F.transform(F.filter(ranges, lambda own: code.between(own["f"], own["l"])), moved), F.lit(1)), letter)


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _moved(half: Column, other: Column, tweak: Column, key: Column, kind: str, nth: Column, back: bool, alphabets: tuple[str, ...]) -> Column:
    """The characters of one half, each shifted by a number drawn from the other half and its own place."""
    seed = F.sha2(F.concat_ws(":", key, F.lit(kind), nth.cast("string"), tweak, F.lower(other)), 256)

    def shifted(seed: Column, letter: Column, i: Column) -> Column:
        shift = F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
        return _shifted(letter, -shift if back else shift, alphabets)

    return F.transform(F.array(seed), lambda s: F.array_join(F.transform(_letters(half), lambda c, i: shifted(s, c, i)), ""))[0]


def permute_letters(text: Column, tweak: Column, key: Column, kind: str, back: bool = False, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """A string to another whose characters have the same alphabets in the same places: a network over its two halves."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def turn(at: Column, nth: Column) -> Column:
        return F.struct(at["r"].alias("l"), _moved(at["l"], at["r"], tweak, key, kind, nth, back, alphabets).alias("r"))

    def turn_back(at: Column, nth: Column) -> Column:
        return F.struct(_moved(at["r"], at["l"], tweak, key, kind, nth, back, alphabets).alias("l"), at["l"].alias("r"))

    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, turn_back if back else turn, lambda at: F.concat(at["l"], at["r"]))


def _email(found: Column, key: Column, back: bool) -> Column:
    """The local part is permuted; the hash takes in its length and the domain, too."""
    local, domain = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    return F.concat(permute_letters(local, F.concat_ws("@", F.length(local).cast("string"), F.lower(domain)), key, "email", back), F.lit("@"), domain)


def mod97(signs: Column) -> Column:
    """The remainder modulo 97 of digits and capitals, A being 10 and Z 35."""
    return F.aggregate(_letters(signs), F.lit(0), lambda at, c: F.when(c.between("0", "9"), at * 10 + F.ascii(c) - 48).otherwise(at * 100 + F.ascii(c) - 55) % 97)


def _bare(found: Column) -> Column:
    return F.replace(found, F.lit(" "), F.lit(""))


def _good_iban(found: Column) -> Column:
    bare = _bare(found)
    return F.substring(bare, 3, 2).between("02", "98") & (mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def _iban(found: Column, key: Column, back: bool) -> Column:
    """The country stays, the account is permuted, the check digits are those that make the remainder 1."""
    bare = _bare(found)
    land, account = F.substring(bare, 1, 2), F.substr(bare, F.lit(5), F.length(bare))
    new = permute_letters(account, land, key, "iban", back, ("AZ", "09"))
    whole = F.transform(F.array(new), lambda n: F.concat(land, F.lpad((98 - mod97(F.concat(n, land, F.lit("00")))).cast("string"), 2, "0"), n))[0]
    return refill(found, whole, "[A-Z0-9]")


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
VALID = {
    "date": lambda found: _day(found).isNotNull(),
    "card": lambda found: luhn(_digits(found)) == 0,
    "ssn": lambda found: _good_ssn(_digits(found)),
    "iban": _good_iban,
    "phone": lambda found: ~_stamp(found),
}


def kind_of(found: Column) -> Column:
    """The first kind whose form the found string has, null if it isn't valid for it."""
    chosen = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        named = F.when(VALID[kind](found), kind) if kind in VALID else F.lit(kind)
        chosen = F.when(found.rlike(f"^(?:{pattern})$"), named).otherwise(chosen)
    return chosen


def pseudonym(found: Column, key: Column, back: bool = False) -> Column:
    """A found string to its pseudonym, or back, by its kind; what is of no kind stays."""
    kind = kind_of(found)
    out = found
    for name, maker in MAKERS.items():
        out = F.when(kind == name, maker(found, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, column: str = "text", back: bool = False) -> DataFrame:
    """The documents with personal data replaced, and an array of (kind, pseudonym), called found or a free name like it."""
    if not key:
        raise ValueError("pseudonyms need a key")
    whole, name, secret = F.col(column), free_name(docs, "found"), free_name(docs, "key")
    kept = docs.columns
    docs = docs.withColumn(secret, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    matches = F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0)))  # every kind has one of these
    new = F.transform(matches, lambda m: F.struct(kind_of(m).alias("kind"), pseudonym(m, F.col(secret), back).alias("pseudonym")))
    named = docs.withColumn(name, F.coalesce(new, F.array().cast("array<struct<kind:string,pseudonym:string>>")))
    gaps = F.split(whole, ANY, -1)
    text = F.array_join(F.zip_with(gaps, F.col(f"{name}.pseudonym"), lambda gap, own: F.concat(gap, F.coalesce(own, F.lit("")))), "")
    changed = named.withColumn(column, F.when(F.size(name) > 0, text).otherwise(whole))
    return changed.select(*kept, F.filter(name, lambda f: f["kind"].isNotNull()).alias(name))


def restore(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The documents with pseudonyms undone, under the same key."""
    done = pseudonymise(docs, key, column, back=True)
    return done.select(*docs.columns)
