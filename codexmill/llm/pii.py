"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Numbers, dates, addresses and keys that pass their own validity test are replaced by a
keyed permutation within their format: a card stays a valid card of its length, a date a
date in its notation, an IPv4 address an IPv4 address. The permutation depends on the key
and the kind only, so equal values have equal pseudonyms in all documents, and different
values have different ones.

Strings (phone and card digits, names in mail addresses, hexadecimal keys) are split into
halves; in each round the characters of one half are shifted, each within its own alphabet,
by a key stream drawn from SHA-256 over key, kind, round and the other half. Numbers
(addresses, dates) are pairs of residues treated alike. No Python runs on executors.

Not looked for: names and postal addresses, phone numbers without a country code but for those of
North America, IPv6 addresses, bank account numbers, and keys without one of the known beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEMO_KEY = "codexmill-demo-key"

KINDS = ("secret", "email", "ipv4", "ssn", "date", "phone", "card")

_NOT_BEFORE, _NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Each pattern matches whole candidates; validity beyond the pattern is tested in _valid.
PATTERNS = {
    "secret": rf"{_NOT_BEFORE}(?:[0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}}|[0-9A-F]{{64}}|[0-9A-F]{{40}}|[0-9A-F]{{32}}|A[KS]IA[0-9A-Z]{{16}}|sk-[0-9A-Za-z]{{20,64}}|ghp_[0-9A-Za-z]{{36}}){_NOT_AFTER}",
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,24}",
    "ipv4": rf"(?<![\p{{L}}\p{{N}}_.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}_])(?!\.\d)",
    "ssn": rf"(?<![\p{{L}}\p{{N}}_-])\d{{3}}-\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}_-])",
    "date": rf"{_NOT_BEFORE}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{4}}){_NOT_AFTER}",
    "phone": rf"\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]?\d{{4}}{_NOT_AFTER}|\+\d{{8,15}}{_NOT_AFTER}|(?<![\p{{L}}\p{{N}}_.+-])(?:1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[.-])[2-9]\d\d[.-]\d{{4}}(?![\p{{L}}\p{{N}}_-])",
    "card": rf"{_NOT_BEFORE}(?:\d{{13,19}}|\d{{4}}(?: \d{{4}}){{3}}|\d{{4}}(?:-\d{{4}}){{3}}|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}}){_NOT_AFTER}",
}
PATTERN = "|".join(PATTERNS[k] for k in KINDS)

# Country calling codes of one and two digits; all others have three.
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Fixed value: the numbers of North America.
NORTH_AMERICAN = "^[2-9][0-9]{2}[2-9][0-9]{6}$"
#: Fixed beginnings of keys, which stay as they are.
KEY_START = "^(?:A[KS]IA|sk-|ghp_)"
#: Letters beyond ASCII move among those of their sort in an aligned block of so many code points.
LETTER_BLOCK = 32

#: Dates are numbered from the first day; the count of days is the product of the two residues.
FIRST_DAY, DATE_A, DATE_B = "1900-01-01", 270, 271


def _hash(key: str, kind: str, rnd: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), rnd.cast("string"), other.cast("string")), 256)


def _byte(hexes: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a string of hexadecimal digits."""
    return F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    """The characters (whole code points) of a string."""
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _sort_of(c: Column) -> Column:
    """Capital, small or other letter, or number; null for all else."""
    return F.when(c.rlike(r"^\p{Lu}$"), "u").when(c.rlike(r"^\p{Ll}$"), "l").when(c.rlike(r"^\p{L}$"), "o").when(c.rlike(r"^\p{N}$"), "n")


def _turned(c: Column, code: Column, by: Column) -> Column:
    """A character beyond ASCII moved among those of its block and sort; one of no sort stays."""
    first = code - code % LETTER_BLOCK
    block = F.transform(F.sequence(first, first + LETTER_BLOCK - 1), _char)
    alphabet = F.filter(block, lambda x: _sort_of(x) == _sort_of(c))
    return F.coalesce(_with(alphabet, lambda a: F.get(a, F.pmod((F.array_position(a, c) - 1 + by).cast("int"), F.nullif(F.size(a), F.lit(0))))), c)


def _shift(c: Column, by: Column, hexadecimal: bool) -> Column:
    """One character moved within its alphabet: digits, a-z, A-Z, and letters or numbers of one sort in a block beyond ASCII; marks stay."""
    code = F.ascii(c)

    def turn(first: str, size: int) -> Column:
        return F.chr(F.pmod(code - ord(first) + by, F.lit(size)) + ord(first))

    if hexadecimal:
        def digit(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(16)) + 1, F.lit(1))

        upper = c.rlike("[A-F]")
        return F.when(upper, digit("0123456789ABCDEF")).otherwise(digit("0123456789abcdef"))
    return (
        F.when(c.rlike("^[0-9]$"), turn("0", 10)).when(c.rlike("^[a-z]$"), turn("a", 26))
        .when(c.rlike("^[A-Z]$"), turn("A", 26)).when(code >= 128, _turned(c, code, by)).otherwise(c)
    )


def permuted(text: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """The string with its characters permuted by a Feistel network.

    A single character has no halves: it moves by a keyed step that is never zero.
    """
    half = F.floor(F.length(text) / 2).cast("int")

    def one(state: Column, rnd: Column) -> Column:
        left, right = state["l"], state["r"]
        seed = F.concat_ws(":", F.length(left), right)
        turned = F.transform(_chars(left), lambda c, i: _shift(c, _byte(_hash(key, kind, rnd, seed), i % 32), hexadecimal))
        return F.struct(right.alias("l"), F.array_join(turned, "").alias("r"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: F.concat(s["l"], s["r"]))
    step = _byte(_hash(key, kind, F.lit(0), F.lit("single")), F.lit(0)) % 9 + 1
    return F.when(F.length(text) == 1, _shift(text, step, hexadecimal)).otherwise(whole)


def permuted_pair(a: Column, b: Column, mod_a: int, mod_b: int, key: str, kind: str) -> Column:
    """Residues (a, b) permuted within Z_mod_a x Z_mod_b, as a struct."""

    def draw(rnd: Column, other: Column) -> Column:
        return F.conv(F.substring(_hash(key, kind, rnd, other), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def one(state: Column, rnd: Column) -> Column:
        x, y = state["a"], state["b"]
        return F.when(
            rnd % 2 == 1, F.struct(F.pmod(x + draw(rnd, y), F.lit(mod_a).cast("long")).alias("a"), y.alias("b"))
        ).otherwise(F.struct(x.alias("a"), F.pmod(y + draw(rnd, x), F.lit(mod_b).cast("long")).alias("b")))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one)


def _luhn(digits: Column, offset: int) -> Column:
    """Luhn sum of a string of digits; offset 0 if its last digit is the check digit, else 1."""

    def add(total: Column, c: Column, i: Column) -> Column:
        twice = (i + offset) % 2 == 1
        v = c.cast("int")
        return total + F.when(twice, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)

    items = _chars(F.reverse(digits))
    indexed = F.transform(items, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(indexed, F.lit(0), lambda total, x: add(total, x["c"], x["i"]))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    items = _chars(shape)
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))

    def one(state: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["s"], F.when(digit, F.substring(digits, state["n"] + 1, F.lit(1))).otherwise(c)).alias("s"),
            (state["n"] + F.when(digit, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(items, start, one, lambda s: s["s"])


def _dotted(m: Column) -> Column:
    return F.regexp_replace(m, "/", ".")


def _month_first(m: Column) -> Column:
    """Slashed dates are read as day/month, and as month/day where that gives no day."""
    return m.contains("/") & F.try_to_date(_dotted(m), "dd.MM.yyyy").isNull()


def _day(m: Column) -> Column:
    """The date of a match, or null if there is no such day."""
    other = F.when(_month_first(m), F.try_to_date(_dotted(m), "MM.dd.yyyy")).otherwise(F.try_to_date(_dotted(m), "dd.MM.yyyy"))
    return F.when(m.rlike("^[0-9]{4}-"), F.try_to_date(m, "yyyy-MM-dd")).otherwise(other)


def _day_number(m: Column) -> Column:
    return F.datediff(_day(m), F.lit(FIRST_DAY).cast("date"))


def _kind(m: Column) -> Column:
    """The kind of a candidate if it is valid, else null."""
    only = F.regexp_replace(m, "[^0-9]", "")
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    valid = {
        "secret": m.rlike("[0-9]") & m.rlike("[A-Fa-f]"),
        "email": F.length(F.substring_index(m, "@", 1)) <= 64,
        "ipv4": F.lit(True),
        "ssn": ~m.rlike("^(?:000|666|9..)") & ~m.rlike("-00-") & ~m.rlike("-0000$"),
        "date": _day_number(m).between(0, DATE_A * DATE_B - 1),
        "phone": F.length(only).between(8, 15),
        "card": _luhn(only, 0) % 10 == 0,
    }
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(whole[k], F.when(valid[k], F.lit(k))).otherwise(out)
    return out


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _address(m: Column, key: str) -> Column:
    octet = [F.get(F.split(m, "[.]"), F.lit(i)).cast("long") for i in range(4)]
    moved = permuted_pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536, key, "ipv4")
    return _with(moved, lambda p: F.concat_ws(".", *[x.cast("string") for v in (p["a"], p["b"]) for x in (F.shiftright(v, 8), v % 256)]))


def _social(m: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area = F.substring(m, 1, 3).cast("long")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1

    def shown(p: Column) -> Column:
        parts = (F.when(p["a"] > 664, p["a"] + 2).otherwise(p["a"] + 1), 3), (F.floor(p["b"] / 9999) + 1, 2), (p["b"] % 9999 + 1, 4)
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])

    return _with(permuted_pair(place, rest, 898, 99 * 9999, key, "ssn"), shown)


def _date(m: Column, key: str) -> Column:
    number = _day_number(m).cast("long")
    moved = permuted_pair(F.floor(number / DATE_B), number % DATE_B, DATE_A, DATE_B, key, "date")

    def shown(p: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DATE_B + p["b"]).cast("int"))
        slashed = F.when(_month_first(m), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
        return F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(m.contains("/"), slashed).otherwise(F.date_format(day, "dd.MM.yyyy"))

    return _with(moved, shown)


def _north_american(national: Column, key: str) -> Column:
    """Ten digits of which the area and the exchange begin with 2 to 9; so do those of the pseudonym."""
    area, rest = F.substring(national, 1, 3).cast("long") - 200, F.substring(national, 4, 7).cast("long") - 2_000_000
    return _with(permuted_pair(area, rest, 800, 8_000_000, key, "phone"), lambda p: F.concat((p["a"] + 200).cast("string"), (p["b"] + 2_000_000).cast("string")))


def _phone(m: Column, key: str) -> Column:
    """All digits after the country code are permuted, so that notations of one number stay linked; without a code it is that of North America."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(m.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 0)).when(F.length(digits) == 11, "1").otherwise("")
    national = F.substring(digits, F.length(code) + 1, F.length(digits))
    american = code.isin("", "1") & national.rlike(NORTH_AMERICAN)
    return _refill(m, F.concat(code, F.when(american, _north_american(national, key)).otherwise(permuted(national, key, "phone"))))


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    payload = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _refill(m, _with(payload, lambda d: F.concat(d, F.pmod(F.lit(10) - _luhn(d, 1) % 10, F.lit(10)).cast("string"))))


def _secret(m: Column, key: str) -> Column:
    start = F.regexp_extract(m, KEY_START, 0)
    named = F.concat(start, permuted(F.substring(m, F.length(start) + 1, F.length(m)), key, "secret"))
    return F.when(start != "", named).otherwise(permuted(m, key, "secret", hexadecimal=True))


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permuted(name, key, "email"), F.substring(m, F.length(name) + 1, F.length(m)))


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for name, of in (("secret", _secret), ("email", _email), ("ipv4", _address), ("ssn", _social), ("date", _date), ("phone", _phone), ("card", _card)):
        out = F.when(kind == name, of(m, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", hits_col: str = "pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and a new column ``pii`` (or ``hits_col``).

    ``pii`` is an array of (kind, value, pseudonym), in order of appearance, null for
    a null text. A null text stays null, an empty one empty. Candidates that fail
    their validity test (no such day, wrong check digit, octet over 255) stay as they
    are. Rows are handled one by one: no shuffle, order and number of rows stay, and
    so do all other columns, whatever their names, but for an old column of that name.
    """
    text = F.col(f"`{text_col}`")
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), 0), lambda m: F.struct(_kind(m).alias("kind"), m.alias("value")))
    hits = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), _pseudonym(x["value"], x["kind"], key).alias("pseudonym")))
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    some = text.rlike("[0-9@]")
    marked = docs.withColumn(hits_col, F.when(some, hits).when(text.isNotNull(), none))
    texts = F.array_append(F.transform(F.col(f"`{hits_col}`"), lambda x: x["pseudonym"]), F.lit(""))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, texts, lambda g, p: F.concat(g, p)), "")
    out = marked.withColumn(text_col, F.when(F.size(F.col(f"`{hits_col}`")) > 0, joined).otherwise(text))
    return out.withColumn(hits_col, F.filter(F.col(f"`{hits_col}`"), lambda x: x["kind"].isNotNull()))
