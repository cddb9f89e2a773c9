"""Scalar expressions on columns; each is a plain Catalyst expression."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin ordinal suffixes of inserted articles; the first five by default, the rest on request.
SUFFIXES = {"1": "", "2": " bis", "3": " ter", "4": " quater", "5": " quinquies"}
MORE_SUFFIXES = {"6": " sexies", "7": " septies", "8": " octies", "10": " decies", "12": " duodecies", "13": " terdecies", "14": " quaterdecies", "15": " quindecies"}

# Parameters of an article link, in the order of its URL.
LINK_KEYS = ["versione", "idGruppo", "flagTipoArticolo", "codiceRedazionale", "idArticolo", "idSottoArticolo", "idSottoArticolo1", "dataPubblicazioneGazzetta", "progressivo"]
ARTICLE_URL = "https://www.normattiva.it/atto/caricaArticolo"

# Fixed value: the header of a question, with its number and its topic; (?U) lets \s and \d be those of Unicode.
HEADER = r"(?U)Quesito\s+n.?\s*(\d+)\s*[-–]\s*(.+)"
#: White space of Unicode.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
#: Names of HTML entities and what they stand for: those that end in a semicolon, and the older ones that need none.
ENTITIES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
OLD_ENTITIES = {k: v for k, v in html5.items() if not k.endswith(";")}
#: The names that most texts make do with; a text with any other entity goes through the tables.
COMMON = ["nbsp", "copy", "middot", "quot", "agrave", "egrave", "igrave", "ograve", "ugrave", "eacute", "deg", "lt", "gt", "amp"]
_UNCOMMON = rf"&(?!(?:{'|'.join(COMMON)});)[#A-Za-z]"
#: Numbers 128 to 159 are read as bytes of the Windows code page, where it has them.
_C1 = [bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)]


def strip(c: Column) -> Column:
    """Without white space (also no-break spaces) at both ends."""
    return F.trim(c, F.lit(_WHITE))


def _look_up(entries: dict[str, str], name: Column) -> Column:
    """The entry of a name; a map of its own for each first letter keeps the search short."""

    def of(letter: str) -> Column:
        return F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in entries.items() if k[0] == letter)), F.lit("\1"), F.lit("\2"))

    return F.try_element_at(F.get(F.array(*[of(chr(c)) for c in range(ord("A"), ord("z") + 1)]), F.ascii(name) - ord("A")), name)


def _entity(found: Column) -> Column:
    """The text of one entity; one that isn't known stays as it is."""
    name = F.regexp_replace(found, "^&|;$", "")
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.lit(8)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.lit(8))).cast("int")
    point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    numeric = F.when(bad, F.lit("\ufffd")).when(code.between(128, 159), F.get(F.array(*map(F.lit, _C1)), code - 128)).otherwise(point)
    named = F.when(found.endswith(";"), _look_up(ENTITIES, name)).otherwise(_look_up(OLD_ENTITIES, name))
    return F.when(name.startswith("#"), numeric).otherwise(F.coalesce(named, found))


def decode_entities(c: Column) -> Column:
    """Named and numeric HTML entities decoded, each once; older names need no semicolon if no letter follows."""
    decoded = F.transform(F.regexp_extract_all(c, F.lit(ENTITY), 0), _entity)
    gaps = F.split(c, ENTITY, -1)
    joined = F.array_join(F.zip_with(gaps, F.array_append(decoded, F.lit("")), lambda g, d: F.concat(g, d)), "")
    common = c
    for name in COMMON:  # the ampersand comes last, so nothing is decoded twice
        common = F.replace(common, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return F.when(~F.contains(c, F.lit("&")), c).when(c.rlike(_UNCOMMON), joined).otherwise(common)


def query_get(query: Column, key: str, prefix: str = "art.") -> Column:
    """First value of ``prefix + key``, else of ``key``, else empty; a blank prefixed one wins."""

    def value(name: str) -> Column:
        found = F.regexp_extract(query, rf"(?:^|&)\Q{name}\E=([^&]*)", 1)
        return strip(F.coalesce(F.try_url_decode(found), found))

    return F.when(query.rlike(rf"(?:^|&)\Q{prefix}{key}\E="), value(prefix + key)).otherwise(F.coalesce(value(key), F.lit("")))


def default_if_empty(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def encode_query(pairs: dict[str, Column]) -> Column:
    """key=value&... in the given order; spaces become "+", "~" stays and "*" is escaped."""

    def quoted(c: Column) -> Column:
        return F.replace(F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), quoted(c)) for k, c in pairs.items()])


def article_url(base: str = ARTICLE_URL) -> Column:
    """The URL of an article from its nine link columns."""
    return F.concat(F.lit(base + "?"), encode_query({f"art.{k}": F.col(k) for k in LINK_KEYS}))


def ordinal_suffix(sub: Column, more: bool = False) -> Column:
    """"" for "1", " bis" for "2" and so on; " (n)" for numbers without a name."""
    names = SUFFIXES | (MORE_SUFFIXES if more else {})
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, sub), F.concat(F.lit(" ("), sub, F.lit(")")))


def article_label(number: Column, sub: Column, more: bool = False) -> Column:
    return F.concat(F.lit("Art. "), number, ordinal_suffix(sub, more))


def file_name(number: Column, sub: Column) -> Column:
    """art_0007_2.html; numbers over four digits keep them all."""
    return F.format_string("art_%04d_%s.html", number.try_cast("int"), sub)


def without_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^Art\.\s*", "")


def answer(c: Column, yes: str = "VERO", no: str = "FALSO") -> Column:
    """True, false or null by a stripped word in any case."""
    word = F.upper(strip(c))
    return F.when(word == yes, F.lit(True)).when(word == no, F.lit(False))


def one_line(c: Column) -> Column:
    """Newlines become spaces, ends are stripped, null becomes empty."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def is_number(c: Column) -> Column:
    """A cell that is digits and nothing else once stripped; false for null."""
    return F.coalesce(strip(c).rlike(r"^\p{Nd}+$"), F.lit(False))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
