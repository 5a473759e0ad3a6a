"""Text functions as Column expressions; only transliteration of non-Latin scripts needs an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists, scripts and patterns of the data model.
NULL_WORDS = ["null", "n/a", "na", "none", "nan"]
JUNK_WORDS = ["null", "none", "nan", "na"]
LEGAL_WORDS = (
    "inc incorporated llc l l c ltd limited pvt private corp corporation co company plc llp lp pc "
    "pllc lc pa sarl sas sasu eurl sa sci snc ei ets etablissements"
).split()
QUICK_LEGAL_WORDS = (
    "inc incorporated llc l l c ltd limited pvt private corp corporation co company plc llp lp pc pllc "
    "the and of services service group center centre sarl sas eurl sa ei ets fils cie"
).split()
SCRIPTS = [
    ("Devanagari", "0900", "097F"), ("Bengali", "0980", "09FF"), ("Gurmukhi", "0A00", "0A7F"),
    ("Gujarati", "0A80", "0AFF"), ("Odia", "0B00", "0B7F"), ("Tamil", "0B80", "0BFF"),
    ("Telugu", "0C00", "0C7F"), ("Kannada", "0C80", "0CFF"), ("Malayalam", "0D00", "0D7F"),
]
DOMAIN = r"(?i)^\s*(?:www\.)?([a-z0-9\-]+)\.(com|in|net|org|co\.in|co|biz|info|fr)\s*$"
JUNK_PREFIX = r"^\s*(>>|\.\.\.|\*\*\*|--|<<)\s"
BRACKET = r"[\[\(][^\]\)]*[\]\)]"
LEET = r"(?i)[a-z][013458][a-z]"
PO_BOX = r"(?i)\b(p\.?\s?o\.?\s?box|pmb)\b"
LANDMARK = r"(?i)\b(near|opp|opposite|behind|nr)\b"
NAME_PATTERNS = {
    "domain_name": r"(?i)^[a-z0-9\-]+\.(com|in|net|org|co|co\.in|biz|info|fr)$",
    "junk_prefix": r"^[^\w\s]{2,}\s",
    "leet_digit_in_word": r"(?i)[a-z][0-9][a-z]",
    "double_space": r"  ",
    "bracket_suffix": r"[\[\(][^\]\)]*[\]\)]\s*$",
}
ADDRESS_PATTERNS = {
    "null_token": r"(?i)\b(null|n/a|none)\b",
    "po_box": r"(?i)\b(po box|p\.o\. box|pmb)\b",
    "us_zip5": r"\b\d{5}(-\d{4})?\b",
    "in_pin6": r"\b\d{6}\b|\b\d{3} \d{3}\b",
    "fr_cp5": r"\b\d{5}\b",
    "near_landmark": r"(?i)\b(near|opp|opposite|behind|nr\.?)\b",
}
# End of fixed values.

_LATIN = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and len(unicodedata.normalize("NFD", chr(c))) > 1)
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _LATIN)
#: Letters without a canonical decomposition, and what they are written as in ASCII.
_SPECIAL = {"°": "deg", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ð": "D", "Þ": "TH", "Ł": "L"}
#: Greek and Cyrillic letters in ASCII, as usually written.
_LETTERS = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
_LETTERS |= dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya i i e g".replace("_", "").split(" "), strict=True))


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; everything else as it is."""
    return F.translate(c, _LATIN, _PLAIN)


def latin_ascii(c: Column) -> Column:
    """Lower-case Latin text in ASCII letters, by built-in functions alone."""
    out = F.lower(strip_accents(c))
    for a, b in _SPECIAL.items():
        if a.islower():
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def romanized(text: str) -> str:
    """Any script in ASCII: decomposition for Latin, usual letters for Greek and Cyrillic, letter names of the Unicode standard for others.

    Indic consonants carry an inherent ``a`` unless a vowel sign or virama follows; Arabic and Hebrew letters give the consonants their
    names begin with; Hangul and kana syllables are their names. Han characters have no reading without a dictionary: each
    is a word of its own, ``u`` and its code point.
    """
    text = "".join(unicodedata.name(c).rsplit(" ", 1)[-1].lower() if "\uac00" <= c <= "\ud7a3" else c for c in text)
    out: list[str] = []
    for ch in unicodedata.normalize("NFKD", text):
        if ch.isascii():
            out.append(ch)
            continue
        if ch in _SPECIAL:
            out.append(_SPECIAL[ch])
            continue
        name = unicodedata.name(ch, "")
        if " VOWEL SIGN " in name:
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1]
            out.append(name.rsplit(" ", 1)[1].lower())
        elif "SIGN VIRAMA" in name:
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1]
        elif "SIGN ANUSVARA" in name or "SIGN CANDRABINDU" in name:
            out.append("n")
        elif "CJK UNIFIED IDEOGRAPH" in name:
            out.append(f" u{ord(ch):x} ")
        elif ch.lower() in _LETTERS:
            out.append(_LETTERS[ch.lower()])
        elif name.startswith(("ARABIC LETTER ", "HEBREW LETTER ")):
            letter = name.split(" ", 2)[2].removeprefix("FINAL ").split(" ")[0].lower()
            onset = len(letter) - len(letter.lstrip("bcdfghjklmnpqrstvwxyz"))
            out.append(letter[: max(onset, 1)])
        elif " LETTER " in name and not unicodedata.combining(ch):
            out.append(name.rsplit(" LETTER ", 1)[1].split(" WITH ")[0].split(" ")[-1].lower())
        elif unicodedata.category(ch) == "Nd":
            out.append(str(unicodedata.digit(ch)))
        elif unicodedata.category(ch)[0] in "ZP":
            out.append(" ")
    return "".join(out)


@F.pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    """Lower-case ASCII of text in any script; only values that aren't ASCII are looked at letter by letter."""
    return s.map(lambda x: x if x is None else (x if x.isascii() else romanized(x)).lower())


def tokens(c: Column) -> Column:
    """Tokens of lower-case ASCII text.

    Runs of letters and digits; letters glued before digits are parted (``n29``), digits before letters aren't (``12b``); single
    letters parted only by full stops or spaces are joined (``l.l.c.``).
    """
    c = F.regexp_replace(c, "(?<![a-z0-9])([a-z]+)([0-9]+)(?![a-z0-9])", "$1 $2")
    c = F.regexp_replace(c, "(?<![a-z0-9])([a-z])[. ]+(?=[a-z](?![a-z0-9]))", "$1")
    return F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))


def norm_basic(c: Column) -> Column:
    """Lower case without accents; punctuation becomes single spaces."""
    c = F.regexp_replace(F.lower(strip_accents(c)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_indic(c: Column) -> Column:
    """As ``norm_basic``, but the signs of Indic scripts are kept."""
    c = F.regexp_replace(F.lower(strip_accents(c)), r"(?U)[^\w\s\x{0900}-\x{0D7F}]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Words of normalised text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_tokens(c: Column) -> Column:
    """Distinct name words without legal forms and single letters."""
    return F.array_distinct(F.filter(words(norm_basic(c)), lambda t: (F.length(t) > 1) & ~t.isin(QUICK_LEGAL_WORDS)))


def address_tokens(c: Column) -> Column:
    return F.filter(words(norm_basic(c)), lambda t: ~t.isin(NULL_WORDS))


def without_repeats(a: Column) -> Column:
    """An array without elements equal to the one before."""
    before = F.concat(F.array(F.lit(None).cast("string")), a)
    return F.array_compact(F.zip_with(a, before, lambda t, p: F.when(p.isNull() | (t != p), t)))


def core_tokens(a: Column, legal: list[str] = LEGAL_WORDS) -> Column:
    """Name tokens without legal forms, adjacent repeats taken once."""
    return without_repeats(F.filter(a, lambda t: ~t.isin(legal)))


def expand(a: Column, abbreviations: Column) -> Column:
    """Tokens without field markers, abbreviations (a map) written out; an expansion of several words gives several tokens."""
    kept = F.filter(a, lambda t: ~t.isin(JUNK_WORDS))
    return F.flatten(F.transform(kept, lambda t: F.split(F.coalesce(F.try_element_at(abbreviations, t), t), " ")))


def longest_token(a: Column) -> Column:
    """The longest token, the first in the alphabet of several."""
    return F.array_sort(F.transform(a, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))[0]["t"]


def skeleton_tokens(a: Column) -> Column:
    """Each token's first letter, then its letters without vowels and h."""
    return F.transform(a, lambda t: F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), "[aeiouh]", "")))


def skeleton_word(c: Column) -> Column:
    """First letter, then the rest without vowels, h and y."""
    return F.concat(F.substring(c, 1, 1), F.regexp_replace(F.substring(c, F.lit(2), F.length(c)), "[aeiouhy]", ""))


def skeleton_text(c: Column) -> Column:
    """A whole text without vowels, h, y and space, repeated letters taken once."""
    return F.regexp_replace(F.regexp_replace(c, r"[aeiouyh\s]", ""), r"(.)\1+", "$1")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))


def as_int(c: Column, digits: int = 15) -> Column:
    return F.substring(c, 1, digits).cast("bigint")


def first_int(c: Column, digits: int = 15) -> Column:
    """The first number's leading digits, or -1."""
    return F.coalesce(as_int(F.try_element_at(numbers(c), F.lit(1)), digits), F.lit(-1).cast("bigint"))


def second_int(c: Column, digits: int = 12) -> Column:
    return F.coalesce(as_int(F.try_element_at(numbers(c), F.lit(2)), digits), F.lit(-1).cast("bigint"))


def int_list(c: Column, most: int = 8, digits: int = 15) -> Column:
    return F.transform(F.slice(numbers(c), 1, most), lambda t: as_int(t, digits))


def zip_code(c: Column) -> Column:
    """The last number of five or six digits, or an empty text."""
    return F.coalesce(F.try_element_at(F.filter(numbers(c), lambda t: F.length(t).isin(5, 6)), F.lit(-1)), F.lit(""))


def house(c: Column) -> Column:
    """First number without leading zeros, with its suffix (bis, ter, quater or one letter)."""
    p = r"0*(\d+)\s?(bis|ter|quater|[a-z])?\b"
    n = F.regexp_extract(c, p, 1)
    suffix = F.regexp_extract(c, r"^\D*\d+\s?(bis|ter|quater)\b", 1)
    letter = F.regexp_extract(c, r"^\D*\d+([a-z])\b", 1)
    return F.when(n == "", "").otherwise(F.concat(n, F.when(suffix != "", suffix).otherwise(letter)))


def street_segment(c: Column) -> Column:
    """The first comma-parted piece with a digit, else the first piece."""
    parts = F.split(c, ",")
    return F.coalesce(F.try_element_at(F.filter(parts, lambda x: x.rlike(r"\d")), F.lit(1)), parts[0])


def street_words(c: Column) -> Column:
    """Words of three letters or more of the street segment."""
    return F.array_distinct(F.filter(tokens(latin_ascii(street_segment(c))), lambda t: (F.length(t) >= 3) & ~t.rlike(r"\d")))


def script_of(c: Column) -> Column:
    """Script of the first character in any of the nine Indic ranges, else Latin."""
    first = F.regexp_extract(c, r"[\x{0900}-\x{097F}\x{0980}-\x{0D7F}]", 0)
    out = F.lit("Latin")
    for name, a, b in SCRIPTS:
        out = F.when(first.rlike(rf"[\x{{{a}}}-\x{{{b}}}]"), name).otherwise(out)
    return out


def mixed_script(c: Column) -> Column:
    return c.rlike(r"[\x{0900}-\x{0D7F}]") & c.rlike("[A-Za-z]")


def non_ascii(c: Column) -> Column:
    return F.length(c) != F.octet_length(c)


def all_caps(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def all_lower(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


def repeats_word(a: Column) -> Column:
    """Whether a token equals the one before."""
    return F.size(without_repeats(a)) < F.size(a)


def domain_body(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, DOMAIN, 1), F.lit("-"), F.lit(""))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in their order."""
    return F.rlike(long, F.array_join(F.filter(F.split(short, ""), lambda x: x != ""), ".*"))


def related(u: Column, t: Column) -> Column:
    """Spellings of one word: equal skeletons of two letters or more, or an abbreviation that leaves out two letters or more."""
    same = (skeleton_word(u) == skeleton_word(t)) & (F.length(skeleton_word(u)) >= 2)

    def short(x: Column, y: Column) -> Column:
        return (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & is_subsequence(x, y) & (F.length(y) - F.length(x) >= 2)

    return same | short(u, t) | short(t, u)


def initials(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda t: F.substring(t, 1, 1)), "")


def spans_with_initials(a: Column, t: Column) -> Column:
    """Runs of as many tokens as ``t`` has letters whose initials spell it."""
    n = F.length(t)
    starts = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(a, i, n), " ")), lambda s: initials(F.split(s, " ")) == t)


def is_website(c: Column) -> Column:
    return c.rlike(r"\.[a-z]{2,4}$|^[#@]")


def embed_text(name: Column, address: Column) -> Column:
    """The text an encoder gets for a record."""
    return F.concat_ws(", ", name, address)


def prompt(name1: Column, address1: Column, name2: Column, address2: Column) -> Column:
    """A yes-or-no question on a pair, for a judge outside Spark."""
    return F.concat(F.lit("A: "), name1, F.lit(" | "), address1, F.lit("\nB: "), name2, F.lit(" | "), address2, F.lit("\nSame? "))


def state_table() -> list[tuple[str, str, str]]:
    """(country, written form, state): names and codes of states, as a small dimension."""
    # State names and codes.
    us = {
        "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado",
        "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
        "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
        "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
        "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
        "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina",
        "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island",
        "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont",
        "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
        "dc": "district of columbia",
    }
    india = {
        "andhra pradesh": ["ap"], "arunachal pradesh": ["ar"], "assam": ["as"], "bihar": ["br"], "chhattisgarh": ["cg", "ct"],
        "goa": ["ga"], "gujarat": ["gj"], "haryana": ["hr"], "himachal pradesh": ["hp"], "jharkhand": ["jh"], "karnataka": ["ka"],
        "kerala": ["kl"], "madhya pradesh": ["mp"], "maharashtra": ["mh"], "manipur": ["mn"], "meghalaya": ["ml"], "mizoram": ["mz"],
        "nagaland": ["nl"], "odisha": ["od", "or", "orissa"], "punjab": ["pb"], "rajasthan": ["rj"], "sikkim": ["sk"],
        "tamil nadu": ["tn"], "telangana": ["tg", "ts"], "tripura": ["tr"], "uttar pradesh": ["up"],
        "uttarakhand": ["uk", "ut", "uttaranchal"], "west bengal": ["wb"], "delhi": ["dl", "new delhi"],
        "jammu and kashmir": ["jk", "jammu kashmir"], "chandigarh": ["ch"], "puducherry": ["py", "pondicherry"], "ladakh": ["la"],
    }
    # End of fixed values.
    rows = [("US", k, v) for k, v in us.items()] + [("US", v, v) for v in us.values()]
    return rows + [("India", c, v) for v, names in india.items() for c in [v, *names]]


def address_state(address: Column, country: Column) -> Column:
    """struct(state, form): the first comma-parted piece that names a state, with form code or name; else form native."""
    table = F.map_from_entries(F.array(*[F.struct(F.lit(f"{c}|{k}"), F.lit(v)) for c, k, v in dict.fromkeys(state_table())]))
    known = country.isin("US", "India")
    pieces = F.filter(F.split(address, ","), lambda x: ~x.rlike(r"[\x{0900}-\x{0D7F}]"))
    found = F.try_element_at(F.filter(F.transform(pieces, norm_indic), lambda x: F.try_element_at(table, F.concat(country, F.lit("|"), x)).isNotNull()), F.lit(1))
    state = F.when(known, F.try_element_at(table, F.concat(country, F.lit("|"), found)))
    native = known & address.rlike(r"[\x{0900}-\x{0D7F}]")
    form = F.when(state.isNotNull(), F.when(F.length(found) <= 2, "code").otherwise("name")).when(native, "native")
    return F.struct(state.alias("state"), form.alias("form"))
