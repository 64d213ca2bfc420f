"""Text functions as column expressions: folding, tokens, transliteration, cleaning."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space beyond ASCII that counts as such (fixed values).
SPACES = "    -     　"
BENGALI = "ঀ-৿"


def collapse_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[\s{SPACES}]+", " "))


def slug_ascii(text: Column) -> Column:
    """Lower case, ASCII letters and digits, the rest as single hyphens; ``unknown`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """NFKD without what is not ASCII; Spark has no normalising function."""
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def slugify(text: Column) -> Column:
    """A slug that keeps base letters of accented ones."""
    return slug_ascii(decomposed(F.lower(text)))


def feeder_id(utility: Column, division: Column, feeder: Column) -> Column:
    return F.concat_ws(":", F.lower(utility), slug_ascii(division), slug_ascii(feeder))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "০১২৩৪৫৬৭৮৯", "0123456789")


#: Accented letters that decompose to a base letter (fixed values), for folding without Python.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_latin(text: Column) -> Column:
    """A key under which spellings of a place name agree. The order of the steps matters."""
    t = F.translate(F.lower(text), _MARKED, _PLAIN)
    t = F.regexp_replace(t, rf"[^a-z0-9{BENGALI} ]+", " ")
    for pair in ("kh", "gh", "th", "dh", "bh", "sh", "ch"):
        t = F.replace(t, F.lit(pair), F.lit(pair[0]))
    t = F.replace(t, F.lit("ph"), F.lit("f"))
    t = F.regexp_replace(t, r"([a-z])\1+", "$1")
    t = F.regexp_replace(t, r"[wy]", "")
    t = F.regexp_replace(t, r"[aeiou]+", "a")
    return F.trim(F.regexp_replace(t, r" +", " "))


#: Words without locating power, spelling drift and unit names (fixed values).
STOP = [
    "area", "areas", "under", "the", "feeder", "and", "of", "part", "parts", "no", "nos", "dhaka", "bangladesh", "division", "zone", "sub", "station", "ss", "kv",
    "line", "adjacent", "nearby", "surrounding", "etc", "others", "other", "some", "all",
]
DRIFT = {
    "kallyanpur": "kalyanpur", "kalayanpur": "kalyanpur", "kollyanpur": "kalyanpur",
    "mohammedpur": "mohammadpur", "muhammadpur": "mohammadpur", "uttora": "uttara", "uttar": "uttara",
    "goolshan": "gulshan", "gulsan": "gulshan", "bananee": "banani", "mirpore": "mirpur", "mirpr": "mirpur",
    "palabi": "pallabi", "shali": "shahali", "roopnagar": "rupnagar", "basundhara": "bashundhara",
    "bosundhora": "bashundhara", "bhatara": "vatara", "tungi": "tongi", "dakkhinkhan": "dakshinkhan",
    "dokkhinkhan": "dakshinkhan", "uttorkhan": "uttarkhan", "agargao": "agargaon", "cafrul": "kafrul",
    "boridhara": "baridhara", "kilkhet": "khilkhet", "nikunjo": "nikunja", "sewrapara": "shewrapara",
    "kajipara": "kazipara", "manipur": "monipur", "darusalam": "darussalam", "ibrahimpore": "ibrahimpur",
}
UNITS = {"sec": "sector", "rd": "road", "blk": "block", "ave": "avenue"}
UNIT = r"\b(sector|sec|road|rd|block|blk|section|lane|avenue|ave|house|plot|ward)\s*[-.# ]?\s*([0-9]{1,3}|[a-z])\b"


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def unit_tokens(text: Column) -> Column:
    """``kind:value`` tokens such as road:12."""
    low = F.lower(text)
    kinds, values = F.regexp_extract_all(low, F.lit(UNIT), F.lit(1)), F.regexp_extract_all(low, F.lit(UNIT), F.lit(2))
    canon = _lookup(UNITS)
    return F.array_distinct(F.zip_with(kinds, values, lambda k, v: F.concat(F.coalesce(F.try_element_at(canon, k), k), F.lit(":"), v)))


def tokens(text: Column) -> Column:
    """Distinct evidence tokens: units, words with their drift undone, and a ``~`` folded form of each."""
    drift = _lookup(DRIFT)
    words = F.filter(F.split(F.lower(text), rf"[^a-z0-9{BENGALI}]+"), lambda w: (F.char_length(w) >= 3) & ~w.isin(STOP) & ~w.rlike(r"^\d+$"))
    fixed = F.transform(words, lambda w: F.coalesce(F.try_element_at(drift, w), w))
    # The folded form is computed once for each word, as a field.
    pairs = F.transform(fixed, lambda w: F.struct(w.alias("w"), fold_latin(w).alias("f")))
    both = F.flatten(F.transform(pairs, lambda x: F.array(x["w"], F.when((x["f"] != "") & (x["f"] != x["w"]), F.concat(F.lit("~"), x["f"])))))
    return F.array_distinct(F.concat(unit_tokens(text), F.array_compact(both)))


#: Bengali letters and signs as Latin ones, for search only (fixed values).
LATIN = {
    "অ": "a", "আ": "a", "ই": "i", "ঈ": "i", "উ": "u", "ঊ": "u", "ঋ": "ri", "এ": "e", "ঐ": "oi", "ও": "o", "ঔ": "ou",
    "া": "a", "ি": "i", "ী": "i", "ু": "u", "ূ": "u", "ৃ": "ri", "ে": "e", "ৈ": "oi", "ো": "o", "ৌ": "ou",
    "ক": "k", "খ": "kh", "গ": "g", "ঘ": "gh", "ঙ": "ng", "চ": "ch", "ছ": "chh", "জ": "j", "ঝ": "jh", "ঞ": "n",
    "ট": "t", "ঠ": "th", "ড": "d", "ঢ": "dh", "ণ": "n", "ত": "t", "থ": "th", "দ": "d", "ধ": "dh", "ন": "n",
    "প": "p", "ফ": "ph", "ব": "b", "ভ": "bh", "ম": "m", "য": "j", "র": "r", "ল": "l",
    "শ": "sh", "ষ": "sh", "স": "s", "হ": "h", "ড়": "r", "ঢ়": "rh", "য়": "y", "ৎ": "t",
    "ং": "ng", "ঃ": "h", "ঁ": "n", "্": "",
    "০": "0", "১": "1", "২": "2", "৩": "3", "৪": "4", "৫": "5", "৬": "6", "৭": "7", "৮": "8", "৯": "9",
}


def compose_nukta(text: Column) -> Column:
    """The three letters written as base and dot, as one code point each."""
    for base, one in (("য", "য়"), ("ড", "ড়"), ("ঢ", "ঢ়")):
        text = F.replace(text, F.lit(base + "়"), F.lit(one))
    return text


def transliterate(text: Column, table: dict[str, str] = LATIN) -> Column:
    """Latin search text: mapped letters, ASCII letters and digits in lower case, and light punctuation."""
    m = _lookup(table)
    one = lambda c: F.when(F.map_contains_key(m, c), F.try_element_at(m, c)).when(c.rlike(r"^[A-Za-z0-9]$"), F.lower(c)).when(c.rlike(r"^[ ,.\-()/]$"), c).otherwise("")
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.split(compose_nukta(text), ""), one), ""), r"\s+", " "))


def clean(text: Column) -> Column:
    """What carries meaning: no zero-width characters, bars or doubled commas."""
    t = compose_nukta(F.regexp_replace(text, "[​‌‍﻿]", ""))
    t = F.replace(F.replace(t, F.lit("|"), F.lit(" ")), F.lit("৷"), F.lit(","))
    t = F.regexp_replace(t, rf"[\s{SPACES}]+", " ")
    t = F.regexp_replace(t, r" ?, ?", ", ")
    t = F.regexp_replace(t, r"(, ?)+", ", ")
    return F.regexp_replace(t, "^[ ,.\\-।]+|[ ,.\\-।]+$", "")


def split_areas(text: Column) -> Column:
    """The distinct places of a comma-separated cell, in order, without noise."""
    parts = F.transform(F.split(text, "[,،৷/]"), clean)
    return F.array_distinct(F.filter(parts, lambda p: (F.char_length(p) >= 2) & p.rlike(rf"[A-Za-z{BENGALI}]")))


def bengali_ratio(text: Column) -> Column:
    """Share of Bengali letters among the characters that are not spaces."""
    n = F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(n > 0, F.regexp_count(text, F.lit(f"[{BENGALI}]")) / n).otherwise(0.0)


def looks_like_a_name(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{BENGALI}]")) >= 3


def search_text(areas: Column) -> Column:
    """Distinct transliterated areas, without voltage markers and digits, joined by spaces."""
    bare = F.transform(areas, lambda a: transliterate(F.regexp_replace(a, r"(?i)\b\d+\s*kv\b|[0-9০-৯]+", " ")))
    return F.array_join(F.array_distinct(F.filter(bare, lambda a: a != "")), " ")


def title_case(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def summary(items: Column, k: int = 3) -> Column:
    """The first k items, and how many more there are."""
    head = F.array_join(F.slice(items, 1, k), ", ")
    return F.when(F.size(items) > k, F.concat(head, F.format_string(" +%d more", F.size(items) - k))).otherwise(head)


def load_plausible(text: Column, low: float = 0.2, high: float = 15.0) -> Column:
    """A load read from a scan: it needs a decimal point and must be plausible, else null."""
    v = F.regexp_extract(text, r"(\d{1,3}\.\d{1,2})", 1).try_cast("double")
    return F.when(v.between(low, high), F.round(v, 2))


def load_lenient(text: Column) -> Column:
    """A load of a digital sheet: inner spaces are dropped; null if it is no number."""
    return F.regexp_replace(text, r"\s+", "").try_cast("double")


def looks_like_bijoy(text: Column) -> Column:
    """Whether a text is probably legacy-font Bengali: Latin letters, not plain codes or English."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    lower = F.regexp_count(text, F.lit(r"\p{Ll}"))
    odd = text.rlike("[ -ÿ‘-”†-‰]")
    return F.coalesce(~text.rlike(f"[{BENGALI}]") & (letters >= 3) & ~text.rlike(r"^[A-Z0-9 ./()\-]+$") & (odd | (lower / letters > 0.35)), F.lit(False))


def is_plausible_bangla(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(f"[{BENGALI}]"))
    return (n >= 2) & (n / F.greatest(F.lit(1), F.char_length(F.replace(text, F.lit(" "), F.lit("")))) > 0.6)
