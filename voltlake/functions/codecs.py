"""Codecs that scan a value character by character: polylines, legacy-font Bengali, calendars."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_polyline(points: list[tuple[float, float]], factor: int = 100_000) -> str:
    """Latitudes and longitudes as signed steps in groups of five bits, printable from ``?`` up."""
    out, last = [], [0, 0]
    for point in points:
        for axis in (0, 1):
            now = round(point[axis] * factor)
            step, last[axis] = now - last[axis], now
            bits = ~(step << 1) if step < 0 else step << 1
            while bits > 31:
                out.append(chr(bits % 32 + 32 + 63))
                bits //= 32
            out.append(chr(bits + 63))
    return "".join(out)


def decode_polyline(text: str, factor: int = 100_000) -> list[tuple[float, float]]:
    values, bits, shift = [], 0, 0
    for c in text:
        part = ord(c) - 63
        bits |= (part & 31) << shift
        shift += 5
        if part < 32:
            values.append(~(bits >> 1) if bits & 1 else bits >> 1)
            bits, shift = 0, 0
    lat = lon = 0
    out = []
    for dy, dx in zip(values[::2], values[1::2], strict=False):
        lat, lon = lat + dy, lon + dx
        out.append((lat / factor, lon / factor))
    return out


@F.pandas_udf(T.StringType())
def polyline(points: pd.Series) -> pd.Series:
    """Encoded polyline of an array of struct(lat, lon)."""
    return points.map(lambda p: encode_polyline([(x["lat"], x["lon"]) for x in p]) if p is not None else None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])))
def unpolyline(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"lat": a, "lon": b} for a, b in decode_polyline(t)] if t is not None else None)


#: The legacy font's glyph codes (fixed values): sequences first, then single characters.
SEQUENCES = {
    "÷": "্র", "ª": "্র", "¡": "্ব", "¬": "্ল", "Ë": "ত্ত", "š^": "ন্ব", "Ø": "ষ্ট", "®Í": "স্ত", "¯Í": "স্ত", "¯^": "স্ব",
    "š—": "ন্ত", "Ç": "ণ্ট", "×": "দ্ধ", "Ø¡": "ষ্ট্ব", "°": "ক্ক", "³": "ক্ত", "¯": "স", "©": "র্", "ˆ": "ৈ", "Š": "ৌ",
    "‹": "ঞ", "„": "ৃ", "…": "ৃ", "†": "ে", "‡": "ে", "¨": "্য", "«": "্র",
}
SINGLE = {
    "A": "অ", "B": "ই", "C": "ঈ", "D": "উ", "E": "ঊ", "F": "ঋ", "G": "এ", "H": "ঐ", "I": "ও", "J": "ঔ",
    "K": "ক", "L": "খ", "M": "গ", "N": "ঘ", "O": "ঙ", "P": "চ", "Q": "ছ", "R": "জ", "S": "ঝ", "T": "ঞ",
    "U": "ট", "V": "ঠ", "W": "ড", "X": "ঢ", "Y": "ণ", "Z": "ত", "_": "থ", "`": "দ", "a": "ধ", "b": "ন",
    "c": "প", "d": "ফ", "e": "ব", "f": "ভ", "g": "ম", "h": "য", "i": "র", "j": "ল", "k": "শ", "l": "ষ",
    "m": "স", "n": "হ", "o": "ড়", "p": "ঢ়", "q": "য়", "r": "ৎ", "s": "ং", "t": "ঃ", "u": "ঁ",
    "v": "া", "w": "ি", "x": "ী", "y": "ু", "z": "ূ", "‰": "ঐ", "•": "ৗ", "\\": "্",
    "0": "০", "1": "১", "2": "২", "3": "৩", "4": "৪", "5": "৫", "6": "৬", "7": "৭", "8": "৮", "9": "৯",
    "|": "।", "Ô": "‘", "Õ": "’",
}
_CODE = re.compile("|".join(re.escape(k) for k in sorted([*SEQUENCES, *SINGLE], key=len, reverse=True)))
_EARLY = "িেৈ"
_CONSONANT = re.compile("[ক-হড়ঢ়য়]")


def reordered(text: str) -> str:
    """Vowel signs that stand before their consonant, moved behind the next one; signs that no consonant follows go to the end."""
    out, waiting = [], []
    for c in text:
        if c in _EARLY:
            waiting.append(c)
            continue
        out.append(c)
        if waiting and _CONSONANT.match(c):
            out += waiting
            waiting = []
    return "".join(out + waiting)


def bijoy(text: str) -> str:
    """Unicode text of legacy-font text: codes are replaced, vowel signs written before their consonant move
    behind it, split vowels join, and reph moves before its consonant."""
    marked = re.sub("[ˆ‰](?=[A-Za-z`_])", "ˆ", text)
    plain = _CODE.sub(lambda m: SEQUENCES.get(m[0]) or SINGLE[m[0]], marked)
    joined = reordered(plain).replace("অা", "আ").replace("\u09c7\u09be", "\u09cb").replace("\u09c7\u09d7", "\u09cc")
    return re.sub("([ক-হ])র্", "র্\\1", joined)


@F.pandas_udf(T.StringType())
def decode_bijoy(text: pd.Series) -> pd.Series:
    return text.map(lambda t: bijoy(t) if t is not None else None)


def decode_if_confident(text: Column) -> Column:
    """The decoded text where it looks like legacy-font text and decodes to plausible Bengali, else the raw one."""
    from voltlake.functions.text import is_plausible_bangla, looks_like_bijoy

    done = decode_bijoy(text)
    return F.when(looks_like_bijoy(text) & is_plausible_bangla(done), done).otherwise(text)


def _fold(line: Column) -> Column:
    return F.regexp_replace(line, "(.{72})", "$1\r\n ")


def calendar(day: Column, windows: Column, label: Column, utility: Column, url: Column, stamp: str, domain: str = "outages.example") -> Column:
    """iCalendar text of a day's windows (array of struct(start_min, end_min), local minutes at +06:00), with an alarm
    15 minutes before each."""
    utc = lambda m: F.date_format(F.timestamp_seconds(F.unix_seconds(F.to_timestamp(day, "yyyy-MM-dd")) + (m - 360) * 60), "yyyyMMdd'T'HHmmss'Z'")
    said = F.concat(F.lit("DESCRIPTION:Published outage window from "), utility, F.lit(". A schedule is not a promise."), F.coalesce(F.concat(F.lit("\\n\\nSource: "), url), F.lit("")))

    def event(w, i):
        return F.concat_ws(
            "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), day, F.lit("-"), i.cast("string"), F.lit("-"), F.regexp_replace(label, r"\W+", ""), F.lit(f"@{domain}")),
            F.lit(f"DTSTAMP:{stamp}"), F.concat(F.lit("DTSTART:"), utc(w["start_min"])), F.concat(F.lit("DTEND:"), utc(w["end_min"])), _fold(F.concat(F.lit("SUMMARY:Possible outage: "), label)), _fold(said),
            F.lit("BEGIN:VALARM"), F.lit("TRIGGER:-PT15M"), F.lit("ACTION:DISPLAY"), F.lit("DESCRIPTION:Possible outage in 15 minutes"), F.lit("END:VALARM"), F.lit("END:VEVENT"),
        )

    head = [F.lit(x) for x in ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//voltlake//schedule//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH")]
    return F.concat_ws("\r\n", F.concat(F.array(*head), F.transform(windows, event), F.array(F.lit("END:VCALENDAR"))))


def coverage_report(rows: list[tuple]) -> str:
    """Markdown table of (utility, level, sources, claims) rows."""
    lines = ["| Utility | Coverage | Sources | Claims |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {' | '.join('—' if x is None else str(x) for x in r)} |" for r in rows]) + "\n"
