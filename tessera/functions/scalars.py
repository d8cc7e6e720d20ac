"""Column functions with fixed semantics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_months(start: Column, end: Column) -> Column:
    """Whole months from start to end as calendars count them: a month is full when the day of month is reached."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start)) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def age_years(start: Column, end: Column) -> Column:
    return F.floor(age_months(start, end) / 12)


def age_bracket(age: Column, groups: list[tuple[int, int, str]]) -> Column:
    """The label of the first group (least, most, label) that holds age, both ends included; else Other."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for least, most, label in groups:
        out = out.when((age >= least) & (age <= most), F.lit(label))
    return out.otherwise(F.lit("Other"))


def csv_guard(value: Column) -> Column:
    """A value without white space around it that no spreadsheet takes for a formula; null is empty.

    What then begins with = + - @ gets an apostrophe before it.
    """
    stripped = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.substring(stripped, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), stripped)).otherwise(stripped)


def _without_marks(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()


#: Letters of the Latin, Greek and Cyrillic blocks that are one other letter without their marks, by Unicode's own decomposition.
_PLAIN = {c: _without_marks(c) for c in map(chr, [*range(0xAA, 0x530), *range(0x1E00, 0x2000)]) if not unicodedata.combining(c) and len(_without_marks(c)) == 1 and _without_marks(c) != c}
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_JOINED = {c: _without_marks(c) for c in map(chr, range(0xFB00, 0xFB07))}


def folded(value: Column) -> Column:
    """Lower case without accents: composed letters become plain ones, combining marks go, ligatures are spelled out."""
    out = F.translate(F.lower(value), "".join(_PLAIN) + _MARKS, "".join(_PLAIN.values()))
    for joined, plain in _JOINED.items():
        out = F.replace(out, F.lit(joined), F.lit(plain))
    return out


# fixed values: units and galenic forms that labels carry besides molecule and brand
UNITS = "MG|G|MCG|µG|UG|UI|MUI|KUI|ML|CL|L|MMOL|MEQ|µ|%"
FORMS = (
    "CP|CPR|COMPRIMES?|GELULES?|G[EÉ]LULES?|GEL|CAPSULES?|SACHETS?|SUPPOS?|SUPPOSITOIRES?|INJ(?:ECTABLE)?|IV|IM|SC|PERF|SOL(?:UTION)?|"
    "SUSP(?:ENSION)?|BUV(?:ABLE)?|SIROP|PDR|POUDRE|POMMADE|CR[EÈ]ME|COLLYRE|PATCH|DISP(?:ERSIBLE)?|L\\.?P|LM|EFF(?:ERVESCENT)?|ORO(?:DISP)?|"
    "FLACON|FL|AMP(?:OULE)?|STYLO|DOSE|TRANSD(?:ERMIQUE)?|INHAL?|NEBUL|GTT|GOUTTES?|POCHE|SERINGUE|SRG|TUBE|P[AÂ]TE|EMULSION|EMPL[AÂ]TRE"
)


def clean_drug_label(label: Column) -> Column:
    """Molecule and brand of a label, lower-cased, without doses, units and forms; the label itself if nothing is left."""
    out = F.regexp_replace(label, r"[()]", " ")
    for pattern in (r"\S*\d\S*", rf"(?iuU)\b(?:{UNITS})\b", rf"(?iuU)\b(?:{FORMS})\b", r"[/.,;:+]", r"(?U)\b\w\b", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.lower(F.trim(out))
    return F.when(F.length(out) > 0, out).otherwise(F.lower(F.trim(label)))


def chi2_tail(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution: normal for 1, exact for 2, a cube-root normal approximation beyond."""

    def tail(z: Column) -> Column:
        # fixed values: a published rational approximation of the normal tail (Abramowitz and Stegun 26.2.17)
        t = F.lit(1.0) / (F.lit(1.0) + 0.2316419 * F.abs(z))
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
        return F.when(z >= 0, upper).otherwise(1 - upper)

    p = 2 * tail(F.sqrt(x)) if df == 1 else F.exp(-x / 2) if df == 2 else tail((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    return F.when(x <= 0, F.lit(1.0)).otherwise(p)
