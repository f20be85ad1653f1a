"""Scalar functions on text columns: cleaning, numbers, dates, keys. Column in, Column out; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are read as another, and those that are dropped.
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-"}
BLANKS = "   \t"
UNSEEN = "​‌‍﻿­"

MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "des": 12}


def once(column: Column, use: Callable[[Column], Column]) -> Column:
    """use(column), with the column worked out once however often it is used."""
    return F.element_at(F.transform(F.array(column), use), 1)


def one_line(text: Column) -> Column:
    """Invisible characters dropped, quotes and dashes made plain, all blanks squeezed to one space."""
    source = "".join(QUOTES) + BLANKS + UNSEEN
    plain = F.translate(text, source, "".join(QUOTES.values()) + " " * len(BLANKS))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def lines(text: Column) -> Column:
    """The same for each line; empty lines are left out."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), one_line), lambda x: x != ""), "\n")


def fingerprint(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, n)


def finite(value: Column) -> Column:
    """The number, or null for NaN and infinities."""
    x = value.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def machine_number(text: Column) -> Column:
    """A number of our own files: the dot is the decimal point, blanks are ignored, anything else is null."""
    return finite(F.regexp_replace(text, r"\s", "").try_cast("double"))


def convention(text: Column) -> Column:
    """EN or NB by votes of the numbers in a text whose reading is certain, null when tied."""
    en = F.size(F.regexp_extract_all(text, F.lit(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+\.\d{1,2}(?!\d)"), F.lit(0)))
    nb = F.size(F.regexp_extract_all(text, F.lit(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?(?!\d)|\d+,\d{1,2}(?!\d)"), F.lit(0)))
    return F.when(en > nb, "EN").when(nb > en, "NB")


def _packed(text: Column, dropped: str = "") -> Column:
    """one_line without any blank, and without some characters: characters are exchanged one by one, no pattern is run."""
    return F.translate(text, "".join(QUOTES) + BLANKS + UNSEEN + " \n\x0b\f\r" + dropped, "".join(QUOTES.values()))


def human_number(text: Column, style: Column | None = None) -> Column:
    """A number as people write it. Given a convention its separators hold. Else the last separator is decimal, unless it
    is repeated or followed by exactly three digits; then it groups thousands. Brackets or a leading minus mean negative."""
    style = F.lit(None).cast("string") if style is None else style

    def read_(raw: Column) -> Column:
        negative = F.startswith(raw, F.lit("-")) | (F.startswith(raw, F.lit("(")) & F.endswith(raw, F.lit(")")))
        value = once(once(F.translate(raw, "()+-", ""), lambda body: _plain(body, style)), lambda x: F.when(x.rlike(r"^\d*\.?\d+([eE]\d+)?$|^\d+\.$"), x.try_cast("double")))
        return F.when(negative, -value).otherwise(value)

    return once(_packed(text), read_)


def _plain(body: Column, style: Column) -> Column:
    """The number with the dot as its only separator."""
    dots, commas = F.contains(body, F.lit(".")), F.contains(body, F.lit(","))
    english, nordic = F.translate(body, ",", ""), F.translate(body, ",.", ".")
    last_dot = ~F.contains(F.substring_index(body, ".", -1), F.lit(","))
    return (
        F.when(style == "EN", english).when(style == "NB", nordic)
        .when(dots & commas, F.when(last_dot, english).otherwise(nordic))
        .when((dots | commas) & body.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.translate(body, ".,", ""))
        .when(commas, nordic).otherwise(english)
    )


def share_count(text: Column) -> Column:
    """A count of shares: every separator groups thousands; halves round to even."""
    return F.bround(_packed(text, ".,").try_cast("double")).cast("long")


#: Currency codes; KR is NOK.
CURRENCIES = ("NOK", "KR", "USD", "EUR", "SEK", "DKK", "GBP", "CHF", "CAD", "JPY")


def amount(text: Column) -> Column:
    """struct(value, currency); amounts are not converted."""
    code = F.regexp_extract(F.upper(text), rf"\b({'|'.join(CURRENCIES)})\b", 1)
    number = F.regexp_extract(one_line(text), r"\(?-?\d[\d .,]*\)?", 0)
    return F.struct(human_number(F.trim(number)).alias("value"), F.when(code == "KR", "NOK").when(code != "", code).alias("currency"))


def calendar_date(text: Column) -> Column:
    """A date written as ISO, day.month.year, day month-name year, or month-name day, year; within 1996 and the day after tomorrow."""
    return once(F.lower(one_line(text)), _calendar_date)


def _calendar_date(t: Column) -> Column:
    number = lambda name: F.coalesce(*[F.when(F.substring(name, 1, 3) == k, v) for k, v in MONTHS.items()])
    made = lambda y, m, d: F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), F.lit("yyyy-MM-dd")))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[./](\d{1,2})[./](\d{4})"
    named, american = r"^(\d{1,2})\.? ([a-z]{3,9})\.? (\d{4})", r"^([a-z]{3,9}) (\d{1,2}),? (\d{4})"
    found = (
        F.when(t.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(dmy), made(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .when(t.rlike(named), made(part(named, 3), number(part(named, 2)), part(named, 1)))
        .when(t.rlike(american), made(part(american, 3), number(part(american, 1)), part(american, 2)))
    )
    return F.when(found.between(F.lit("1996-01-01").cast("date"), F.date_add(F.current_date(), 2)), found)


def iso_date(text: Column) -> Column:
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-MM-dd"))))


def serial_date(value: Column, base_1904: bool = False) -> Column:
    """A spreadsheet's day number as date; numbers outside 19,723 to 80,000 are not dates."""
    n = F.floor(value)
    return F.when(value.between(19_723, 80_000), F.date_add(F.lit("1904-01-01" if base_1904 else "1899-12-30").cast("date"), n.cast("int")))


def date_cell(text: Column, base_1904: bool = False) -> Column:
    return once(text, lambda t: _date_cell(t, base_1904))


def _date_cell(text: Column, base_1904: bool) -> Column:
    compact = F.when(F.trim(text).rlike(r"^(19|20)\d{6}$"), F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd"))))
    return F.coalesce(iso_date(text), compact, calendar_date(text), serial_date(machine_number(text), base_1904))


def minute_of_day(text: Column) -> Column:
    """Minutes after midnight of "16:35" or "16.35"."""
    h, m = (F.regexp_extract(text, r"(?:^|\D)([01]?\d|2[0-3])[:.]([0-5]\d)(?:\D|$)", i) for i in (1, 2))
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def first_of(text: Column, words: list[str]) -> Column:
    """The first entry of the list that the text holds: single words at word boundaries, phrases anywhere."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"\b{w}\b") if " " not in w else F.contains(low, F.lit(w)), F.lit(w)) for w in words])


def guess_language(text: Column, votes: dict[str, list[str]]) -> Column:
    """The language most of whose key words are in the text; null when tied."""
    counts = {k: sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in votes.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    ties = sum(((c == best).cast("int") for c in counts.values()), F.lit(0))
    return F.when((best > 0) & (ties == 1), F.coalesce(*[F.when(c == best, F.lit(k)) for k, c in counts.items()]))


def bare_ticker(symbol: Column, suffix: str = ".OL") -> Column:
    return F.regexp_replace(F.upper(F.trim(symbol)), f"{suffix.replace('.', chr(92) + '.')}$", "")


def message_id(lang: Column, node: Column, url: Column, *fields: Column) -> Column:
    """language-node, else language-number in the URL, else H- and a hash of the fields."""
    number = F.coalesce(F.when(node.rlike(r"^\d+$"), node), F.nullif(F.regexp_extract(url, r"(\d{6,})", 1), F.lit("")))
    return F.coalesce(F.concat(F.upper(lang), F.lit("-"), number), F.concat(F.lit("H-"), fingerprint(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))))


def saturation(x: Column, half: float) -> Column:
    """x / (x + half): 0 at none, a half at `half`, towards 1 beyond. Null stays null, negative counts as 0."""
    y = F.greatest(x, F.lit(0.0))
    return F.when(x.isNotNull(), F.try_divide(y, y + half))


def is_yes(flag: Column) -> Column:
    return F.lower(F.trim(flag.cast("string"))).isin("true", "1", "ok", "ja", "yes")
