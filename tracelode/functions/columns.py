"""Column expressions of the header's scalar functions, for tables that hold raw header fields as text.

Numbers follow the format's own grammar (a sign, ``.5``, ``5.``, ``1e5``, ``inf``; no underscores, suffixes
or inner blanks); what doesn't fit is null instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions.edf_bytes import ANNOTATION_LABEL, MONTHS


def clean(text: Column) -> Column:
    """A field without surrounding white space of any kind."""
    return F.regexp_replace(text, r"^[\s\u0085 ]+|[\s\u0085 ]+$", "")


def number(text: Column) -> Column:
    t = clean(text)
    plain = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    special = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(plain, t.try_cast("double")).when(special.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(special == "nan", F.lit(float("nan")))


def integer(text: Column, kind: str = "bigint") -> Column:
    t = clean(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast(kind))


def variant(reserved: Column) -> Column:
    return F.when(reserved.startswith("EDF+C"), "EDF+C").when(reserved.startswith("EDF+D"), "EDF+D").otherwise("EDF")


def is_annotation(label: Column) -> Column:
    return label.startswith(ANNOTATION_LABEL)


def known(token: Column) -> Column:
    """A subfield's value; X in either case is null."""
    return F.when(F.upper(token) != "X", token)


def gain(pmin: Column, pmax: Column, dmin: Column, dmax: Column) -> Column:
    """Null without limits, or where the digital ones are equal (files with such a range aren't opened)."""
    span = dmax.cast("double") - dmin.cast("double")
    return (pmax - pmin) / F.when(span != 0, span)


def offset(pmin: Column, gain_: Column, dmin: Column) -> Column:
    return pmin - gain_ * dmin.cast("double")


def sample_rate(samples: Column, duration: Column) -> Column:
    return F.when(duration == 0, F.lit(0.0)).otherwise(samples / F.when(duration == 0, F.lit(1.0)).otherwise(duration))


def duration(num_records: Column, record_duration: Column) -> Column:
    return F.greatest(num_records, F.lit(0)) * record_duration


def start_datetime(date: Column, time: Column) -> Column:
    """dd.mm.yy and hh.mm.ss; two-digit years from 85 on are of the last century; null for anything else."""
    d, t = F.split(date, r"\."), F.split(time, r"\.")
    number_ = lambda parts, i: F.when(F.get(parts, F.lit(i)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(i)).try_cast("int"))
    yy = number_(d, 2)
    year = yy + F.when(yy >= 85, 1900).otherwise(2000)
    whole = (F.size(d) == 3) & (F.size(t) == 3)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, number_(d, 1), number_(d, 0), number_(t, 0), number_(t, 1), number_(t, 2))
    every = F.concat(year, number_(d, 1), number_(d, 0), number_(t, 0), number_(t, 1), number_(t, 2))
    return F.when(whole & every.isNotNull(), text.try_cast("timestamp_ntz"))


def day(text: Column) -> Column:
    """DD-MMM-YYYY with an English month in any case; null for anything else."""
    p = F.split(text, "-")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.get(p, F.lit(1))))
    fits = text.rlike(r"^\+?[0-9]+-[A-Za-z]{3}-\+?[0-9]+$") & (month > 0)
    iso = F.format_string("%04d-%02d-%02d", F.get(p, F.lit(2)).try_cast("int"), month, F.get(p, F.lit(0)).try_cast("int"))
    return F.when(fits, iso.try_cast("date"))


def _tokens(text: Column) -> Column:
    return F.split(clean(text), r"\s+")


def _token(tokens: Column, i: int) -> Column:
    return F.get(tokens, F.lit(i))


def _spaced(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def _rest(tokens: Column, start: int) -> Column:
    """Tokens from the start-th on (from 0), joined; null if there are none."""
    return F.when(F.size(tokens) > start, _spaced(F.array_join(F.slice(tokens, start + 1, F.greatest(F.size(tokens) - start, F.lit(0))), " ")))


def _unless_unknown(token: Column, value: Column) -> Column:
    return F.when(F.upper(token) != "X", value)


def patient(text: Column) -> Column:
    """Struct of patient_id's subfields; all null with fewer than four."""
    t = _tokens(text)
    sex, born = F.upper(_token(t, 1)), _token(t, 2)
    fields = {
        "code": known(_token(t, 0)), "sex": F.when(sex.isin("M", "F"), sex), "birthdate": _unless_unknown(born, day(born)),
        "birthdate_raw": F.when(day(born).isNull(), _unless_unknown(born, born)), "name": known(_token(t, 3)), "additional": _rest(t, 4),
    }
    fields["name"] = _spaced(fields["name"])
    return F.struct(*[F.when(F.size(t) >= 4, c).alias(n) for n, c in fields.items()])


def recording(text: Column) -> Column:
    """Struct of recording_id's subfields; all null unless it begins with Startdate and has five at least."""
    t = _tokens(text)
    date = _token(t, 1)
    fits = (F.size(t) >= 5) & (F.lower(_token(t, 0)) == "startdate")
    fields = {
        "start_date": _unless_unknown(date, day(date)), "start_date_raw": F.when(day(date).isNull(), _unless_unknown(date, date)), "admin_code": known(_token(t, 2)),
        "technician": _spaced(known(_token(t, 3))), "equipment": _spaced(known(_token(t, 4))), "additional": _rest(t, 5),
    }
    return F.struct(*[F.when(fits, c).alias(n) for n, c in fields.items()])
