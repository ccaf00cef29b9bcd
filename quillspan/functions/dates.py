"""Partial dates written in words or figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import stripped

# Month names in the order in which they are looked for.
MONTHS = (
    ("january", "01"), ("february", "02"), ("march", "03"), ("april", "04"), ("may", "05"), ("june", "06"),
    ("july", "07"), ("august", "08"), ("september", "09"), ("october", "10"), ("november", "11"), ("december", "12"),
    ("jan", "01"), ("feb", "02"), ("mar", "03"), ("apr", "04"), ("jun", "06"), ("jul", "07"), ("aug", "08"),
    ("sep", "09"), ("oct", "10"), ("nov", "11"), ("dec", "12"),
)


def month_of(x: Column) -> Column:
    """``YYYY-MM`` where a month name and a year, or a numeric date, is given; else the plain text.

    The first month of the table that occurs anywhere in the text counts.
    """
    months = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("number")) for n, m in MONTHS])
    numeric = r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$"

    def of(text: Column) -> Column:
        year = F.regexp_extract(text, r"(\d{4})", 1)
        month = F.get(F.filter(months, lambda m: F.contains(text, m.getField("name"))), F.lit(0)).getField("number")
        padded = F.lpad(F.regexp_extract(text, numeric, 2), 2, "0")
        return (
            F.when((year != "") & month.isNotNull(), F.concat(year, F.lit("-"), month))
            .when(text.rlike(numeric), F.concat(F.regexp_extract(text, numeric, 1), F.lit("-"), padded))
            .otherwise(text)
        )

    plain = stripped(F.replace(stripped(F.lower(x)), F.lit("**"), F.lit("")))
    return F.get(F.transform(F.array(plain), of), F.lit(0))


def same_date(a: Column, b: Column) -> Column:
    return month_of(a) == month_of(b)
