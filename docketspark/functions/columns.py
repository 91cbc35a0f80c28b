"""Column functions: cleaning, dates, rates. All run inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.config import NULL_WORDS, REGIONS


#: Fixed value: all white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def known(c: Column) -> Column:
    """Null for what stands for null; it comes before trimming, so two spaces become an empty string."""
    return F.when(~c.isin(" ", "", *NULL_WORDS), c)


def clean_strings(df: DataFrame) -> DataFrame:
    """Every string column with nulls recognised and trimmed, every column name trimmed."""
    columns = [(trimmed(known(F.col(f"`{n}`"))) if t == "string" else F.col(f"`{n}`")).alias(n.strip()) for n, t in df.dtypes]
    return df.select(columns)


def day(c: Column, pattern: str = "d/M/yyyy") -> Column:
    """A date, or null where the text is none."""
    return F.try_to_date(c, pattern) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(c, F.lit(pattern)))


def number(c: Column) -> Column:
    return c.try_cast("double")


def day_number(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def calendar(c: Column) -> dict[str, Column]:
    """Month, day, weekday (Monday 0), ISO week, day of the year, year."""
    return {
        "month": F.month(c), "day": F.dayofmonth(c), "weekday": F.weekday(c),
        "week": F.weekofyear(c), "yearday": F.dayofyear(c), "year": F.year(c),
    }


def age(on: Column, born: Column, least: float = 10, most: float = 110) -> Column:
    """Years with one decimal; null outside the bounds."""
    years = F.round(F.datediff(on, born) / 365.25, 1)
    return F.when(years.between(least, most), years)


def same(a: Column, b: Column) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce(a == b, F.lit(False)).cast("int")


def region(state: Column) -> Column:
    pairs = [x for name, states in REGIONS.items() for s in states for x in (F.lit(s), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), state)


def same_region(a: Column, b: Column) -> Column:
    return same(region(a), region(b))


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds {column}_missing, 1 where null, for each column, and `complete`, 1 where none is."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    none = F.lit(True)
    for c in columns:
        none = none & F.col(c).isNotNull()
    return df.withColumns(flags | {"complete": none.cast("int")})


def flag(c: Column, yes: str) -> Column:
    return same(c, F.lit(yes))


def ratio(part: Column, whole: Column, otherwise: float | None = None) -> Column:
    """part / whole where whole is over 0."""
    out = F.when(whole > 0, part / whole)
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def smoothed(total: Column, n: Column, base: Column, prior: float) -> Column:
    return (total + F.lit(float(prior)) * base) / (n + F.lit(float(prior)))


def binned(x: Column, edges: Iterable[float], labels: Iterable[str]) -> Column:
    """The label of the bin (low, high] that holds x; null outside all bins."""
    edges, out = list(edges), F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = F.when((x > low) & (x <= high), label).otherwise(out)
    return out


def share_text(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.2f%%", 100.0 * part / whole)).otherwise("-")


#: The printed form of a taxpayer number, and its digits alone.
CPF, ELEVEN = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", r"\b\d{11}\b"
#: Fields of a person's record: name of the finding, name of the field, and how a value must begin to count (nothing: the name alone counts).
PERSONAL_FIELDS = (("requester", "IdSolicitante", ""), ("birth_date", "DataNascimento", r"\d"))


def _field(name: str, begin: str) -> str:
    """A field's name as a word; with `begin`, only where a quoted value that begins so follows, the name's own quote aside."""
    return rf"\b{name}\b" + (rf'"?\s*:\s*"{begin}' if begin else "")


#: Personal data that an artifact must not hold. A mail address is a local part, then labels of a domain with a dot between them.
PERSONAL = {
    "cpf": CPF, "eleven_digits": ELEVEN, "e_mail": r"[0-9A-Za-z_.%+-]+@[0-9A-Za-z-]+([.][0-9A-Za-z-]+)+",
    **{finding: _field(name, begin) for finding, name, begin in PERSONAL_FIELDS},
}


def personal_data(c: Column) -> Column:
    """Names of the patterns that the text holds."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in PERSONAL.items()]))


def interpolated(x: Column, grid: list[float], image: list[float]) -> Column:
    """Piecewise linear through (grid, image), an even grid, clamped at its ends."""
    first, step, last = grid[0], (grid[-1] - grid[0]) / (len(grid) - 1), len(grid) - 2
    at = F.least(F.greatest(F.floor((x - first) / step), F.lit(0)), F.lit(last)).cast("int")
    g, y = F.array(*map(F.lit, grid)), F.array(*map(F.lit, image))
    low, high = F.get(y, at), F.get(y, at + 1)
    part = F.least(F.greatest((x - F.get(g, at)) / (F.get(g, at + 1) - F.get(g, at)), F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNotNull(), low + (high - low) * part)
