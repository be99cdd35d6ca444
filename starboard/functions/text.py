"""Title and genre expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from starboard.schemas import GENRE_SEPARATOR, YEAR_ANYWHERE, YEAR_AT_END


def year_anywhere(title: Column) -> Column:
    """The first four digits in brackets, wherever they stand."""
    return F.nullif(F.regexp_extract(title, YEAR_ANYWHERE, 1), F.lit("")).cast("int")


def year_anchored(title: Column) -> Column:
    """Four digits in brackets, only as the last thing in the (untrimmed) title."""
    return F.nullif(F.regexp_extract(title, YEAR_AT_END, 1), F.lit("")).cast("int")


def lacks_year_suffix(title: Column) -> Column:
    """True for a title that does not end in a year; NULL for a NULL title."""
    return ~title.rlike(YEAR_AT_END)


def split_genres(genres: Column) -> Column:
    """NULL stays NULL (so explode drops the row); '' becomes an array of one ''."""
    return F.split(genres, "\\" + GENRE_SEPARATOR)


def genre_matches(genres: Column, needle: str) -> Column:
    """Case-insensitive substring test; % and _ have no special meaning."""
    return F.contains(F.lower(genres), F.lit(needle.lower()))


def year_label(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("N/A"))


def genres_label(genres: Column) -> Column:
    return F.coalesce(genres, F.lit(""))
