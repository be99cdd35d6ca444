"""Row tests that are always TRUE or FALSE, never NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from starboard.schemas import MAX_RATING, MIN_RATING, NO_GENRES


def missing_text(text: Column) -> Column:
    return text.isNull() | (text == "")


def missing_genres(genres: Column) -> Column:
    return missing_text(genres) | (genres == NO_GENRES)


def movie_is_valid(item: Column, title: Column, genres: Column) -> Column:
    return ~(item.isNull() | missing_text(title) | missing_genres(genres))


def rating_out_of_range(rating: Column) -> Column:
    """NULL for a NULL rating: it is missing, not out of range."""
    return (rating < MIN_RATING) | (rating > MAX_RATING)


def rating_is_valid(user: Column, item: Column, rating: Column, time: Column) -> Column:
    present = user.isNotNull() & item.isNotNull() & rating.isNotNull() & time.isNotNull()
    return F.coalesce(present & rating.between(MIN_RATING, MAX_RATING), F.lit(False))
