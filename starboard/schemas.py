"""Row shapes and fixed values of the ratings domain."""

from pyspark.sql import types as T

RAW_MOVIES = T.StructType(
    [
        T.StructField("movieId", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
    ]
)

# rating is DOUBLE, not FLOAT: averages of floats drift (3.7f is 3.700000047...).
RAW_RATINGS = T.StructType(
    [
        T.StructField("userId", T.IntegerType()),
        T.StructField("movieId", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

CLEANED_MOVIES = T.StructType(
    [
        T.StructField("movieId", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("genres_array", T.ArrayType(T.StringType())),
        T.StructField("genres", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
    ]
)

CLEANED_RATINGS = T.StructType(
    [
        T.StructField("userId", T.IntegerType()),
        T.StructField("movieId", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("rating_date", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("rating_year", T.IntegerType()),
        T.StructField("rating_month", T.IntegerType()),
    ]
)

QUALITY_REPORT = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("check_type", T.StringType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("invalid_records", T.LongType()),
        T.StructField("valid_records", T.LongType()),
        T.StructField("invalid_percentage", T.DoubleType()),
        T.StructField("check_timestamp", T.StringType()),
    ]
)

MOVIE_STATISTICS = T.StructType(
    [
        T.StructField("movieId", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("genres", T.StringType()),
        T.StructField("rating_count", T.LongType()),
        T.StructField("avg_rating", T.DoubleType()),
    ]
)

USER_RECOMMENDATIONS = T.StructType(
    [
        T.StructField("userId", T.IntegerType()),
        T.StructField("movieId", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("genres", T.StringType()),
        T.StructField("predicted_rating", T.FloatType()),
    ]
)

# CSV options. Quotes inside a field are doubled. An empty field is NULL and a quoted empty
# one is '', which takes a null marker other than '' when reading.
CSV_READ = {"escape": '"', "nullValue": "\\N"}
CSV_WRITE = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

RATING_PARTITIONS = ["rating_year", "rating_month"]

# Fixed values.
MIN_RATING = 0.5
MAX_RATING = 5.0
NO_GENRES = "(no genres listed)"
GENRE_SEPARATOR = "|"
YEAR_ANYWHERE = r"\((\d{4})\)"
YEAR_AT_END = r"\((\d{4})\)$"
TOP_MIN_RATINGS = 100
TOP_N = 1000
GENRE_MIN_RATINGS = 50
GENRE_TOP_K = 50
ALS_RANK = 10
ALS_ITERATIONS = 10
ALS_REGULARISATION = 0.1
TRAIN_SHARE = 0.8
SEED = 42
PAGE_SIZE = 20
VALID_TARGET_PERCENT = 95
