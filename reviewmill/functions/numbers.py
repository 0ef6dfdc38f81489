"""Number expressions: coercion, rating labels, vectors and percent texts."""

from pyspark.sql import Column, functions as F

from reviewmill.functions.lexicon import LABEL_NAMES, NEGATIVE, POSITIVE, UNKNOWN
from reviewmill.functions.text import strip

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_PATTERN = r"^[+-]?(?i:inf|infinity)$"


def to_number(col: Column) -> Column:
    """Text as double, null where it is not a plain number.

    The pattern keeps out texts that a cast accepts but a reader would not call
    numbers (`4d`, `nan`); a number too large for a double is null as well. A text
    that does not match is extracted as '' and casts to null.
    """
    text = strip(col.cast("string"))
    number = F.regexp_extract(text, NUMBER_PATTERN, 0).try_cast("double")
    finite = F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))
    return F.coalesce(finite, F.regexp_extract(text, INFINITY_PATTERN, 0).try_cast("double"))


def label_from_rating(rating: Column) -> Column:
    """1 from four stars up, 0 up to two stars, null between and without a rating."""
    return F.when(rating >= 4, F.lit(POSITIVE)).when(rating <= 2, F.lit(NEGATIVE))


def label_name(label: Column) -> Column:
    name = F
    for value, text in LABEL_NAMES.items():
        name = name.when(label == value, F.lit(text))
    return name.otherwise(F.lit(UNKNOWN))


def round_half_up(col: Column, digits: int) -> Column:
    """Rounding by floor, so that every engine cuts at the same place."""
    scale = F.lit(float(10 ** digits))
    return F.floor(col * scale + F.lit(0.5)).cast("double") / scale


def percent_text(share: Column, digits: int = 1) -> Column:
    """`0.873` as `87.3%`."""
    scale = 10 ** digits
    units = F.floor(share * F.lit(100.0 * scale) + F.lit(0.5)).cast("long")
    whole = F.floor(units / F.lit(scale)).cast("string")
    part = F.lpad((units % scale).cast("string"), digits, "0")
    return F.concat(whole, F.lit("."), part, F.lit("%"))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0),
                              lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(vector: Column, norm: Column) -> Column:
    """Vector over its norm; a norm under 1e-12 counts as one."""
    divisor = F.when(norm < 1e-12, F.lit(1.0)).otherwise(norm)
    return F.transform(vector, lambda x: x.cast("double") / divisor)


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
