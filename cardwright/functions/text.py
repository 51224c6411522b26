"""Column functions with the text and number semantics of the service whose results this library has to match.

Differences from Spark's own functions that matter: trimming removes all white space, rounding takes halves upwards, word
borders are ASCII, and numbers are read from the beginning of a text.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as no value. Fixed values.
PLACEHOLDERS = ("", "unknown", "n/a", "—", "-", "null", "none")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once however often ``f`` names it; a plain expression is copied into each place, and copies of copies outgrow the driver."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: White space that trimming removes, beyond the six ASCII ones. Fixed values.
SPACES = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_all(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{SPACES}]+|[{SPACES}]+$", "")


def norm(c: Column | str) -> Column:
    """Null as the empty text, trimmed, lower case."""
    return F.lower(trim_all(F.coalesce(_col(c), F.lit(""))))


def squash(c: Column | str) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"\s+", "")


def has_value(c: Column | str) -> Column:
    """Present and no placeholder."""
    return F.coalesce(~norm(c).isin(*PLACEHOLDERS) & _col(c).isNotNull(), F.lit(False))


def has_text(c: Column | str) -> Column:
    """Present and not blank; placeholders count."""
    return F.coalesce(trim_all(c) != "", F.lit(False))


def hits(text: Column | str, keyword: Column | str) -> Column:
    """Places of a keyword that do not overlap, case folded. Both are columns or, as a keyword, a Python text."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    if isinstance(keyword, str):
        return ((F.length(t) - F.length(F.replace(t, F.lit(keyword.lower()), F.lit("")))) / len(keyword)).cast("int")
    k = F.lower(keyword)
    return ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("int")


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits."""
    x = F.floor(_col(c) * float(10**digits) + 0.5).cast("double")
    return x / float(10**digits) if digits else x


def percent(n: Column, total: Column) -> Column:
    """Rounded per cent, 0 for no total."""
    return F.when(total == 0, 0.0).otherwise(round_half_up(n.cast("double") / F.nullif(total, F.lit(0)) * 100))


def parse_number(c: Column | str) -> Column:
    """struct(num, ok): the whole text as a number, or else the first decimal number in it; blank is 0 and ok; none is 0 and not ok."""
    return let(trim_all(F.coalesce(_col(c), F.lit(""))), _number)


def _number(t: Column) -> Column:
    based = F.coalesce(
        F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 100), 16, 10)),
        F.when(t.rlike("^0[bB][01]+$"), F.conv(F.substring(t, 3, 100), 2, 10)),
        F.when(t.rlike("^0[oO][0-7]+$"), F.conv(F.substring(t, 3, 100), 8, 10)),
    )
    whole = F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")).otherwise(based.try_cast("double"))
    first = F.nullif(F.regexp_extract(t, r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0), F.lit("")).try_cast("double")
    # 1e999 reads as infinity, which is not accepted
    finite = lambda c: let(c, lambda x: F.when(F.abs(x) < float("inf"), x))
    return let(F.coalesce(finite(whole), finite(first)), lambda num: F.struct(F.coalesce(num, F.lit(0.0)).alias("num"), num.isNotNull().alias("ok")))


def leading_number(c: Column | str) -> Column:
    """The number that a text begins with after white space, or null."""
    return F.nullif(F.regexp_extract(_col(c), rf"^[{SPACES}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def csv_cell(c: Column | str) -> Column:
    """Trimmed; quoted if it holds a comma, quote or line end, quotes doubled."""
    t = trim_all(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(t.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def slug(c: Column | str, length: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), 1, length), "_+$", "")


def regex_quoted(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def has_word(text: Column | str, word: Column | str) -> Column:
    r"""Whether ``word`` occurs with ASCII word borders (\b) on both sides."""
    w = _col(word)
    edge = lambda inner: F.when(inner.rlike("^[A-Za-z0-9_]"), F.lit("(?<![A-Za-z0-9_])")).otherwise(F.lit("(?<=[A-Za-z0-9_])"))
    tail = F.when(w.rlike("[A-Za-z0-9_]$"), F.lit("(?![A-Za-z0-9_])")).otherwise(F.lit("(?=[A-Za-z0-9_])"))
    return F.regexp_like(_col(text), F.concat(edge(w), regex_quoted(w), tail))


def identifiers(c: Column | str, skip: tuple[str, ...] = ()) -> Column:
    """ASCII identifiers of a text, each once, in order of appearance, without those of ``skip``."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, skip))) if skip else found


def capped(c: Column | str, longest: int = 90, kept: int = 87) -> Column:
    """A text of more than ``longest`` characters is cut to ``kept`` and three dots."""
    return F.when(F.length(_col(c)) > longest, F.concat(F.substring(_col(c), 1, kept), F.lit("..."))).otherwise(_col(c))


def first_line(c: Column | str) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    # from the first character that is no space to the end of its line: the rest of the text is not read
    return F.nullif(trim_all(F.regexp_extract(_col(c), f"^[{SPACES}]*+([^\\r\\n]*)", 1)), F.lit(""))


def js_number(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", _col(c))
