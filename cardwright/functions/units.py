"""Units as dimension exponents (mass, volume, time, amount), and equation texts in a normal form; columns only."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardwright.functions.text import let, trim_all

DIM = "struct<M:double,V:double,T:double,N:double>"
#: Base units by dimension, and texts without dimension. Fixed values.
BASE_UNITS = {"M": ("g", "kg", "mg"), "V": ("l", "ml", "m3", "dm3"), "T": ("h", "hr", "hour", "min", "s", "sec", "d", "day"), "N": ("mol", "mmol")}
NO_DIMENSION = ("", "-", "—", "none", "dimensionless", "1", "ratio")
#: Rewrites of a lower-case unit without white space, in order. Fixed values.
UNIT_REWRITES = (
    ("⁻¹", "^-1"), ("⁻²", "^-2"), ("⁻³", "^-3"), ("·", "*"), (r"(?<![A-Za-z0-9_])cdw(?![A-Za-z0-9_])", ""), (r"(?<![A-Za-z0-9_])vss(?![A-Za-z0-9_])", ""),
    (r"(?<![A-Za-z0-9_])dm(?![A-Za-z0-9_])", "l"), (r"(?<![A-Za-z0-9_])([gk])[_\-]?[xs](?![A-Za-z0-9_])", "$1"), (r"([a-z]+)-1(?![A-Za-z0-9_])", "$1^-1"),
)
#: Letters of an equation's text that are spelt out.
GREEK = {"μ": "mu", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}
#: Rewrites of an equation's text after that, in order; then it is trimmed and lower-cased. Fixed values.
EQUATION_REWRITES = (
    (r"(?i)\\mu(?![A-Za-z0-9_])", "mu"), (r"(?i)\\alpha(?![A-Za-z0-9_])", "alpha"),
    (r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "(($1)/($2))"), (r"(?i)\\cdot(?![A-Za-z0-9_])|\\times(?![A-Za-z0-9_])", "*"), (r"\\left\s*\(|\\right\s*\)", ""),
    (r"\\mathrm\s*\{([^}]+)\}", "$1"), (r"\\text\s*\{([^}]+)\}", "$1"), (r"\\mathbf\s*\{([^}]+)\}", "$1"), (r"([A-Za-z0-9])\s*_\s*\{([^}]+)\}", "$1_$2"), (r"\{([^}]+)\}", "$1"), (r"\s+", " "),
)


def dim(m: float = 0, v: float = 0, t: float = 0, n: float = 0) -> Column:
    return F.struct(*(F.lit(float(x)).alias(k) for k, x in zip("MVTN", (m, v, t, n), strict=True)))


RATE = (0, 0, -1, 0)


def is_dim(c: Column, m: float = 0, v: float = 0, t: float = 0, n: float = 0) -> Column:
    return let(c, lambda c: (c["M"] == m) & (c["V"] == v) & (c["T"] == t) & (c["N"] == n))


def same_dim(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: reduce(lambda p, q: p & q, (x["a"][k] == x["b"][k] for k in "MVTN")))


def minus(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.struct(*((x["a"][k] - x["b"][k]).alias(k) for k in "MVTN")))


def parse_unit(c: Column | str) -> Column:
    """The exponents of a unit, null if a part of it is unknown; null and blank units have no dimension. Scales are ignored."""
    u = F.regexp_replace(F.lower(trim_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), r"\s+", "")
    for pattern, to in UNIT_REWRITES:
        u = F.regexp_replace(u, pattern, to)
    return let(u, lambda u: F.when(u.isin(*NO_DIMENSION), dim()).otherwise(let(_factors(u), lambda f: F.when(F.forall(f, lambda x: x.isNotNull()), F.aggregate(f, dim(), lambda a, x: F.struct(*((a[k] + x[k]).alias(k) for k in "MVTN")))))))


def _factors(u: Column) -> Column:
    """The exponents of a rewritten unit's factors, null for one that is unknown."""
    # an exponent may have exponents itself: all are multiplied
    powers = lambda token: F.regexp_extract(token, r"((?:\^-?\d+(?:\.\d+)?)*)$", 1)
    power = lambda token: F.aggregate(F.filter(F.split(powers(token), r"\^"), lambda x: x != ""), F.lit(1.0), lambda a, x: a * x.cast("double"))
    known = lambda b: F.coalesce(*(F.when(b.isin(*names), F.lit(k)) for k, names in BASE_UNITS.items()), F.when(b == "1", F.lit("")))

    def one(token: Column, sign: Column) -> Column:
        read = F.struct(let(F.regexp_replace(token, r"(?:\^-?\d+(?:\.\d+)?)*$", ""), known).alias("base"), (power(token) * sign).alias("power"))
        return let(read, lambda x: F.when(x["base"].isNotNull() & x["power"].isNotNull(), F.struct(*(F.when(x["base"] == k, x["power"]).otherwise(0.0).alias(k) for k in "MVTN"))))

    return F.flatten(F.transform(F.split(u, "/"), lambda part, i: F.transform(F.split(part, r"\*"), lambda token: one(token, F.when(i == 0, 1.0).otherwise(-1.0)))))


def label(c: Column) -> Column:
    """Exponents as text, such as M·V^-1; - without dimension."""
    part = lambda c, k: F.when(c[k] == 1, F.lit(k)).when(c[k] != 0, F.concat(F.lit(f"{k}^"), F.format_string("%s", F.when(c[k] == F.floor(c[k]), c[k].cast("int").cast("string")).otherwise(c[k].cast("string")))))
    text = lambda c: F.when(c.isNotNull(), F.concat_ws("·", *(part(c, k) for k in "MVTN")))
    return let(let(c, text), lambda t: F.when(t == "", "-").otherwise(t))


def normal_equation(c: Column | str) -> Column:
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for letter, to in GREEK.items():
        t = F.replace(t, F.lit(letter), F.lit(to))
    for pattern, to in EQUATION_REWRITES:
        t = F.regexp_replace(t, pattern, to)
    return F.lower(trim_all(t))


def matched(text: Column, pattern: str, groups: int) -> Column:
    """Array of a pattern's groups at its first place, null where it has none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array(*(F.regexp_extract(text, pattern, k) for k in range(1, groups + 1))))
