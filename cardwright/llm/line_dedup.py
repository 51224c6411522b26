"""Site-relative line dedup with DataFrame functions only.

A line's share of a site is the number of the site's pages that contain it divided by the number of the site's pages.
Lines above a given share are boilerplate and are cut from every page of that site.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, written

#: Entries of the boilerplate list up to which it is broadcast (a line's 16-byte key each); above, a shuffle join is used.
BROADCAST_LINES = 500_000


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    """128 bits of a trimmed line: 64-bit hashes of it and of it behind a prefix, which shifts its blocks, so neither follows from the other."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.concat(F.lit("line:"), line)).alias("b"))


def host(url: Column) -> Column:
    """The site of an address: the lower-cased host without a leading "www."; what is no address stays as it is."""
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")).otherwise(url)


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """(site, lines): for each site with boilerplate the keys of its lines on more than ``max_ratio`` of its pages.

    A line counts once a page, trimmed of spaces, tabs and carriage returns; blank lines never count. A line must be on
    ``min_pages`` pages at least, so small sites lose nothing by chance. Each row is a page, repeated rows too; null is a
    site of its own; pages without text count for the site's total. Where the site is an address, its host counts. A site's list holds fewer keys than its mean number
    of lines a page divided by ``max_ratio``, so collecting it is bounded.
    """
    pages = docs.select(host(F.col(site).cast("string")).alias("site"), F.col(text).alias("text"))
    lines = pages.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _trimmed))).alias("line")).where("line != ''")
    common = lines.groupBy("site", _key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    joined = common.alias("c").join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site")))
    return joined.where(F.col("n") > max_ratio * F.col("total")).groupBy("c.site").agg(F.collect_list("key").alias("lines"))


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 5, spare_copies: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and n_lines and n_dropped beside its columns.

    Lines keep their order, blank lines stay. Null text stays null with 0 lines; the empty text is one blank line. Extra
    columns pass through; where one is named n_lines or n_dropped, the new one gets a leading underscore.
    With ``spare_copies``, a page all of whose non-blank lines are boilerplate is left whole if another such page of its site
    has the same text: these are copies, of which a stage on duplicates keeps one. All other pages are cut.
    """
    found = written(boilerplate(docs, site, text, max_ratio, min_pages), "boilerplate")
    small = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_LINES
    key, bad = free_name(docs, "boilerplate_site"), free_name(docs, "boilerplate_lines")
    found = found.select(F.col("site").alias(key), F.col("lines").alias(bad))
    joined = docs.join(F.broadcast(found) if small else found, host(docs[site].cast("string")).eqNullSafe(found[key]), "left")
    lines = F.split(F.col(text), "\n")
    good = lambda line: (_trimmed(line) == "") | ~F.array_contains(F.col(bad), _key(_trimmed(line)))
    kept = F.when(F.col(bad).isNotNull(), F.filter(lines, good)).otherwise(lines)
    if spare_copies:
        some = lambda x: F.exists(x, lambda line: _trimmed(line) != "")
        all_bad = F.col(bad).isNotNull() & some(lines) & ~some(kept)
        digest, twin_site, twin = (free_name(docs, f"boilerplate_{c}") for c in ("digest", "twin_site", "twin"))
        joined = joined.withColumn(digest, F.when(all_bad, F.sha2(text, 256)))
        twins = joined.where(F.col(digest).isNotNull()).groupBy(F.col(key).alias(twin_site), F.col(digest).alias(twin)).agg(F.count("*").alias("n")).where("n > 1")
        twins = written(twins.drop("n"), "boilerplate-copies")
        few = twins.count() <= BROADCAST_LINES
        joined = joined.join(F.broadcast(twins) if few else twins, (F.col(digest) == F.col(twin)) & F.col(key).eqNullSafe(F.col(twin_site)), "left")
        kept = F.when(F.col(twin).isNotNull(), lines).otherwise(kept)
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = joined.withColumn(bad, F.when(F.col(text).isNotNull(), kept))
    return out.select(
        *(F.array_join(bad, "\n").alias(c) if c == text else F.col(c) for c in docs.columns),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(bad)).cast("long").alias(n_dropped),
    )
