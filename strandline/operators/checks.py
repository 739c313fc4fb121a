"""Three-valued checks: true passes, false fails, null is not set."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Checks of guides (all others are checks of hits), and the standard ones.
GUIDE_CHECKS = ("background", "GC", "exclude")
STANDARD_CHECKS = ("background", "GC", "exclude", "CDS", "feature")


def encoded(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("pass", "true"), True).when(low.isin("fail", "false"), False)


def decoded(check: Column) -> Column:
    return F.when(check, "pass").when(~check, "fail").otherwise("NA")


def with_check(df: DataFrame, name: str, value: Column | Callable[[Column], Column], key: str = "grna") -> DataFrame:
    """``df`` with a check set by a condition, or by a function of the column ``key``; the
    function may be built of Spark functions or be a pandas UDF."""
    return df.withColumn(name, value if isinstance(value, Column) else value(F.col(key)))


def with_check_for(df: DataFrame, name: str, keys: DataFrame, value: bool, key: str = "grna") -> DataFrame:
    """``df`` with a check set to ``value`` in rows whose ``key`` stands in ``keys``, whatever
    the case; other rows keep theirs (null where the check is new)."""
    listed = keys.select(F.upper(key).alias("key__")).distinct().withColumn("set__", F.lit(value))
    old = F.col(name) if name in df.columns else F.lit(None).cast("boolean")
    return df.join(listed, F.upper(key) == F.col("key__"), "left").withColumn(name, F.coalesce("set__", old)).drop("key__", "set__")


def cleared(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the named checks (default: all boolean columns) not set."""
    names = [c for c, kind in df.dtypes if kind == "boolean"] if names is None else names
    return df.withColumns({c: F.lit(None).cast("boolean") for c in names})


def passed(checks: Sequence[Column], lenient: bool = False) -> Column:
    """All checks pass; what is not set fails, or passes if ``lenient``."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(lenient))
    return out


def status(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(check, n_set, n_unset, n_fail) of each check."""
    rows = df.unpivot([], list(names), "check", "value")
    return rows.groupBy("check").agg(F.count("value").alias("n_set"), F.count_if(F.col("value").isNull()).alias("n_unset"), F.count_if(~F.col("value")).alias("n_fail"))


def validity(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(check, valid, partly): set in at least one row; set in some rows but not in all."""
    return status(df, names).select("check", (F.col("n_set") > 0).alias("valid"), ((F.col("n_set") > 0) & (F.col("n_unset") > 0)).alias("partly"))


def check_names(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """(check, everywhere): the names in the maps of ``checks``, and whether all rows have them."""
    named = rows.select(F.explode(F.map_keys(checks)).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    return named.crossJoin(F.broadcast(total)).select("check", (F.col("n") == F.col("rows")).alias("everywhere"))  # one row


def _in_use(df: DataFrame, names: Sequence[str], skip_unset: bool) -> list[str]:
    """Names that are columns, without those that no row sets (one aggregate of one row)."""
    known = [n for n in names if n in df.columns]
    if skip_unset and known:
        never = df.agg(*[F.count(n).alias(n) for n in known]).first()
        known = [n for n in known if never[n]]
    return known


def filtered(df: DataFrame, names: Sequence[str], lenient: bool = False, skip_unset: bool = True) -> DataFrame:
    """Rows that pass the named checks; names that are no columns are skipped, and with
    ``skip_unset`` so are checks that no row sets."""
    return df.where(passed([F.col(n) for n in _in_use(df, names, skip_unset)], lenient))


def filtered_hits(guides: DataFrame, hits: DataFrame, names: Sequence[str], lenient: bool = False, skip_unset: bool = True, drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """Guides and hits, the hits strictly by the named checks; ``drop_empty``: guides left
    without a hit go too."""
    kept = filtered(hits, names, lenient, skip_unset)
    return (guides.join(kept.select("grna").distinct(), "grna", "left_semi") if drop_empty else guides), kept


def filtered_guides(guides: DataFrame, hits: DataFrame, names: Sequence[str], lenient: bool = True, skip_unset: bool = True) -> tuple[DataFrame, DataFrame]:
    """Guides by the named checks (what is not set passes, unless strict), and their hits."""
    kept = filtered(guides, names, lenient, skip_unset)
    return kept, hits.join(kept.select("grna").distinct(), "grna", "left_semi")


def valid_guides(guides: DataFrame, hits: DataFrame, names: Sequence[str] | None = None, lenient: bool = False, accept_unknown_feature: bool = False, skip_unset: bool = True) -> tuple[DataFrame, DataFrame]:
    """Guides and hits that pass the checks of guides (``GUIDE_CHECKS``) and then those of
    hits (all others); guides left without a hit go.  Default: every boolean column of both.
    ``standard`` and ``nonstandard`` stand for the checks of these kinds."""
    extant = [c for df in (guides, hits) for c, kind in df.dtypes if kind == "boolean"]
    wanted = list(extant if names is None else names)
    for word, kind in (("standard", True), ("nonstandard", False)):
        if word in wanted:
            wanted.remove(word)
            wanted += [c for c in extant if (c in STANDARD_CHECKS) == kind]
    of_guides = [c for c in dict.fromkeys(wanted) if c in GUIDE_CHECKS]
    of_hits = [c for c in dict.fromkeys(wanted) if c not in GUIDE_CHECKS]
    guides, hits = filtered_guides(guides, hits, of_guides, lenient, skip_unset)
    return filtered_hits(guides, hits, of_hits, lenient or accept_unknown_feature, skip_unset)
