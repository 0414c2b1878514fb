"""Column-level data quality profile by character-class masks.

Every value is generalised to a mask: a run of letters (with their combining
marks) becomes ``L``, a run of the digits 0-9 becomes ``9``, other numbers ``n``,
a stray combining mark ``m``, white space other than the blank ``_``; everything
else stands for itself. Blanks aren't collapsed. A flag tells whether the value
is longer than the column allows. A declared form of a column must be decidable
on this mask, and all forms below are.

Plan: one aggregation to distinct (feed, load, column, value) with its count,
with map-side combine, so a value that fills a third of the table costs one row a
task. Masks are computed on distinct values only. The dominant masks of a column
are those with a share of at least ``min_share`` of its values, hence at most
``1 / min_share`` of them: this proven bound is what makes broadcasting them safe
at any size. Rows are then held against the dominant masks; the rest, the rare
masks, is what gets the exact check of the form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import is_missing, strip
from statloom.session import durable

_WORD = r"\p{L}[\p{L}\p{M}\-'’.]*"


@dataclass(frozen=True)
class ColumnForm:
    """What a column's values look like.

    form: a Java regular expression that a good value matches as a whole.
    max_len: the most code points a good value has, or None.
    share: the value is a share of one, written as a fraction or per cent.
    """

    form: str
    max_len: int | None = None
    share: bool = False


FORMS = {
    "referee": ColumnForm(rf"^{_WORD}( {_WORD}){{1,3}}$"),
    "stadium": ColumnForm(
        r"^(?=[^\p{L}]*\p{L})(?! )(?!.* $)(?!.*  )[\p{L}\p{M}0-9 .'’&\-]{1,60}$", max_len=60
    ),
    "possession_home": ColumnForm(r"^-?[0-9]+(\.[0-9]+)?( ?%)?$", share=True),
}


def mask(value: Column, max_len: int | None = None) -> Column:
    """The character-class mask of a text."""
    m = F.regexp_replace(value, r"\p{L}[\p{L}\p{M}]*", "\u0001")
    m = F.regexp_replace(m, r"\p{M}+", "\u0002")
    m = F.regexp_replace(m, r"[0-9]+", "\u0003")
    m = F.regexp_replace(m, r"\p{N}+", "\u0004")
    m = F.regexp_replace(m, r"(?U)[\s&&[^ ]]", "\u0005")
    m = F.translate(m, "\u0001\u0002\u0003\u0004\u0005", "Lm9n_")
    if max_len is not None:
        m = F.when(F.char_length(value) > max_len, F.concat(m, F.lit("…"))).otherwise(m)
    return m


def conforms(value: Column, form: str) -> Column:
    # (?s) so that a line break can't hide the end, \z so that one can't follow it
    return value.rlike("(?s)" + form[:-1] + r"\z")


def as_share(value: Column) -> Column:
    """A value of the share form as a number; NULL for any other text."""
    x = F.regexp_extract(value, r"^(-?[0-9]+(?:\.[0-9]+)?)(?: ?%)?\z", 1)
    d = F.when(x != "", x).try_cast("double")
    return F.when(value.contains("%") | (d > 1), d / 100).otherwise(d)


def _long(df: DataFrame, columns: list[str], carry: dict[str, str]) -> DataFrame:
    """One row per cell: the carried columns (new name: old name), column_name, value. No shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    return df.select(*[F.col(old).alias(new) for new, old in carry.items()], F.explode(cells).alias("x")).select(
        *carry, F.col("x.c").alias("column_name"), F.col("x.v").alias("value")
    )


def _mask_of(forms: dict[str, ColumnForm]) -> Column:
    m = mask(F.col("value"))
    for name, f in forms.items():
        if f.max_len is not None:
            m = F.when(F.col("column_name") == name, mask(F.col("value"), f.max_len)).otherwise(m)
    return m


def inventory(df: DataFrame, columns: list[str], feed: str, load: str, forms: dict[str, ColumnForm] = FORMS) -> DataFrame:
    """(feed, load, column_name, value, n, missing, mask): the distinct values of each load.

    Written once to the shared folder, since the masks and the profile read it many times.
    """
    own = _long(df, columns, {"feed": feed, "load": load}).groupBy("feed", "load", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("missing", is_missing(F.col("value"))).withColumn("mask", F.when(~F.col("missing"), _mask_of(forms)))
    return durable(own)


def mine_masks(inv: DataFrame, min_share: float = 0.002) -> DataFrame:
    """(column_name, mask, n, share, dominant, exemplar) over all loads."""
    per = inv.filter(~F.col("missing")).groupBy("column_name", "mask").agg(F.sum("n").alias("n"), F.min("value").alias("exemplar"))
    total = inv.filter(~F.col("missing")).groupBy("column_name").agg(F.sum("n").alias("total"))  # one row a column
    per = per.join(F.broadcast(total), "column_name").withColumn("share", F.col("n") / F.col("total"))
    return per.select("column_name", "mask", "n", "exemplar", "share", (F.col("share") >= min_share).alias("dominant"))


def _form_ok(forms: dict[str, ColumnForm], value: Column) -> Column:
    """Whether a value is of its column's form; NULL for a column without one."""
    ok = F.lit(None).cast("boolean")
    for name, f in forms.items():
        ok = F.when(F.col("column_name") == name, conforms(value, f.form)).otherwise(ok)
    return ok


def violations(df: DataFrame, columns: list[str], row_key: str, inv: DataFrame, forms: dict[str, ColumnForm] = FORMS, min_share: float = 0.002) -> DataFrame:
    """(finding, column_name, ref_id): rows with a value that isn't of its column's form, or a share outside 0 to 1.

    A value whose mask is dominant and whose mask's exemplar conforms is good
    (the form is a function of the mask). All others are candidates and get the
    exact check. Missing values, NULL or marker, are never violations; an empty
    table gives no rows.
    """
    good = mine_masks(inv, min_share).filter("dominant").withColumn("ok", _form_ok(forms, F.col("exemplar"))).filter("ok")
    rows = _long(df, columns, {"row_key": row_key}).filter(~is_missing(F.col("value"))).withColumn("mask", _mask_of(forms))
    # at most 1 / min_share masks a column: bounded whatever the table's size
    rows = rows.join(F.broadcast(good.select("column_name", "mask", F.lit(True).alias("good"))), ["column_name", "mask"], "left")
    ranged = [c for c in columns if c in forms and forms[c].share]
    outside = F.col("column_name").isin(*ranged) & ~as_share(F.col("value")).between(0, 1) if ranged else F.lit(False)
    found = F.array(F.when(F.col("good").isNull() & ~_form_ok(forms, F.col("value")), "pattern"), F.when(outside, "range"))
    return rows.select(F.explode(F.array_compact(found)).alias("finding"), "column_name", F.col("row_key").cast("string").alias("ref_id"))


def load_profile(inv: DataFrame, forms: dict[str, ColumnForm] = FORMS) -> DataFrame:
    """One row per feed, load and column.

    rows, missing, null_rate, distinct_values, min_value, max_value, top_value
    (the commonest trimmed value, ties to the smallest), top_share, mean_share
    (columns of shares only), masks, top_mask, mask_divergence: the Jensen-Shannon
    divergence in bits of the load's mask distribution from that of all the
    feed's loads together. Loads without values have NULL shares and divergence.
    """
    keys = ["feed", "load", "column_name"]
    share_cols = [c for c, f in forms.items() if f.share]
    share = F.when(F.col("column_name").isin(*share_cols), as_share(F.col("value"))) if share_cols else F.lit(None).cast("double")
    share = F.when(share.between(0, 1), share)
    trimmed = (
        inv.withColumn("value", F.when(~F.col("missing"), strip(F.col("value"))))
        .groupBy(*keys, "value", "missing", "mask")
        .agg(F.sum("n").alias("n"))
        .withColumn("share", share)
    )
    by_value = trimmed.groupBy(*keys, "value", "missing", "share").agg(F.sum("n").alias("n"))
    base = by_value.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("missing"),
        F.count(F.when(~F.col("missing"), 1)).alias("distinct_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min(F.when(~F.col("missing"), F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))).alias("top"),
        F.sum(F.col("share") * F.col("n")).alias("s"),
        F.sum(F.when(F.col("share").isNotNull(), F.col("n"))).alias("sn"),
    )
    by_mask = trimmed.filter(~F.col("missing")).groupBy(*keys, "mask").agg(F.sum("n").alias("n"))
    def beside(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        """``rows`` with the sum of n over those with the same ``by``; NULLs are equal. No group is brought into one task."""
        sums = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("n").alias(name))
        on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        return rows.join(sums, on).drop(*[f"_{c}" for c in by])

    for by, name in ((["feed", "column_name", "mask"], "feed_mask"), (["feed", "column_name"], "feed_all"), (keys, "load_all")):
        by_mask = beside(by_mask, by, name)
    q, p = F.col("feed_mask") / F.col("feed_all"), F.col("n") / F.col("load_all")
    # sum over masks of the load: p log2(p/m)/2 + q log2(q/m)/2; masks the load lacks add q/2 each
    js = by_mask.select(*keys, "mask", "n", p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    js = js.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("masks"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("mask").alias("v")))["v"].alias("top_mask"),
        F.sum(F.col("p") * F.log2(F.col("p") / F.col("m")) / 2 + F.col("q") * F.log2(F.col("q") / F.col("m")) / 2).alias("seen"),
        F.sum("q").alias("covered"),
    )
    js = js.select(*keys, "masks", "top_mask", F.greatest(F.lit(0.0), F.col("seen") + (1 - F.col("covered")) / 2).alias("mask_divergence"))
    left, right = base.alias("a"), js.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    values = F.col("a.rows") - F.col("a.missing")
    return left.join(right, on, "left").select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col("a.rows").alias("rows"),
        F.col("a.missing").alias("missing"),
        (F.col("a.missing") / F.col("a.rows")).alias("null_rate"),
        F.col("a.distinct_values").alias("distinct_values"),
        F.col("a.min_value").alias("min_value"),
        F.col("a.max_value").alias("max_value"),
        F.col("a.top.v").alias("top_value"),
        F.try_divide(-F.col("a.top.k"), values).alias("top_share"),
        F.try_divide(F.col("a.s"), F.col("a.sn")).alias("mean_share"),
        F.coalesce(F.col("b.masks"), F.lit(0)).alias("masks"),
        F.col("b.top_mask").alias("top_mask"),
        F.col("b.mask_divergence").alias("mask_divergence"),
    )


def departing_loads(profile: DataFrame, null_rise: float = 0.2, top_share: float = 0.38, mean_shift: float = 0.06, forms: dict[str, ColumnForm] = FORMS) -> DataFrame:
    """(finding, column_name, ref_id): loads that depart from the others of their feed.

    Medians are exact and interpolate. Loads without an id can't be named and are
    left out; they still count for the medians of their feed.
    """
    eps = 1e-9
    shares = [c for c, f in forms.items() if f.share]
    w = Window.partitionBy("feed", "column_name")
    x = profile.withColumns({"median_null": F.median("null_rate").over(w), "median_mean": F.median("mean_share").over(w)})
    is_share = F.col("column_name").isin(*shares) if shares else F.lit(False)
    found = F.array(
        F.when(F.col("null_rate") - F.col("median_null") >= null_rise - eps, "null_rate"),
        F.when(
            F.when(is_share, F.abs(F.col("mean_share") - F.col("median_mean")) >= mean_shift - eps).otherwise(F.col("top_share") >= top_share - eps),
            "distribution",
        ),
    )
    return (
        x.filter(F.col("load").isNotNull())
        .select(F.explode(F.array_compact(found)).alias("finding"), "column_name", F.col("load").alias("ref_id"))
    )


def quality_findings(df: DataFrame, columns: list[str], row_key: str = "row_id", feed: str = "feed_id", load: str = "load_id", forms: dict[str, ColumnForm] = FORMS) -> DataFrame:
    """All findings of the profile: malformed values, values out of range, departing loads.

    Only ``columns`` are read, so extra columns, also ones with clashing names,
    don't matter. Repeated rows count as often as they were delivered.
    """
    inv = inventory(df, columns, feed, load, forms)
    return violations(df, columns, row_key, inv, forms).unionByName(departing_loads(load_profile(inv, forms), forms=forms))


def drifting_loads(profile: DataFrame, least: float = 0.02) -> DataFrame:
    """(feed, load, column_name, mask_divergence, top_mask): loads whose mask distribution diverges from that of all their feed's loads.

    ``least``: Jensen-Shannon divergence in bits. Loads without values have none and are left out.
    """
    return profile.filter(F.col("mask_divergence") >= least).select("feed", "load", "column_name", "mask_divergence", "top_mask")
