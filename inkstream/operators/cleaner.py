"""The stateful line cleaner, in two forms that give the same text.

``clean`` works on the array of a document's lines and needs no shuffle: flags of
each line, look-ahead over slices, and a look at the line before among those that
matter; its work is linear in the number of lines. ``clean_by_window`` lays lines out as rows and uses window frames; it is
the form that the SQL oracle has.

A line that matches a cutoff ends the document, unless a dosage follows within
the horizon (or within the horizon of a line there that ends with a colon), or
the line emitted last ends with a colon. A rescued cutoff line is kept, unless
``drop_rescued`` is set. Boilerplate and header lines go. Blank lines go, but
one directly after an emitted line that ends with a colon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S
from ..functions.rules import Rules

RE = "(?id)"  # as the phrases are ASCII, Unicode classes aren't needed on the hot path


def line_flags(line: Column, rules: Rules) -> dict[str, Column]:
    return {
        "blank": line == "",
        "d": line.rlike(RE + rules.dosage_re),
        "c": line.endswith(":"),
        "cut": line.rlike(RE + rules.cutoff_re),
        "rm": line.rlike(RE + rules.boilerplate_re) | line.isin(*rules.headers),
    }


def finish(x: Column) -> Column:
    return S.strip(S.collapse_newlines(S.collapse_spaces(S.fold_punct(x))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: Column, rules: Rules = Rules(), drop_rescued: bool = False) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), S.strip)
    flags = F.transform(lines, lambda x: F.struct(x.alias("line"), *[v.alias(k) for k, v in line_flags(x, rules).items()]))
    cleaned = _let(flags, lambda f: _let(_follows(f, rules.horizon), lambda d: _let(_effective(f, d, rules.horizon, drop_rescued), _emitted)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(finish(F.array_join(cleaned, "\n")))


def _ahead(values: Column, i: Column, horizon: int, test) -> Column:
    return F.exists(F.slice(values, i + 2, F.lit(horizon)), test)


def _follows(flags: Column, horizon: int) -> Column:
    """For each line: it names a dosage, or ends with a colon and one follows within the horizon."""
    return F.transform(flags, lambda x, i: x.d | (x.c & _ahead(flags, i, horizon, lambda y: y.d)))


def _effective(flags: Column, follows: Column, horizon: int, drop_rescued: bool) -> Column:
    """The lines that matter: kept ones, blank ones, and those that end the document if no colon is before them.

    ``colon`` says of each what a line after it sees. One that ends the document but isn't kept was passed only
    because a colon was before it, and leaves that as it is."""
    kept = lambda x: ~x.blank & ~x.rm & ~x.cut if drop_rescued else ~x.blank & ~x.rm
    steps = F.transform(flags, lambda x, i: F.struct(
        x.line.alias("line"), x.blank.alias("blank"), kept(x).alias("keep"), x.c.alias("c"),
        F.when(x.cut, ~_ahead(follows, i, horizon, lambda y: y)).otherwise(F.lit(False)).alias("ends"),
    ))
    return F.transform(
        F.filter(steps, lambda x: x.keep | x.blank | x.ends),
        lambda x: F.struct(x.line.alias("line"), x.blank.alias("blank"), x.keep.alias("keep"), x.ends.alias("ends"), F.when(x.keep, x.c).otherwise(x.ends).alias("colon")),
    )


def _emitted(steps: Column) -> Column:
    """The lines up to the first that ends the document: those that are kept, and blank ones directly after a colon."""
    after_colon = lambda i: F.coalesce(F.get(steps, i - 1).colon, F.lit(False))
    marked = F.transform(steps, lambda x, i: F.struct(x.line.alias("line"), (x.keep | (x.blank & after_colon(i))).alias("shown"), (x.ends & ~after_colon(i)).alias("stop")))

    def upto_stop(m):
        stop = F.array_position(F.transform(m, lambda x: x.stop), True)
        return F.transform(F.filter(F.when(stop > 0, F.slice(m, F.lit(1), (stop - 1).cast("int"))).otherwise(m), lambda x: x.shown), lambda x: x.line)

    return _let(marked, upto_stop)


def flagged_lines(docs: DataFrame, key: str, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(key, line_no, line and its flags), one row for each line."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", S.strip(F.col("line")))
    return rows.select("*", *[v.alias(k) for k, v in line_flags(F.col("line"), rules).items()])


def decided_lines(docs: DataFrame, key: str, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Flagged lines with fu (a dosage follows), pc (the line emitted last ends with a colon) and n (where the document ends)."""
    order = W.partitionBy(key).orderBy("line_no")
    ahead = order.rowsBetween(1, rules.horizon)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    keep = ~F.col("blank") & ~F.col("rm")
    x = flagged_lines(docs, key, text, rules).withColumn("d15", F.coalesce(F.max("d").over(ahead), F.lit(False)))
    x = x.withColumn("x", F.col("d") | (F.col("c") & F.col("d15"))).withColumn("fu", F.coalesce(F.max("x").over(ahead), F.lit(False)))
    last = F.last(F.when(keep, F.struct(F.col("line_no").alias("at"), "c")), ignorenulls=True).over(before)
    blank = F.last(F.when(F.col("blank"), F.col("line_no")), ignorenulls=True).over(before)
    x = x.withColumn("lk", last).withColumn("lb", blank)
    x = x.withColumn("pc", F.coalesce(F.col("lk.c") & (F.col("lb").isNull() | (F.col("lb") < F.col("lk.at"))), F.lit(False)))
    ends = F.when(F.col("cut") & ~F.col("fu") & ~F.col("pc"), F.col("line_no"))
    return x.withColumn("n", F.min(ends).over(W.partitionBy(key)))


def clean_by_window(docs: DataFrame, key: str, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(key, corpus); a document whose lines all go has an empty corpus."""
    x = decided_lines(docs, key, text, rules)
    shown = (F.col("n").isNull() | (F.col("line_no") < F.col("n"))) & (~F.col("blank") & ~F.col("rm") | F.col("blank") & F.col("pc"))
    out = x.groupBy(key).agg(F.sort_array(F.collect_list(F.when(shown, F.struct("line_no", "line")))).alias("kept"))
    return out.select(key, finish(F.array_join(F.transform("kept", lambda p: p.line), "\n")).alias("corpus"))
