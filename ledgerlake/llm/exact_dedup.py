"""Exact duplicates by a distributed content sort (built-in functions only).

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]``
is deleted.  Sampled splitters deal the rows out by range of (leading
characters, 64-bit hash) of the normalised text; inside a range Spark's
external sort places equal texts next to each other, and neighbours count as
equal only when the *whole* normalised texts compare equal.  The short sort
prefix only bounds what the sampling step sends to the driver.

Hot groups: a text with more rows than a quarter of an average partition is
dealt out over several *runs* by a digest of the whole row, so its copies never
meet in one task.  The best row of such a text is found by a grouping of its
rows that is merged task by task before the shuffle (full texts are compared);
inside the runs the sort shows whether it is there.  Rows that are equal in
every column cannot be told apart by a digest: those that come that often travel
as one row and a number.  There are fewer than ``4 x partitions`` hot texts, and
as few hot rows, by construction; everything depends on the rows alone, so a
task that runs again decides alike.

Defined results: null text counts as empty, and all empty texts form one
group; of equal texts the row with the most code points in its original text
stays, then the smallest id (null ids last), then the smallest hash of the
whole row, so of fully repeated rows exactly one stays.  An empty table gives
no rows.  Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import WHITE_SPACE, fresh, named, shared

# Characters of the normalised text that the range splitters see.
SPLITTER_CHARS = 32


@dataclass(frozen=True)
class Marked:
    """Every input row and, under names that clash with none of its columns, its group."""
    rows: DataFrame
    keep_id: str
    group_size: str
    kept: str
    digest: str


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE_SPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Marked:
    """Adds to each row: the id that stays, the group's size, whether this row stays, the text's SHA-256."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    (head, hsh, runs, run, norm, tie, length, rn, head_id, run_size, n, best, keep_id, group_size, kept,
     digest) = fresh(cols, "xd_head", "xd_hash", "xd_runs", "xd_run", "xd_norm", "xd_tie", "xd_length", "xd_rn",
                     "xd_head_id", "xd_run_size", "xd_n", "xd_best", "keep_id", "group_size", "kept", "text_sha256")
    text, doc, own = named(text_col), named(id_col), [named(c) for c in cols]

    # How often each text (by a 64-bit hash) and each whole row comes: 24 bytes for each different row.
    keyed = df.withColumn(hsh, F.xxhash64(normalised(text))).withColumn(tie, F.xxhash64(*own))
    counts = shared(keyed.groupBy(hsh, tie).agg(F.count(F.lit(1)).alias(n)))
    limit = max(1.0, (counts.agg(F.sum(n)).first()[0] or 0) / (4.0 * partitions))
    hot = (counts.groupBy(hsh).agg(F.sum(n).alias(n)).filter(F.col(n) > limit)
           .select(hsh, F.ceil(F.col(n) / limit).alias(runs)))
    heavy = counts.filter(F.col(n) > limit).select(hsh, tie)
    repeated = not heavy.isEmpty()
    if not repeated:
        rows = keyed.withColumn(n, F.lit(1).cast("long"))
    else:
        rows = (keyed.join(F.broadcast(heavy), [hsh, tie], "left_anti").select(*own, hsh, tie, F.lit(1).cast("long").alias(n))
                .unionByName(keyed.join(F.broadcast(heavy), [hsh, tie], "left_semi").groupBy(*cols, hsh, tie)
                             .agg(F.count(F.lit(1)).alias(n))))
    rows = (rows.join(F.broadcast(hot), hsh, "left").withColumn(norm, normalised(text))
            .withColumn(length, F.length(F.coalesce(text, F.lit("")))))

    # The best row of each hot text.
    order = F.struct((-F.col(length)).alias("minus"), doc.isNull().alias("none"), doc.alias("id"), F.col(tie).alias("tie"))
    elected = (rows.filter(F.col(runs).isNotNull()).groupBy(hsh, norm)
               .agg(F.min(order).alias(best), F.sum(n).alias(group_size))
               .select(hsh, F.sha2(F.col(norm), 256).alias(digest), best, group_size))

    sorted_rows = (rows.withColumn(head, F.substring(norm, 1, SPLITTER_CHARS))
                   .withColumn(run, F.when(F.col(runs).isNotNull(), F.pmod(F.xxhash64(F.col(tie)), F.col(runs)))
                               .otherwise(F.lit(0).cast("long")))
                   .repartitionByRange(head, hsh, run))
    # The range partitioning already satisfies this window's clustering: no
    # further exchange, only the sort inside each range.
    group = Window.partitionBy(head, hsh, run, norm)
    first = group.orderBy(F.col(length).desc(), doc.asc_nulls_last(), F.col(tie))
    marked = sorted_rows.select(
        *own, hsh, tie, runs, n, F.row_number().over(first).alias(rn), F.first(doc).over(first).alias(head_id),
        F.sum(n).over(group).alias(run_size), F.sha2(F.col(norm), 256).alias(digest))

    joined = marked.join(F.broadcast(elected), [hsh, digest], "left")
    split = F.col(best).isNotNull()
    chosen = (F.col(rn) == 1) & (~split | (F.col(best).getField("tie") == F.col(tie)))
    out = joined.select(
        *own, F.when(split, F.col(best).getField("id")).otherwise(F.col(head_id)).alias(keep_id),
        F.coalesce(group_size, run_size).alias(group_size), chosen.alias(kept), F.col(digest), n)
    if not repeated:
        rows = out
    else:         # the copies again: the first of them is the one that may stay
        rows = (out.withColumn(rn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
                .withColumn(kept, F.col(kept) & (F.col(rn) == 1)))
    return Marked(rows.select(*own, keep_id, group_size, kept, digest), keep_id, group_size, kept, digest)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``df``."""
    marked = mark_duplicates(df, id_col, text_col)
    return marked.rows.filter(named(marked.kept)).select(*[named(c) for c in df.columns])
