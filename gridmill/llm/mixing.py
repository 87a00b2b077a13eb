"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

The share of each source in the tokens (words) is raised to an exponent between 0 and 1 and normalised. The
exponent is found by bisection: the smallest that repeats no source more than ``max_repeats`` times, or, with
``entropy``, the one whose weights have that entropy (natural logarithm); 1 if even that does not meet the limit.
Each source then has a budget of ``floor(weight * budget)`` tokens. Whole copies of a source go as often as the
budget holds them; of the last copy goes a part: the source's blocks (of about ``block_tokens``, drawn by a hash of
the id) in the order of a hash-keyed permutation of that copy, while they fit, and of the block that no longer fits
its documents in hash order while they fit. Texts are read twice: once for counts, of which sums by block make the
plan, and once to draw; only the ids of a source's one cut block are sorted. The plan by source is broadcast up to
``MANY`` sources and joined beyond; the drawn blocks (a row for ``block_tokens`` tokens) are joined by their size.

Defined results: rows without a word are left out; null and empty source names are one source, ''; equal rows are
drawn together; null ids are drawn like any other; a source whose budget is 0 gives no row; an empty
table gives no rows; other columns are carried by ``mix``, but for those that have the names of its results, which the results replace, or ``_mix_...``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm import kernels as K

STEPS = 50


MANY = 100_000  #: sources up to which the plan by source is broadcast; more are joined


def exponent(shares: np.ndarray, scale: float, max_repeats: float | None, entropy: float | None, n: np.ndarray | None = None) -> float:
    """The exponent by bisection; scale is the budget over all tokens, and n how many sources have each share (one)."""
    n = np.ones(len(shares)) if n is None else n

    def fits(a: float) -> bool:
        w = shares**a
        if entropy is not None:
            w = w / (n * w).sum()
            return float(-(n * w * np.log(w)).sum()) <= entropy
        return float((w / shares).max()) / float((n * w).sum()) * scale <= max_repeats

    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def mix(
    docs: DataFrame, scale: float = 1.0, max_repeats: float | None = 1.3, entropy: float | None = None, block_tokens: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Every drawn row with its columns, ``copy`` (1 for the first), ``slot`` (the place of its block in that copy's permutation) and ``n_tokens``."""
    results = [K.fresh(docs, c) for c in ("copy", "slot", "n_tokens")]
    columns, place_of = docs.columns, docs.columns.index
    id_col, text_col, source_col = (f"c{place_of(c)}" for c in (id_col, text_col, source_col))
    docs, _ = K.numbered(docs)
    names = docs.columns
    tokens = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\r\f\x0B]+"), "")).cast("long")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    own = docs.withColumns({"_mix_src": F.coalesce(F.col(source_col), F.lit("")), "_mix_n": tokens, "_mix_id": ident})
    # one pass over the texts; what follows reads only sources, ids and counts
    thin = K.settle(own.select("_mix_src", "_mix_n", "_mix_id").filter("_mix_n > 0"))
    totals = K.settle(thin.groupBy("_mix_src").agg(F.sum("_mix_n").alias("_mix_t")))
    # sources of equal size count together: n tokens have no more than sqrt(2 n) different sizes, however many sources there are
    sizes = totals.groupBy("_mix_t").agg(F.count("*").alias("n")).orderBy("_mix_t").toPandas()
    if not len(sizes):
        return own.filter("_mix_n > 0").select(*names, F.lit(0).alias("copy"), F.lit(0).alias("slot"), F.col("_mix_n").alias("n_tokens")).toDF(*columns, *results)
    t, n = sizes["_mix_t"].to_numpy(float), sizes["n"].to_numpy(float)
    total = float((t * n).sum())
    a = exponent(t / total, scale, max_repeats, entropy, n)
    weight = F.pow(F.col("_mix_t") / F.lit(total), F.lit(a)) / F.lit(float((n * (t / total) ** a).sum()))
    blocks = F.ceil(F.col("_mix_t") / F.lit(block_tokens))
    plan = totals.select("_mix_src", "_mix_t", F.floor(weight * F.lit(total * scale)).alias("_mix_b"), blocks.alias("_mix_k"))
    plan = F.broadcast(plan) if n.sum() <= MANY else plan
    block = F.conv(F.substring(F.md5("_mix_id"), 1, 8), 16, 10).cast("long") % F.col("_mix_k")
    place = F.md5(F.concat_ws("|", F.col("_mix_id"), F.col("copy").cast("string")))

    def blocked(rows: DataFrame) -> DataFrame:
        return rows.join(plan, "_mix_src").withColumn("_mix_block", block)

    sums = blocked(thin).groupBy("_mix_src", "_mix_block", "_mix_t", "_mix_b").agg(F.sum("_mix_n").alias("bt"))
    whole = F.floor(F.col("_mix_b") / F.col("_mix_t"))
    copies = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), whole + 1)))
    rank = F.md5(F.concat_ws("|", "_mix_src", F.col("_mix_block").cast("string"), F.col("copy").cast("string")))
    order = Window.partitionBy("_mix_src", "copy").orderBy(rank, "_mix_block")
    copies = copies.withColumn("slot", F.row_number().over(order)).withColumn("upto", F.sum("bt").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.when(F.col("copy") <= whole, F.col("_mix_t")).otherwise(F.col("_mix_b") - whole * F.col("_mix_t")) - (F.col("upto") - F.col("bt"))
    drawn = copies.withColumn("left", left).filter("left > 0").select("_mix_src", "_mix_block", F.col("copy").cast("int").alias("copy"), "slot", "left", (F.col("left") < F.col("bt")).alias("_mix_cut"))
    # of a cut block, the last place in hash order that still fits; rows at one place go together
    inner = Window.partitionBy("_mix_src", "_mix_block", "copy").orderBy("_mix_place", "_mix_n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = blocked(thin).join(drawn.filter("_mix_cut"), ["_mix_src", "_mix_block"]).withColumn("_mix_place", place)
    cut = cut.withColumn("_mix_sum", F.sum("_mix_n").over(inner)).filter("_mix_sum <= left").groupBy("_mix_src", "_mix_block", "copy").agg(F.max(F.struct("_mix_place", "_mix_n")).alias("_mix_last"))
    drawn = K.settle(drawn.join(cut, ["_mix_src", "_mix_block", "copy"], "left").drop("left"))
    rows = blocked(own.filter("_mix_n > 0")).join(drawn, ["_mix_src", "_mix_block"])
    fits = ~F.col("_mix_cut") | F.coalesce(F.struct(place.alias("_mix_place"), F.col("_mix_n")) <= F.col("_mix_last"), F.lit(False))
    return rows.filter(fits).select(*names, "copy", "slot", F.col("_mix_n").alias("n_tokens")).toDF(*columns, *results)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') src, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) n,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) h FROM documents),
s AS (SELECT src, CAST(sum(n) AS BIGINT) t FROM d WHERE n > 0 GROUP BY src),
l AS (SELECT list(CAST(t AS DOUBLE) / (SELECT CAST(sum(t) AS DOUBLE) FROM s) ORDER BY src) p FROM s),
b(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (SELECT i, lo, hi, (lo + hi) / 2 mid,
    list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) <= 1.3 ok FROM b, l WHERE i < 50)),
w AS (SELECT src, t, pow(CAST(t AS DOUBLE) / (SELECT CAST(sum(t) AS DOUBLE) FROM s), (SELECT hi FROM b WHERE i = 50)) w FROM s),
plan AS (SELECT src, t, CAST(floor(w / (SELECT sum(w) FROM w) * (SELECT CAST(sum(t) AS DOUBLE) FROM s)) AS BIGINT) b, (t + 1048575) // 1048576 k FROM w),
bl AS (SELECT d.*, t, b, h % k blk FROM d JOIN plan USING (src) WHERE n > 0),
sums AS (SELECT src, blk, t, b, CAST(sum(n) AS BIGINT) bt FROM bl GROUP BY ALL),
c AS (SELECT *, unnest(range(1, b // t + 2)) cp FROM sums),
o AS (SELECT *, row_number() OVER v slot, sum(bt) OVER (v ROWS UNBOUNDED PRECEDING) upto FROM c WINDOW v AS (PARTITION BY src, cp ORDER BY md5(src || '|' || blk || '|' || cp), blk)),
g AS (SELECT src, blk, cp, slot, bt, CASE WHEN cp <= b // t THEN t ELSE b - (b // t) * t END - (upto - bt) lft FROM o),
r AS (SELECT bl.doc_id, bl.src, bl.n, g.cp, g.slot, lft, lft < bt cut,
  sum(n) OVER (PARTITION BY g.src, g.blk, cp ORDER BY md5(doc_id || '|' || cp), n RANGE UNBOUNDED PRECEDING) upto FROM bl JOIN g ON bl.src = g.src AND bl.blk = g.blk WHERE lft > 0)
SELECT doc_id, src AS source, CAST(cp AS INTEGER) AS copy, CAST(slot AS INTEGER) AS slot, CAST(n AS BIGINT) AS n_tokens FROM r WHERE NOT cut OR upto <= lft
"""
