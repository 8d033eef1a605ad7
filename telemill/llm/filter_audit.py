"""What a set of document filters does in every order: a recursive query over counts per combination of failed filters.

Every document becomes a bit mask of the filters that it fails. Documents are counted per part and mask (*mask cells*,
at most 2^m a part), and a recursive common table expression extends filter orders letter by letter over those cells.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.runtime import keep

WHITE = r"[\x20\x09-\x0D]+"
DUPLICATE = "duplicate"  # stands for a filter that fails copies of an earlier document's text


def text_filters(text: Column) -> dict[str, Column | str]:
    """Five filters by letter; the conditions are true for documents that fail, a null text is empty.

    A: under 100 words. B: under 80 % distinct words. C: over 10 % capital letters A-Z. D: any of ``#$%&*|``.
    E: the text of a document with a smaller id.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n_words, n_distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    n_capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n_words < 100,
        "B": 100 * n_distinct < 80 * n_words,
        "C": 100 * n_capitals > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
        "E": DUPLICATE,
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str], id_col: str = "doc_id",
               text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents per (part, mask): n, n_good (label quality = 1), n_toxic (label toxic = 1).

    Bit i of ``mask`` is set if the i-th filter fails. Texts are shuffled as digests only. Whether a document repeats an
    earlier one needs no join of copies with each other: all documents of a digest but those of its smallest id fail, so
    the cells hold every document as a copy, and the smallest ids (one look-up a digest) are moved to the cells of
    originals. A document without an id is nobody's copy and nobody's original; rows of equal id and text are no copies of
    each other. A null part is the empty string; several label rows of an id count as one that has what any of them has.
    """
    letters = list(filters)
    copies = sum(1 << i for i, letter in enumerate(letters) if isinstance(filters[letter], str))
    failed = sum((F.when(filters[letter], 1 << i).otherwise(0) for i, letter in enumerate(letters)
                  if not isinstance(filters[letter], str)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       failed.alias("mask"),
                       F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = keep(rows.join(marks, "id", "left"), "audit-documents")
    least = rows.groupBy("digest").agg(F.min("id").alias("id"))
    first = rows.join(least, ["digest", "id"], "left_semi").unionByName(rows.where("id IS NULL"))
    counts = (rows.select("part", F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"), "n", "good", "toxic")
              .unionByName(first.select("part", "mask", "n", "good", "toxic"))
              .unionByName(first.select("part", F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"),
                                        (-F.col("n")).alias("n"), "good", "toxic"))) if copies else rows
    return counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


# One level a filter: every order so far is extended by each unused letter, and the cells of its part give that step's counts.
RECURSION = """
WITH RECURSIVE orders(part, filter_order, applied, steps) AS (
  SELECT part, '', 0, CAST(array() AS {steps}) FROM {cells}
  UNION ALL
  SELECT part, concat(filter_order, letter), applied | bit, concat(steps, array(named_struct(
      'letter', letter,
      'kept', aggregate(cells, 0L, (a, c) -> a + IF(c.mask & (applied | bit) = 0, c.n, 0L)),
      'removed', aggregate(cells, 0L, (a, c) -> a + IF(c.mask & applied = 0 AND c.mask & bit > 0, c.n, 0L)),
      'redundant', aggregate(cells, 0L, (a, c) -> a + IF(c.mask & applied > 0 AND c.mask & bit > 0, c.n, 0L)),
      'unique_fails', aggregate(cells, 0L, (a, c) -> a + IF(c.mask = bit, c.n, 0L)),
      'good_lost', aggregate(cells, 0L, (a, c) -> a + IF(c.mask & applied = 0 AND c.mask & bit > 0, c.n_good, 0L)),
      'toxic_lost', aggregate(cells, 0L, (a, c) -> a + IF(c.mask & applied = 0 AND c.mask & bit > 0, c.n_toxic, 0L)))))
  FROM (SELECT o.part, o.filter_order, o.applied, o.steps, c.cells, f.letter, f.bit
        FROM orders o JOIN {cells} c ON c.part = o.part
        LATERAL VIEW inline(filter({letters}, f -> o.applied & f.bit = 0)) f AS letter, bit)
)
SELECT part, filter_order, CAST(at + 1 AS INT) AS step, s.*
FROM orders LATERAL VIEW posexplode(steps) e AS at, s WHERE length(filter_order) = {m}"""
STEPS = ("array<struct<letter:string,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,"
         "good_lost:bigint,toxic_lost:bigint>>")


@contextmanager
def _unlimited_rows(spark):
    """Recursion stops at a number of rows by default; here it ends by itself, after one level a filter."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of all filters and step: what the step's filter keeps, removes and costs, as document counts.

    kept: left after the step. removed: taken by it. redundant: fail its filter but went earlier. unique_fails: fail no
    other filter. good_lost, toxic_lost: removed documents with such a label. shapley: what the filter removes, summed
    over all orders. Zeros are included; an empty table has no parts and gives no rows. At most eight filters of one
    letter each (m! orders). Other columns of ``docs`` and ``labels``, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    filters = text_filters(F.col(text_col)) if filters is None else filters
    if not 1 <= len(filters) <= 8 or any(len(letter) != 1 for letter in filters):
        raise ValueError("one to eight filters, each named by one letter")
    cells = mask_cells(docs, labels, filters, id_col, text_col, part_col)
    cells = keep(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells")),
                 "audit-cells")
    letters = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(filters)) + ")"
    view = "telemill_audit_cells"
    cells.createOrReplaceTempView(view)
    with _unlimited_rows(spark):
        steps = keep(spark.sql(RECURSION.format(cells=view, letters=letters, m=len(filters), steps=STEPS)), "audit-steps")
    spark.catalog.dropTempView(view)
    total = steps.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return steps.join(total, ["part", "letter"])
