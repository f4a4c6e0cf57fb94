"""What each of five text filters removes, in every order of applying them: an incidence matrix product.

A document's failures are a mask of five bits. All that the audit asks for follows from how many documents of a part have
each mask, so documents are summed to histograms of 32 masks first: of all, of the good and of the toxic ones. These
are the rows of a matrix; four integer matrices of 32 masks by 600 columns (120 orders times 5 steps) say which masks are kept, removed,
redundant and unique at each step, and their products are the report.

The texts are read once; what goes on is a row of ids, masks and digests. Copies are found by 128-bit digests of the texts: the least id of
each text that stands more than once is joined back, a join whose hot keys adaptive execution splits.

Defined cases: a null text is empty; null languages are the part of the empty string. A null doc_id is never greater than another, so its row
is no copy of any, and no row is a copy of it; it has no labels. Rows that share the least id of their text are no copies of each other. A
document is good or toxic if any row of its labels says 1. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.frames import map_batches, narrow
from loxodrome.llm.workspace import Workspace

FILTERS = "ABCDE"
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_WORD_BREAK = r"[\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """The bits of filters A to D: too few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")
    n, hundred = F.size(words).cast("long"), F.lit(100).cast("long")
    fails = [
        n < 200,
        hundred * F.size(F.array_distinct(words)) < 50 * n,
        hundred * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def incidence() -> dict[str, np.ndarray]:
    """Matrices of masks by (order, step): 1 where a document of the mask is kept, removed, redundant or failing nothing else."""
    names = ("kept", "removed", "redundant", "unique")
    out = {k: np.zeros((MASKS, len(ORDERS) * STEPS), np.int64) for k in names}
    masks = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        gone = np.zeros(MASKS, bool)
        for step, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails, at = (masks & bit) > 0, o * STEPS + step
            out["removed"][:, at], out["redundant"][:, at], out["unique"][:, at] = fails & ~gone, fails & gone, masks == bit
            gone |= fails
            out["kept"][:, at] = ~gone
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", workspace: Workspace | None = None) -> DataFrame:
    """600 rows for each part: every order of the filters, every step."""
    work = workspace or Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = narrow(docs, id_col, part_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.md5(text.cast("binary"))).alias("digest")
    )
    rows = work.save(read, "masks")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # written, so that both sides of the join are plain shuffles, whose large partitions can be split
    firsts = work.save(firsts.drop("copies"), "firsts")
    known = narrow(labels, id_col, "quality", "toxic").filter(F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    whole = rows.join(firsts, "digest", "left").join(known, "id", "left")
    copy = F.coalesce((F.col("id") > F.col("first")).cast("int"), F.lit(0))
    cells = whole.groupBy("part", (F.col("mask") + 16 * copy).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    # 32 cells a part at most, so a part is one row
    return report(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))


def report(parts: DataFrame) -> DataFrame:
    """The products, for rows of a part and its cells (mask, n, good, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = incidence()
        steps = len(ORDERS) * STEPS
        orders, step = pa.array(np.repeat(ORDERS, STEPS)), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
        letter = np.array([FILTERS.index(c) for order in ORDERS for c in order])
        for batch in batches:
            for part, cells in zip(batch.column(0), batch.column(1), strict=True):
                histogram = np.zeros((3, MASKS), np.int64)  # all, good, toxic
                for c in cells.as_py():
                    histogram[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                removed = histogram @ matrix["removed"]
                columns = [histogram[0] @ matrix["kept"], removed[0], histogram[0] @ matrix["redundant"], histogram[0] @ matrix["unique"], removed[1], removed[2]]
                shapley = np.array([removed[0][letter == k].sum() for k in range(STEPS)])[letter]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * steps, pa.string()), orders, step, *map(pa.array, columns), pa.array(shapley)], names=[c.split()[0] for c in SCHEMA.split(", ")]
                )

    return map_batches(parts, run, SCHEMA)


_CLEAN = "coalesce(text, '')"
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, {_CLEAN} AS t, regexp_extract_all({_CLEAN}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [p.k FOR p IN [{{'k': 'A', 'v': len(ws) < 200}}, {{'k': 'B', 'v': 100 * len(list_distinct(ws)) < 50 * len(ws)}},
  {{'k': 'C', 'v': 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t)}}, {{'k': 'D', 'v': regexp_matches(t, '[#$%&*|]')}}, {{'k': 'E', 'v': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)}}] IF p.v] AS fails FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b1.c || c1.c || d.c || e.c AS filter_order FROM b a, b b1, b c1, b d, b e WHERE len(list_distinct([a.c, b1.c, c1.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS flt, string_split(filter_order[1 : step - 1], '') AS before FROM o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, flt,
  sum(CASE WHEN NOT list_has_any(fails, list_append(before, flt)) THEN n ELSE 0 END) AS kept, sum(CASE WHEN list_contains(fails, flt) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN list_contains(fails, flt) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = [flt] THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN good = 1 AND list_contains(fails, flt) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN toxic = 1 AND list_contains(fails, flt) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, flt) AS BIGINT) AS shapley FROM g
"""
