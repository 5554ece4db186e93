"""Cosine similarity of rows and of columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import cells
from tabwright.plans import blocks
from tabwright.session import cut_lineage

PREVIEW = 5
# Scores are compared after rounding to four places.
ROUNDING = 1e-4
#: Rows with the least ids that are compared with all rows first: they win the ties.
PROBE = 256
#: Rows of a block that meets another one in a task.
BLOCK = 4 * blocks.MAX_BLOCK
SUITABLE_NOTE = (
    "Cosine similarity computed successfully. Higher scores indicate more similar rows or items."
)


def numeric_rows(df: DataFrame, features: list[str], order_by: str, id_column: str | None = None) -> DataFrame:
    """(idx, label, vec): rows whose features are all numeric.

    ``order_by`` is a unique integer giving the file order; the label is the id
    cell, or ``row <n>`` with the 1-based order value.
    """
    numbers = [cells.number_of(cells.field_of(df, c)) for c in features]
    position = F.concat(F.lit("row "), (F.col(order_by) + 1).cast("string"))
    label = position
    if id_column is not None:
        text = cells.normalize_cell(cells.column_ref(id_column))
        label = F.coalesce(F.nullif(text, F.lit("")), position)
    complete = F.lit(True)
    for number in numbers:
        complete = complete & number.isNotNull()
    return df.filter(complete).select(
        F.col(order_by).cast("bigint").alias("idx"), label.alias("label"), F.array(*numbers).alias("vec")
    )


def suitability(vectors: DataFrame, width: int, mode: str = "row") -> DataFrame:
    """One row: row_count, suitable and the note why not."""
    facts = vectors.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.max(F.array_max(F.transform("vec", F.abs))), F.lit(0.0)).alias("largest"),
    )
    note = (
        F.when(F.col("row_count") < 2, "Similarity needs at least two complete numeric rows.")
        .when(
            F.lit(mode == "item" and width < 2),
            "Item similarity needs at least two numeric feature columns.",
        )
        .when(
            F.col("largest") <= 1e-8,
            "Similarity is not suitable when all selected values are zero.",
        )
    )
    return facts.select(
        "row_count", note.isNull().alias("suitable"), F.coalesce(note, F.lit(SUITABLE_NOTE)).alias("note")
    )


def _sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def unit_rows(vectors: DataFrame) -> DataFrame:
    """Rows scaled to length one; a zero row stays zero."""
    norm = F.sqrt(_sum_of(F.transform("vec", lambda x: x * x)))
    wide = vectors.withColumn("vec", F.col("vec").cast("array<double>")).withColumn("_norm", norm)
    safe = F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))
    return wide.withColumn("vec", F.transform("vec", lambda x: x / safe)).drop("_norm")


def _best_pairs(
    left: pd.DataFrame, right: pd.DataFrame | None, n: int, worst: tuple[float, int] | None = None
) -> pd.DataFrame:
    """The ``n`` best pairs of two blocks (or within one), by rounded score then ids.

    ``worst`` is the score and lesser id of the n-th best pair that is known
    already: of pairs that tie with it, only those with no greater lesser id count.
    """
    a = blocks.matrix(left["vec"])
    ids_a = left["idx"].to_numpy()
    same = right is None
    b, ids_b = (a, ids_a) if same else (blocks.matrix(right["vec"]), right["idx"].to_numpy())
    best = pd.DataFrame({"i": [], "j": [], "score": []}).astype({"i": "int64", "j": "int64", "score": "float64"})
    tile = 1024
    for start in range(0, len(a), tile):
        scores = np.round(np.clip(a[start : start + tile] @ b.T, -1.0, 1.0), 4)
        if same:
            scores[np.arange(len(b))[None, :] <= np.arange(start, start + len(scores))[:, None]] = -2.0
        rows = ids_a[start : start + tile]
        if worst is None:
            flat = scores.ravel()
            keep = min(n, flat.size)
            floor = np.partition(flat, flat.size - keep)[flat.size - keep]
            x, y = np.nonzero(scores > floor)
            ties = scores == floor if floor >= -1.0 else np.zeros(scores.shape, dtype=bool)
        else:
            x, y = np.nonzero(scores > worst[0])
            ties = scores == worst[0]
            ties &= (rows <= worst[1])[:, None] | (ids_b <= worst[1])[None, :]
        # Of ties the least ids count, so that a block of equal scores is not listed.
        tx, ty = np.nonzero(ties)
        if len(tx) > n:
            less = np.minimum(rows[tx], ids_b[ty])
            few = less <= np.partition(less, n - 1)[n - 1]
            tx, ty = tx[few], ty[few]
        x, y = rows[np.append(x, tx)], ids_b[np.append(y, ty)]
        score = np.append(scores[scores > (floor if worst is None else worst[0])], np.full(len(tx), floor if worst is None else worst[0]))
        found = pd.DataFrame({"i": np.minimum(x, y), "j": np.maximum(x, y), "score": score})
        best = pd.concat([best, found]).sort_values(["score", "i", "j"], ascending=[False, True, True]).head(n)
        if len(best) == n:
            last = (float(best["score"].iloc[-1]), int(best["i"].iloc[-1]))
            worst = last if worst is None else max(worst, last, key=lambda w: (w[0], -w[1]))
    return best


_PAIR_SCHEMA = "i bigint, j bigint, score double"


def top_pairs(vectors: DataFrame, n: int = 10) -> DataFrame:
    """(i, j, left, right, score): the ``n`` most similar row pairs, exactly.

    Equal rows are folded first: of each distinct vector only the first n+1 rows
    can appear in the answer. Pairs inside blocks give a floor for the n-th best
    score; cell pairs whose bound stays below the floor are skipped, the rest are
    compared block by block. Ties go to the smaller (i, j).
    """
    units = unit_rows(vectors)
    first = Window.partitionBy("vec").orderBy("idx")
    folded = units.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= n + 1).drop("_k")
    slim = cut_lineage(folded.select("idx", "vec"))
    total = slim.count()
    if total < 2:
        return vectors.sparkSession.createDataFrame(
            [], "i bigint, j bigint, left string, right string, score double"
        )
    order = [F.desc("score"), F.col("i"), F.col("j")]
    probed, worst, last = _probed(slim, n)
    pivots = blocks.choose_pivots(slim, total)
    assigned = blocks.assign_cells(slim, pivots)
    facts = blocks.cell_facts(assigned, pivots)
    placed = blocks.with_chunk(assigned, facts).select("idx", "vec", "cell", "chunk")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return _best_pairs(pdf.sort_values("idx"), None, n, worst)

    inside = cut_lineage(placed.groupBy("cell", "chunk").applyInPandas(within, _PAIR_SCHEMA).unionByName(probed).distinct())
    seen = inside.orderBy(*order).limit(n).collect()
    floor = -2.0
    if len(seen) == n:
        worst = (seen[-1]["score"], seen[-1]["i"])
        # Every pair of a probed row was compared: a pair of later rows does not win a tie.
        floor = worst[0] + (ROUNDING / 2 - 1e-9 if worst[1] <= last else -ROUNDING)
    across = _across_blocks(placed, facts, floor, n, worst)
    found = inside if across is None else inside.unionByName(across).distinct()
    best = found.orderBy(*order).limit(n)
    names = vectors.select("idx", "label")
    # At most n pairs look up their labels.
    wanted = F.broadcast(best)
    left = names.join(wanted, names["idx"] == wanted["i"]).select("i", "j", "score", F.col("label").alias("left"))
    return (
        names.join(F.broadcast(left), names["idx"] == left["j"])
        .select("i", "j", "left", F.col("label").alias("right"), "score")
    )


def _probed(slim: DataFrame, n: int) -> tuple[DataFrame, tuple[float, int] | None, int]:
    """Best pairs of the rows with the least ids with all rows, the score and lesser id of the n-th, the last such id."""
    first = slim.orderBy("idx").limit(PROBE).toPandas()
    last = int(first["idx"].iloc[-1])

    def meet(batches):
        for batch in batches:
            later = batch[batch["idx"] > last]
            if len(later):
                yield _best_pairs(first, later, n)

    met = slim.mapInPandas(meet, _PAIR_SCHEMA)
    own = slim.sparkSession.createDataFrame(_best_pairs(first, None, n), _PAIR_SCHEMA)
    best = cut_lineage(met.unionByName(own).orderBy(F.desc("score"), "i", "j").limit(n))
    seen = best.orderBy(F.desc("score"), "i", "j").collect()
    return best, ((seen[-1]["score"], seen[-1]["i"]) if len(seen) == n else None), last


def _across_blocks(
    placed: DataFrame, facts: blocks.Cells, floor: float, n: int, worst: tuple[float, int] | None
) -> DataFrame | None:
    """Best pairs between different chunks of cell pairs that can reach ``floor``.

    Chunks are laid together to blocks of BLOCK rows, so that a row is copied once
    for every block it meets and not for every cell.
    """
    length = np.sqrt((facts.pivots**2).sum(1))
    reach = facts.radius
    # x.y <= p.q + |p| ry + |q| rx + rx ry for x, y within rx, ry of p, q, and 1 at most.
    bound = np.minimum(
        facts.pivots @ facts.pivots.T
        + np.outer(length, reach)
        + np.outer(reach, length)
        + np.outer(reach, reach),
        1.0 + 1e-9,
    )
    alive = (bound >= floor) & (facts.rows > 0)[:, None] & (facts.rows > 0)[None, :]
    cell = np.repeat(np.arange(len(facts.pivots)), facts.chunks)
    begin = np.cumsum(np.append(0, facts.chunks))
    filled = np.cumsum(facts.rows[cell] / facts.chunks[cell])
    block = (filled // BLOCK).astype(int)
    meets = np.zeros((block.max() + 1, block.max() + 1), dtype=bool)
    for u in range(len(cell)):
        v = u + 1 + np.flatnonzero(alive[cell[u], cell[u + 1 :]])
        meets[block[u], block[v]] = True
    if not meets.any():
        return None
    spark = placed.sparkSession
    # One row per chunk and per pair of blocks.
    units = F.broadcast(spark.createDataFrame(
        [(int(c), int(u - begin[c]), u, int(block[u])) for u, c in enumerate(cell)], "of int, part int, unit int, block int"
    ))
    plan = F.broadcast(spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(meets))], "a int, b int"))
    rows = placed.join(units, (F.col("cell") == F.col("of")) & (F.col("chunk") == F.col("part"))).select("idx", "vec", "unit", "block")
    left = rows.join(plan, F.col("block") == F.col("a")).select("idx", "vec", "unit", "a", "b")
    right = rows.join(plan, F.col("block") == F.col("b")).select("idx", "vec", "unit", "a", "b").toDF("idx", "vec", "unit", "r_a", "r_b")

    def between(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        best = [pd.DataFrame({"i": [], "j": [], "score": []})]
        if len(l) and len(r):
            theirs = list(r.groupby("unit"))
            for u, mine in l.groupby("unit"):
                open_units = [rows for v, rows in theirs if v > u and alive[cell[u], cell[v]]]
                if open_units:
                    best.append(_best_pairs(mine, pd.concat(open_units), n, worst))
        return pd.concat(best).sort_values(["score", "i", "j"], ascending=[False, True, True]).head(n)

    return left.groupBy("a", "b").cogroup(right.groupBy("r_a", "r_b")).applyInPandas(between, _PAIR_SCHEMA)


def matrix_preview(vectors: DataFrame, size: int = PREVIEW) -> DataFrame:
    """(label, values): the top-left corner of the row similarity matrix."""
    corner = unit_rows(vectors).orderBy("idx").limit(size)
    rows = corner.agg(F.sort_array(F.collect_list(F.struct("idx", "label", "vec"))).alias("rows"))
    score = lambda a, b: F.round(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _sum_of(F.zip_with(a["vec"], b["vec"], lambda x, y: x * y)))), 4
    )
    lines = F.transform(
        "rows",
        lambda a: F.struct(
            a["idx"].alias("idx"),
            a["label"].alias("label"),
            F.transform(F.col("rows"), lambda b: score(a, b)).alias("values"),
        ),
    )
    return rows.select(F.inline(lines))


def column_cosine(df: DataFrame, features: list[str], n: int | None = None) -> DataFrame:
    """(left, right, score) between feature columns, best first; one aggregate.

    Only rows complete in every feature count.
    """
    numbers = {c: cells.number_of(cells.field_of(df, c)) for c in features}
    complete = F.lit(True)
    for number in numbers.values():
        complete = complete & number.isNotNull()
    columns = df.filter(complete).select(*(v.alias(f"f{i}") for i, v in enumerate(numbers.values())))
    names = list(features)
    norm = {i: F.sqrt(F.sum(F.col(f"f{i}") * F.col(f"f{i}"))) for i in range(len(names))}

    def score(a: int, b: int) -> Column:
        safe = [F.when(norm[k] == 0, 1.0).otherwise(norm[k]) for k in (a, b)]
        cosine = F.sum(F.col(f"f{a}") * F.col(f"f{b}")) / (safe[0] * safe[1])
        return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)), 4)

    entries = [
        F.struct(
            F.lit(a).alias("i"), F.lit(b).alias("j"),
            F.lit(names[a]).alias("left"), F.lit(names[b]).alias("right"), score(a, b).alias("score"),
        )
        for a, b in combinations(range(len(names)), 2)
    ]
    pairs = columns.agg(F.array(*entries).alias("p")).select(F.inline("p"))
    ranked = pairs.orderBy(F.desc("score"), "i", "j")
    return (ranked if n is None else ranked.limit(n)).select("left", "right", "score")
