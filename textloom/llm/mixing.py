"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The corpus is reduced to the token mass of its cells (source, language, topic). Raking multiplies each cell by a factor
of each of its categories until the cells' masses have the target marginals; a document then stays with a probability in
proportion to its cell's weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.names import keeps_other_columns

NONE = "(none)"
#: A topic for each document by its form: the first pattern that its text has.
TOPICS = (
    ("contact", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9]"),
    ("licence", r"(?i)licen[sc]e|copyright|all rights reserved"),
    ("table", r"\|"),
    ("symbols", r"[#$%&*]{3}"),
    ("numbers", r"[0-9]{4}"),
)


def topic(text: Column) -> Column:
    """The topic of a text; "prose" if it has none of the patterns, "empty" if it is null or white space."""
    out = F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens(text: Column) -> Column:
    """Words of a text, split at ASCII white space, without making a list of them."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def tempered_targets(cells: DataFrame, dims: list[str], power: float) -> DataFrame:
    """(dim, value, target): each category's share of the tokens to the power `power`, scaled to a sum of one."""
    kinds = cells.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col("mass")) for d in dims))).alias("x")).select("x.*")
    mass = kinds.groupBy("dim", "value").agg(F.sum("mass").alias("mass")).where("mass > 0").withColumn("p", F.pow("mass", F.lit(power)))
    total = mass.groupBy("dim").agg(F.sum("p").alias("all"))
    return mass.join(total, "dim").select("dim", "value", (F.col("p") / F.col("all")).alias("target"))


#: Cells that are raked as arrays of one row; more are raked by sums over a table, round by round, with the same result.
ARRAY_CELLS = 20_000


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _one_row(cells: DataFrame, targets: DataFrame, dims: list[str]) -> DataFrame:
    """(rows, g0, g1, ...): all cells with their place in each dimension, and of each dimension the list of its categories
    (k, target, members), members being places in `rows`."""
    own = cells.withColumn("pos", F.row_number().over(Window.orderBy(*dims)) - 1)
    for j, d in enumerate(dims):
        goal = targets.where(F.col("dim") == d).select(F.col("value").alias(d), F.col("target").cast("double").alias(f"t{j}"))
        own = own.join(goal, d, "left").withColumn(f"k{j}", F.dense_rank().over(Window.orderBy(d)) - 1)
    places = [F.sort_array(F.collect_list(F.struct(f"k{j}", "pos", f"t{j}"))).alias(f"p{j}") for j in range(len(dims))]
    out = own.agg(F.sort_array(F.collect_list(F.struct("pos", "mass", *(f"k{j}" for j in range(len(dims))), *dims))).alias("rows"), *places)

    def groups(j: int) -> Column:
        sizes = F.transform(F.sequence(F.lit(0), F.element_at(f"p{j}", -1)[f"k{j}"]), lambda k: F.filter(f"p{j}", lambda p: p[f"k{j}"] == k))
        return F.transform(sizes, lambda g: F.struct(F.element_at(g, 1)[f"k{j}"].alias("k"), F.element_at(g, 1)[f"t{j}"].alias("target"), F.transform(g, lambda p: p["pos"]).alias("members")))

    return out.select("rows", *(groups(j).alias(f"g{j}") for j in range(len(dims))))


def _rake_arrays(cells: DataFrame, targets: DataFrame, dims: list[str], rounds: int, tolerance: float) -> DataFrame:
    """rake() in one expression: the rounds are an aggregate() over arrays of the only row."""
    sums = lambda f, j: F.transform(F.col(f"g{j}"), lambda g: F.aggregate(g["members"], F.lit(0.0), lambda s, i: s + F.get(f, i)))

    def along(f: Column, j: int) -> Column:
        factor = lambda have: F.zip_with(have, F.col(f"g{j}"), lambda h, g: F.when((h > 0) & g["target"].isNotNull(), g["target"] / h).otherwise(1.0))
        return let(factor(sums(f, j)), lambda x: F.zip_with(f, F.col("rows"), lambda v, r: v * F.get(x, r[f"k{j}"])))

    def a_round(f: Column, j: int = 0) -> Column:
        return let(along(f, j), lambda x: a_round(x, j + 1)) if j + 1 < len(dims) else along(f, j)

    def off(f: Column) -> Column:
        apart = [F.array_max(F.zip_with(sums(f, j), F.col(f"g{j}"), lambda h, g: F.abs(h - g["target"]))) for j in range(len(dims))]
        return F.coalesce(F.greatest(*apart), F.lit(0.0))

    def step(acc: Column, _: Column) -> Column:
        moved = let(a_round(acc["f"]), lambda f: F.struct(f.alias("f"), off(f).alias("off")))
        return F.when(acc["off"] <= tolerance, acc).otherwise(moved)

    mass = F.transform("rows", lambda r: r["mass"])
    start = let(F.aggregate(mass, F.lit(0.0), lambda s, m: s + m), lambda total: F.struct(F.transform(mass, lambda m: m / total).alias("f"), F.lit(float("inf")).alias("off")))
    done = _one_row(cells, targets, dims).withColumn("x", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    flat = done.select(F.explode(F.arrays_zip("rows", F.col("x.f").alias("fitted"))).alias("y"), F.col("x.off").alias("off"))
    return flat.select(*(F.col(f"y.rows.{d}").alias(d) for d in dims), "y.rows.mass", F.col("y.fitted").alias("fitted"), "off")


def _rake_table(cells: DataFrame, targets: DataFrame, dims: list[str], rounds: int, tolerance: float, total: float) -> DataFrame:
    """rake() for any number of cells: each round is a few sums over the cells, and the fitted table is written after it,
    so the plan doesn't grow with the rounds."""
    fitted = materialize(cells.withColumn("fitted", F.col("mass") / F.lit(float(total))), "raked")
    wanted = {d: targets.where(F.col("dim") == d).select(F.col("value").alias(d), "target") for d in dims}
    off = 0.0
    for _ in range(rounds):
        x = fitted
        for d in dims:
            have = x.groupBy(d).agg(F.sum("fitted").alias("have")).join(wanted[d], d, "left")
            factor = F.when((F.col("have") > 0) & F.col("target").isNotNull(), F.col("target") / F.col("have")).otherwise(1.0)
            x = x.join(have.select(d, factor.alias("factor")), d).withColumn("fitted", F.col("fitted") * F.col("factor")).drop("factor")
        fitted = materialize(x.select(*dims, "mass", "fitted"), "raked")
        flat = fitted.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col("fitted")) for d in dims))).alias("x")).select("x.*")
        off = flat.groupBy("dim", "value").agg(F.sum("fitted").alias("have")).join(targets, ["dim", "value"]).agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0] or 0.0
        if off <= tolerance:
            break
    return fitted.withColumn("off", F.lit(float(off)))


def rake(cells: DataFrame, targets: DataFrame, dims: list[str], rounds: int = 25, tolerance: float = 1e-6, array_cells: int = ARRAY_CELLS) -> DataFrame:
    """(dims..., mass, fitted, off): `fitted` sums to one and has the target marginals, as far as the cells allow.

    `cells` has a row for each combination that occurs. It ends when no marginal is off by more than `tolerance`, or after
    `rounds`: targets that the cells can't meet are then met as nearly as raking does, and `off` says by how much the worst
    marginal misses. A category without a target keeps its mass; one whose cells are all empty has no part. Up to
    `array_cells` cells are raked in one row's arrays, in one job; more by a table, with the same result up to rounding.
    """
    size = cells.agg(F.sum("mass").alias("total"), F.count("*").alias("n")).first()
    if not size["total"]:
        return cells.withColumn("fitted", F.lit(0.0)).withColumn("off", F.lit(0.0))
    if size["n"] <= array_cells:
        return materialize(_rake_arrays(cells, targets, dims, rounds, tolerance), "raked")
    return _rake_table(cells, targets, dims, rounds, tolerance, size["total"])


def scale_to(fitted: DataFrame, budget: float, array_cells: int = ARRAY_CELLS, rounds: int = 40) -> float:
    """The factor s for which the documents' probabilities min(1, s fitted / mass) keep `budget` tokens on average.

    The tokens kept are the least of the lines M(k) + s R(k), in which the k cells of the largest ratio are kept whole (M:
    their tokens, R: the rest's tokens by ratio), so s is the largest of the lines' solutions. Of more than `array_cells`
    cells, which would be sorted by one task, s is searched by sums instead.
    """
    ratio = fitted.where("mass > 0 AND fitted > 0").select("mass", (F.col("fitted") / F.col("mass")).alias("r"))
    top = ratio.agg(F.sum("mass").alias("m"), F.min("r").alias("lo"), F.count("*").alias("n")).first()
    if not top["m"]:
        return 0.0
    if budget >= top["m"]:
        return 1.0 / top["lo"]
    if top["n"] <= array_cells:
        here = Window.orderBy(F.col("r").desc(), "mass")
        lines = ratio.select(
            F.coalesce(F.sum("mass").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("whole"),
            F.sum(F.col("mass") * F.col("r")).over(here.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        )
        return float(lines.agg(F.max((F.lit(float(budget)) - F.col("whole")) / F.col("rest"))).first()[0])
    low, high = 0.0, 1.0 / top["lo"]
    for _ in range(rounds):  # several points at a time
        points = [low + (high - low) * k / 16 for k in range(1, 16)]
        got = ratio.agg(*(F.sum(F.least(F.lit(1.0), F.lit(p) * F.col("r")) * F.col("mass")).alias(f"p{k}") for k, p in enumerate(points))).first()
        below = [p for p, g in zip(points, got, strict=True) if g < budget]
        above = [p for p, g in zip(points, got, strict=True) if g >= budget]
        low, high = max([low, *below]), min([high, *above])
        if high - low <= 1e-9 * high:
            break
    return (low + high) / 2


def with_cells(docs: DataFrame) -> DataFrame:
    """`docs` with the columns __source, __lang, __topic and __tokens."""
    text = F.col("text").cast("string")
    return docs.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "__topic": topic(text), "__tokens": tokens(text),
    })


DIMS = ["__source", "__lang", "__topic"]


def weigh(docs: DataFrame, targets: DataFrame | None = None, power: float = 0.5, keep: float = 0.5, seed: int = 17, columns: bool = True) -> DataFrame:
    """`docs` with __source, __lang, __topic, __tokens, __weight, __probability and __sampled.

    `docs` needs doc_id, text, source and lang; without `columns` of its columns only doc_id is returned, and texts are read
    once, not twice. `targets` (dim, value, target), dim being one of __source, __lang, __topic, gives the marginals of the
    token mass; by default each category gets its share to the power `power`, which lifts small ones. __weight is what a
    token of the document's cell counts for, one on average; documents are sampled independently with probabilities in
    proportion to it, at most one, scaled so that the share `keep` of all tokens stays on average. Whether a document stays
    depends on a hash of its id, its text and `seed` alone, so a repeated row has the fate of its twin and a lost task gives
    the same rows again. A null source or language is the category "(none)", a document without tokens has no mass and stays
    with its cell's probability, or the probability `keep` if its cell has no mass. An empty table gives an empty result.
    Cells are few and summed before their shuffle; they are joined to documents by broadcast while their number is small
    (checked), by shuffle beyond it.
    """
    text = F.col("text").cast("string")
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    rows = with_cells(docs)
    if not columns:
        rows = materialize(rows.select("doc_id", *DIMS, "__tokens", u.alias("__u")), "weighed")
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("__tokens").cast("double").alias("mass")), "cells")
    targets = materialize(tempered_targets(cells, DIMS, power) if targets is None else targets, "targets")
    fitted = rake(cells, targets, DIMS)
    size = cells.agg(F.coalesce(F.sum("mass"), F.lit(0.0)), F.count("*")).first()
    total, small = size[0], size[1] <= 100_000
    scale = scale_to(fitted, keep * total)
    r = F.col("fitted") / F.col("mass")
    cell = fitted.select(
        *DIMS, F.when(F.col("mass") > 0, r * F.lit(float(total))).alias("__weight"),
        F.when(F.col("mass") > 0, F.least(F.lit(1.0), F.lit(scale) * r)).otherwise(F.lit(float(keep))).alias("__probability"),
    )
    out = rows.join(F.broadcast(cell) if small else cell, DIMS)
    return out.withColumn("__sampled", (u if columns else F.col("__u")) < F.col("__probability")).drop("__u")


@keeps_other_columns
def sample(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that weigh() samples, with the columns of `docs`."""
    return weigh(docs, **settings).where("__sampled").select(*docs.columns)
