"""Missing-value injection. Every mask is an expression over the complete table.

A mask is worked out from a few aggregates and then is a per-row comparison, so all
columns are blanked in one projection and no row is shuffled.
"""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.hashing import hash_uniform
from imputeflow.functions.scalars import (
    GUARD, MISSING_RATES, clip, half_even_count, min_max, sigmoid,
)
from imputeflow.operators.linear import fit_lr, moments
from imputeflow.operators.orderstat import draw_cuts, exact_medians, exact_quantiles
from imputeflow.operators.stats import assemble, profile_values
from imputeflow.session import cut_lineage
from imputeflow.spec import TableSpec

# Seed of the random mask, range of a probability after its correction.
MCAR_SEED = 709
PROB_RANGE = (0.01, 0.99)
# Names before a column's own: its complete value and whether it was blanked.
TRUTH, GAP = "__t_", "__m_"
Masks = dict[str, Column]


def apply_masks(df: DataFrame, masks: Masks, carry: bool = False) -> DataFrame:
    """Blank the masked cells of all columns at once; where a mask can't tell (null), the cell stays.

    ``carry`` keeps the complete values and the masks beside the cells, so that scores need no join.
    """
    blanked = {c: F.when(~F.coalesce(m, F.lit(False)), F.col(c)) for c, m in masks.items()}
    if carry:
        blanked |= {f"{TRUTH}{c}": F.col(c) for c in masks} | {f"{GAP}{c}": F.coalesce(m, F.lit(False)) for c, m in masks.items()}
    return df.withColumns(blanked)


def _column_list(spec: TableSpec, columns) -> list[str]:
    if isinstance(columns, int):
        return [spec.feats[columns]]
    if isinstance(columns, str):
        return [columns]
    if isinstance(columns, (list, tuple)):
        return [spec.feats[c] if isinstance(c, int) else c for c in columns]
    raise TypeError(f"columns must be a name or a list of names, not {type(columns).__name__}")


# ---- completely at random ------------------------------------------------------------

def mcar_masks(df: DataFrame, spec: TableSpec, cols, rates, seed: int = MCAR_SEED) -> dict[float, Masks]:
    """Exactly ``round(rate*n)`` cells per column, for all rates from the same passes."""
    key = F.col(spec.key)
    draws = [hash_uniform(seed + i, c, spec.key) for i, c in enumerate(cols)]
    cuts, counts = draw_cuts(
        df, spec.key, [(d, F.lit(g)) for g, d in enumerate(draws)], list(range(len(cols))),
        lambda n: {g: [half_even_count(r, n[g]) for r in rates] for g in range(len(cols))})
    return {r: {c: cuts[g, half_even_count(r, counts[g])].holds(draws[g], key)
                for g, c in enumerate(cols)} for r in rates}


def create_mcar(df: DataFrame, spec: TableSpec, columns, p_missing: float,
                seed: int = MCAR_SEED) -> DataFrame:
    if isinstance(columns, int):
        raise TypeError("columns must be a name or a list of names, not int")
    cols = _column_list(spec, columns)
    return apply_masks(df, mcar_masks(df, spec, cols, [p_missing], seed)[p_missing])


def check_missing_counts(masked: DataFrame, cols, p_missing: float) -> DataFrame:
    """Per column the blanked cells, the wanted number and whether they agree."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.count_if(F.col(c).isNull()).alias("n_miss"),
                               F.bround(F.lit(p_missing) * F.count("*")).cast("bigint").alias("n_need"))
                      for c in cols])
    return (masked.agg(cells.alias("cells")).select(F.inline("cells"))
            .withColumn("ok", F.col("n_miss") == F.col("n_need")))


# ---- by the tails of the distribution ------------------------------------------------

def mnar_tail_masks(df: DataFrame, spec: TableSpec, cols, rates) -> dict[float, Masks]:
    """A value outside its own column's central part is blanked."""
    probs = sorted({p for r in rates for p in (r / 2, 1 - r / 2)})
    q = exact_quantiles(df, list(cols), probs)
    return {r: {c: (F.col(c) < q[c, r / 2]) | (F.col(c) > q[c, 1 - r / 2]) for c in cols}
            for r in rates}


def mar_tail_masks(df: DataFrame, spec: TableSpec, cols, rates) -> dict[float, Masks]:
    """A cell is blanked where any other column of the row lies in its tail."""
    share = 2 * (len(spec.feats) - 1)
    probs = sorted({p for r in rates for p in (r / share, 1 - r / share)})
    q = exact_quantiles(df, list(spec.feats), probs)
    out = {}
    for r in rates:
        tails = {f: (F.col(f) < q[f, r / share]) | (F.col(f) > q[f, 1 - r / share]) for f in spec.feats}
        out[r] = {}
        for c in cols:
            hit = F.lit(False)
            for f in spec.others(c):
                hit = hit | F.coalesce(tails[f], F.lit(False))
            out[r][c] = hit
    return out


def create_mnar_tail(df: DataFrame, spec: TableSpec, p_missing: float) -> DataFrame:
    return apply_masks(df, mnar_tail_masks(df, spec, spec.feats, [p_missing])[p_missing])


def create_mar_tail(df: DataFrame, spec: TableSpec, p_missing: float) -> DataFrame:
    return apply_masks(df, mar_tail_masks(df, spec, spec.feats, [p_missing])[p_missing])


# ---- by a probability per row, corrected to the exact count --------------------------

def exact_count_masks(df: DataFrame, spec: TableSpec, probs: dict[str, Column], p_missing: float,
                      seed: int) -> Masks:
    """Draw each cell with its probability, then add or drop random cells to the exact count."""
    key = F.col(spec.key)
    cols = list(probs)
    missed = {c: F.coalesce(hash_uniform(seed, f"draw|{c}", spec.key) < probs[c], F.lit(False))
              for c in cols}
    order = {c: hash_uniform(seed, f"fix|{c}", spec.key) for c in cols}
    # group 2i holds the missed cells of column i, group 2i+1 the others
    draws = [(order[c], F.when(missed[c], 2 * i).otherwise(2 * i + 1)) for i, c in enumerate(cols)]

    def sizes(n):
        out = {}
        for i in range(len(cols)):
            need = half_even_count(p_missing, n[2 * i] + n[2 * i + 1])
            if n[2 * i] >= need:
                out[2 * i] = [need]
            else:
                out[2 * i + 1] = [need - n[2 * i]]
        return out

    cuts, counts = draw_cuts(df, spec.key, draws, list(range(2 * len(cols))), sizes)
    masks = {}
    for i, c in enumerate(cols):
        ((g, (size,)),) = [(g, s) for g, s in sizes(counts).items() if g // 2 == i]
        chosen = cuts[g, size].holds(order[c], key)
        masks[c] = (missed[c] & chosen) if g % 2 == 0 else (missed[c] | chosen)
    return masks


def mnar_logistic_masks(df: DataFrame, spec: TableSpec, cols, rates, skew: float = 5.0,
                        seeds=None) -> dict[float, Masks]:
    """High values go missing: a logistic curve around the median sets each probability."""
    cols = list(cols)
    std0 = {c: s["std0"] for c, s in profile_values(df, cols).items()}
    median = exact_medians(df, cols)
    raw = {c: sigmoid(F.lit(skew) * (F.col(c) - F.lit(median[c])) / F.lit(std0[c] + GUARD))
           for c in cols}
    mean = df.agg(*[F.avg(raw[c]).alias(c) for c in cols]).first()
    out = {}
    for i, r in enumerate(rates):
        probs = {c: clip(raw[c] * F.lit(r) / F.lit(mean[c] + GUARD), *PROB_RANGE) for c in cols}
        out[r] = exact_count_masks(df, spec, probs, r, seeds[i] if seeds else 0)
    return out


def create_mnar(df: DataFrame, spec: TableSpec, columns, p_missing: float, skew: float = 5.0,
                seed: int = 0) -> DataFrame:
    cols = _column_list(spec, columns)
    masks = mnar_logistic_masks(df, spec, cols, [p_missing], skew, [seed])
    return apply_masks(df, masks[p_missing])


def mar_scores(df: DataFrame, spec: TableSpec, cols, model: str = "RF", num_trees: int = 100,
               max_depth: int = 5, seed: int = 0) -> tuple[DataFrame, dict[str, Column]]:
    """In-sample prediction of each column from the others, null on incomplete rows."""
    cols = list(cols)
    feats = list(spec.feats)
    complete = df.dropna(subset=feats)
    if complete.isEmpty():
        raise ValueError("no complete row to fit the missingness model on")
    whole = F.lit(True)
    for f in feats:
        whole = whole & F.col(f).isNotNull()
    if model == "LR":
        m = moments(complete, [F.col(f) for f in feats])[()]
        scores = {}
        for c in cols:
            others = [i + 1 for i, f in enumerate(feats) if f != c]
            fit = fit_lr(m, feats.index(c) + 1, others)
            scores[c] = F.when(whole, fit.predict([F.col(f) for f in spec.others(c)]))
        return df, scores
    scored = df
    for i, c in enumerate(cols):
        forest = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed + i,
                                       featureSubsetStrategy="all", labelCol=c,
                                       featuresCol="__x", predictionCol=f"__p{i}")
        fitted = forest.fit(assemble(complete, spec.others(c), "__x"))
        scored = fitted.transform(assemble(scored, spec.others(c), "__x")).drop("__x")
        scored = scored.withColumn(f"__p{i}", F.when(whole, F.col(f"__p{i}")))
    # the forests' votes are wanted by several passes: keep them, not the trees' work
    return cut_lineage(scored), {c: F.col(f"__p{i}") for i, c in enumerate(cols)}


def create_mar_grid(df: DataFrame, spec: TableSpec, columns, rates, seeds=None, model: str = "RF",
                    **forest) -> dict[float, DataFrame]:
    cols = _column_list(spec, columns)
    scored, scores = mar_scores(df, spec, cols, model, **forest)
    ends = scored.agg(*[F.struct(F.min(scores[c]).alias("lo"), F.max(scores[c]).alias("hi")).alias(c)
                        for c in cols]).first()
    raw = {c: min_max(scores[c], ends[c].lo, ends[c].hi) for c in cols}
    mean = scored.agg(*[F.avg(raw[c]).alias(c) for c in cols]).first()
    out = {}
    for i, r in enumerate(rates):
        probs = {c: F.coalesce(clip(raw[c] * F.lit(r) / F.lit(mean[c] + GUARD), *PROB_RANGE), F.lit(0.0))
                 for c in cols}
        # clip() of a null score would give the lower end, hence the test on the score itself
        probs = {c: F.when(scores[c].isNotNull(), p).otherwise(0.0) for c, p in probs.items()}
        masks = exact_count_masks(scored, spec, probs, r, seeds[i] if seeds else 0)
        out[r] = apply_masks(scored, masks).select(*df.columns)
    return out


def create_mar(df: DataFrame, spec: TableSpec, columns, p_missing: float, seed: int = 0,
               model: str = "RF", **forest) -> DataFrame:
    """A cell's probability follows the value the other columns predict for it."""
    return create_mar_grid(df, spec, columns, [p_missing], [seed], model, **forest)[p_missing]


# ---- grid ----------------------------------------------------------------------------

def scenario_tables(df: DataFrame, spec: TableSpec, rates=MISSING_RATES,
                    mechs=("mcar", "mar", "mnar"), style: str = "tail", carry: bool = False,
                    **mar_options) -> dict[tuple[str, float], DataFrame]:
    """The masked table of every mechanism and rate; ``style`` is ``tail`` or ``model``.

    ``carry`` as in ``apply_masks``; tables of a fitted MAR model carry nothing.
    """
    rates = list(rates)
    out = {}
    for mech in mechs:
        if mech == "mcar":
            grid = mcar_masks(df, spec, spec.feats, rates)
        elif style == "tail":
            grid = (mnar_tail_masks if mech == "mnar" else mar_tail_masks)(df, spec, spec.feats, rates)
        elif mech == "mnar":
            grid = mnar_logistic_masks(df, spec, spec.feats, rates, seeds=range(len(rates)))
        else:
            tables = create_mar_grid(df, spec, list(spec.feats), rates, range(len(rates)), **mar_options)
            out.update({(mech, r): t for r, t in tables.items()})
            continue
        out.update({(mech, r): apply_masks(df, grid[r], carry) for r in rates})
    return out


def scenario_grid(df: DataFrame, spec: TableSpec, **options) -> DataFrame:
    """All scenarios as one long table; a filter on ``mech`` or ``rate`` drops whole branches."""
    out = None
    for (mech, rate), t in scenario_tables(df, spec, **options).items():
        t = t.select(F.lit(mech).alias("mech"), F.lit(rate).alias("rate"), *spec.columns)
        out = t if out is None else out.unionByName(t)
    return out
