"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from imputeflow.functions.hashing import hash_uniform_sql, key_numbers_sql
from imputeflow.functions.scalars import MISSING_RATES
from imputeflow.sources.tables import EMB, WIDE8

W = WIDE8.feats
E = EMB.feats
RATES = MISSING_RATES
D = "::DOUBLE"


def cols(fmt: str, names, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c, i=i) for i, c in enumerate(names))


def r(expr: str, digits: int = 4) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0)"


def query(ctes: list[tuple[str, str]], final: str) -> str:
    """CTEs whose name ends in ! are worked out once."""
    return "WITH " + ",\n".join(f"{n.rstrip('!')} AS {'MATERIALIZED ' * n.endswith('!')}({b})" for n, b in ctes) + "\n" + final


RAW_WIDE = ("wide", "SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), "
            "CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, "
            "p_size::DOUBLE AS p_size, p_retailprice, o_totalprice, s_acctbal, l_returnflag AS label "
            "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
            "JOIN supplier ON l_suppkey = s_suppkey")
RAW_EMB = ("emb", "SELECT vec_id AS row_id, " + cols("embedding[{i}+1]::DOUBLE AS {c}", E) + ", label::INTEGER AS label FROM embeddings")
RAW_EMB3 = ("emb", "SELECT vec_id AS row_id, " + cols("embedding[{i}+1]::DOUBLE AS {c}", E) + ", least(label, 2)::INTEGER AS label FROM embeddings")
TEXT_EMB = ("emb", RAW_EMB[1].replace("vec_id AS row_id", "vec_id::VARCHAR AS row_id"))
TEXT_EMB3 = ("emb", RAW_EMB3[1].replace("vec_id AS row_id", "vec_id::VARCHAR AS row_id"))


def scaled(src: str, feats, out: str = "z") -> list[tuple[str, str]]:
    stats = ("sc", "SELECT " + cols("avg({c}) AS m{i}, stddev_pop({c}) AS s{i}", feats) + f" FROM {src}")
    z = (out, "SELECT row_id, label, " + cols("({c} - m{i}) / s{i} AS {c}", feats) + f" FROM {src}, sc")
    return [stats, z]


def mcar(src: str, feats, rate: float, out: str = "m", seed: int = 709) -> list[tuple[str, str]]:
    ranks = cols("row_number() OVER (ORDER BY u{i}, row_id) AS r{i}", feats)
    draws = ", ".join(f"{hash_uniform_sql(seed + i, c)} AS u{i}" for i, c in enumerate(feats))
    need = f"round_even({rate}{D} * n, 0)"
    return [(f"{out}_h", f"SELECT row_id, {key_numbers_sql('row_id')} FROM {src}"),
            (f"{out}_u", f"SELECT row_id, {draws} FROM {out}_h"),
            (f"{out}_r", f"SELECT row_id, count(*) OVER () AS n, {ranks} FROM {out}_u"),
            (out, "SELECT t.row_id, t.label, " + cols("CASE WHEN r{i} <= " + need + " THEN NULL ELSE {c} END AS {c}", feats)
             + f" FROM {src} t JOIN {out}_r USING (row_id)")]


def sorted_lists(src: str, feats, out: str = "srt") -> tuple[str, str]:
    return (out, "SELECT count(*) AS n, " + cols("list({c} ORDER BY {c}) AS l{i}", feats) + f" FROM {src}")


def quantile(i: int, p: str) -> str:
    """Linear interpolation on a sorted list, written out so that equal ends stay exact."""
    at = f"({p}{D} * (n - 1))"
    lo, hi = f"l{i}[CAST(floor({at}) AS BIGINT) + 1]", f"l{i}[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({at} - floor({at})))"


def tails(src: str, feats, low: str, high: str) -> list[tuple[str, str]]:
    qs = ", ".join(f"{quantile(i, low)} AS lo{i}, {quantile(i, high)} AS hi{i}" for i in range(len(feats)))
    return [sorted_lists(src, feats), ("q", f"SELECT {qs} FROM srt")]


def mnar_tail(src: str, feats, rate: float, out: str = "m") -> list[tuple[str, str]]:
    body = cols("CASE WHEN {c} < lo{i} OR {c} > hi{i} THEN NULL ELSE {c} END AS {c}", feats)
    named = [(n + f"_{out}", b.replace("FROM srt", f"FROM srt_{out}"))
             for n, b in tails(src, feats, f"({rate} / 2)", f"(1 - {rate} / 2)")]
    return named + [(out, f"SELECT row_id, label, {body} FROM {src}, q_{out}")]


def mar_tail(src: str, feats, rate: float, out: str = "m") -> list[tuple[str, str]]:
    share = 2 * (len(feats) - 1)
    parts = []
    for i, c in enumerate(feats):
        hit = " OR ".join(f"{o} < lo{j} OR {o} > hi{j}" for j, o in enumerate(feats) if j != i)
        parts.append(f"CASE WHEN {hit} THEN NULL ELSE {c} END AS {c}")
    named = [(n + f"_{out}", b.replace("FROM srt", f"FROM srt_{out}"))
             for n, b in tails(src, feats, f"({rate}{D} / {share})", f"(1 - {rate}{D} / {share})")]
    return named + [(out, f"SELECT row_id, label, {', '.join(parts)} FROM {src}, q_{out}")]


def exact_count(src: str, feats, probs: dict, rate: float, seed: int, out: str = "m") -> list[tuple[str, str]]:
    """``src`` holds the features and everything the probabilities need."""
    missed = ", ".join(f"coalesce({hash_uniform_sql(seed, 'draw|' + c)} < {probs[c]}, FALSE) AS b{i}, "
                       f"{hash_uniform_sql(seed, 'fix|' + c)} AS o{i}" for i, c in enumerate(feats))
    ranks = cols("row_number() OVER (ORDER BY b{i} DESC, o{i}, row_id) AS r{i}", feats)
    return [(f"{out}_h", f"SELECT *, {key_numbers_sql('row_id')} FROM {src}"),
            (f"{out}_b", f"SELECT *, {missed} FROM {out}_h"),
            (f"{out}_r", f"SELECT *, count(*) OVER () AS n, {ranks} FROM {out}_b"),
            (out, "SELECT row_id, label, " + cols(f"CASE WHEN r{{i}} <= round_even({rate}{D} * n, 0) THEN NULL ELSE {{c}} END AS {{c}}", feats)
             + f" FROM {out}_r")]


def clip(expr: str) -> str:
    return f"greatest(least({expr}, 0.99{D}), 0.01{D})"


def mnar_logistic(src: str, feats, rate: float, seed: int = 0) -> list[tuple[str, str]]:
    med = ("med", "SELECT " + ", ".join(f"{quantile(i, '0.5')} AS md{i}" for i in range(len(feats))) + " FROM srt")
    std = ("sd", "SELECT " + cols("stddev_pop({c}) AS sd{i}", feats) + f" FROM {src}")
    raw = ("raw", "SELECT t.*, " + cols("1.0::DOUBLE / (1.0::DOUBLE + exp(-(5.0::DOUBLE * ({c} - md{i}) / (sd{i} + 1e-8::DOUBLE)))) AS p{i}", feats)
           + f" FROM {src} t, med, sd")
    mean = ("pm", "SELECT " + cols("avg(p{i}) AS a{i}", feats) + " FROM raw")
    both = ("rawm", "SELECT raw.*, pm.* FROM raw, pm")
    probs = {c: clip(f"p{i} * {rate}{D} / (a{i} + 1e-8::DOUBLE)") for i, c in enumerate(feats)}
    return [sorted_lists(src, feats), med, std, raw, mean, both] + exact_count("rawm", feats, probs, rate, seed)


def regress(src: str, y: str, xs, where: str, out: str) -> list[tuple[str, str]]:
    """Least squares as one row (w0, w1, ..., b): elimination on the covariances, a step per CTE."""
    n = len(xs)
    names = [*xs, y]
    sums = [f"covar_pop({names[i]}, {names[j]}) AS a{i}_{j}" for i in range(n) for j in range(i, n + 1)]
    means = [f"avg({c}) AS m{i}" for i, c in enumerate(names)]
    steps = [(f"{out}_0!", f"SELECT {', '.join(sums + means)} FROM {src} WHERE {where}")]
    for k in range(n - 1):
        gone = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, n) for j in range(i, n + 1)]
        kept = [f"a{i}_{j}" for i in range(k + 1) for j in range(i, n + 1)]
        steps.append((f"{out}_{k + 1}!", f"SELECT {', '.join(gone + kept)}, {cols('m{i}', names)} FROM {out}_{k}"))
    back = []
    for k in reversed(range(n)):
        rest = "".join(f" - a{k}_{j} * w{j}" for j in range(k + 1, n))
        back.append(f"(a{k}_{n}{rest}) / a{k}_{k} AS w{k}")
    free = f"m{n}" + "".join(f" - w{i} * m{i}" for i in range(n))
    return [*steps, (f"{out}!", f"SELECT {', '.join(back)}, {free} AS b FROM {out}_{n - 1}")]


def fitted(y: str, feats, fit: str) -> str:
    return f"{fit}.b + " + " + ".join(f"{fit}.w{i} * {c}" for i, c in enumerate(c for c in feats if c != y))


def mar_linear(src: str, rate: float, seed: int = 0, feats=W) -> list[tuple[str, str]]:
    out, names = [], []
    for i, y in enumerate(feats):
        out += regress(src, y, [c for c in feats if c != y], "TRUE", f"g{i}")
        names.append(f"{fitted(y, feats, f'g{i}')} AS s{i}")
    out.append(("sco!", f"SELECT t.*, {', '.join(names)} FROM {src} t, {cols('g{i}', feats)}"))
    out.append(("ends", "SELECT " + cols("min(s{i}) AS n{i}, max(s{i}) AS x{i}", feats) + " FROM sco"))
    out.append(("raw", "SELECT sco.*, " + cols("(s{i} - n{i}) / ((x{i} - n{i}) + 1e-8::DOUBLE) AS p{i}", feats) + " FROM sco, ends"))
    out.append(("pm", "SELECT " + cols("avg(p{i}) AS a{i}", feats) + " FROM raw"))
    out.append(("rawm", "SELECT raw.*, pm.* FROM raw, pm"))
    probs = {c: clip(f"p{i} * {rate}{D} / (a{i} + 1e-8::DOUBLE)") for i, c in enumerate(feats)}
    return out + exact_count("rawm", feats, probs, rate, seed)


def table_of(src: str, feats, digits: int = 4, label: bool = True) -> str:
    return f"SELECT row_id, {'label, ' if label else ''}" + ", ".join(f"{r(c, digits)} AS {c}" for c in feats) + f" FROM {src}"


def fill(src: str, feats, agg: str, out: str = "imp") -> list[tuple[str, str]]:
    return [(f"{out}_f", "SELECT " + cols(agg + " AS v{i}", feats) + f" FROM {src}"),
            (out, "SELECT row_id, label, " + cols("coalesce({c}, v{i}) AS {c}", feats) + f" FROM {src}, {out}_f")]


def mode_fill(src: str, feats) -> list[tuple[str, str]]:
    picks = [(f"mo{i}", f"SELECT {c} AS v{i} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1")
             for i, c in enumerate(feats)]
    return picks + [("imp", "SELECT row_id, label, " + cols("coalesce({c}, v{i}) AS {c}", feats)
                     + f" FROM {src}, " + cols("mo{i}", feats))]


def cell_scores(truth: str, masked: str, imputed: str, feats) -> str:
    """``(col, rmse)`` over the missing cells."""
    parts = [f"SELECT {i} AS col, sqrt(avg(power(t.{c} - i.{c}, 2))) AS rmse FROM {truth} t JOIN {masked} m USING (row_id) "
             f"JOIN {imputed} i USING (row_id) WHERE m.{c} IS NULL" for i, c in enumerate(feats)]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE rmse IS NOT NULL"


def score_ctes() -> list[tuple[str, str]]:
    ctes = [RAW_WIDE, *scaled("wide", W)]
    parts = []
    for mech in ("mcar", "mar", "mnar"):
        for k, rate in enumerate(RATES):
            m = f"{mech}{k}"
            ctes += {"mcar": mcar, "mar": mar_tail, "mnar": mnar_tail}[mech]("z", W, rate, m)
            for imp, agg in (("mean", "avg({c})"), ("median", "median({c})")):
                ctes += fill(m, W, agg, f"{m}_{imp}")
                parts.append(f"SELECT '{mech}' AS mech, {rate}{D} AS rate, '{imp}' AS imp, col, rmse FROM ("
                             + cell_scores("z", m, f"{m}_{imp}", W) + ")")
    ctes.append(("sc0", " UNION ALL ".join(parts)))
    ctes.append(("stds", " UNION ALL ".join(f"SELECT {i} AS col, stddev_pop({c}) AS std0 FROM z" for i, c in enumerate(W))))
    ctes.append(("scores", "SELECT sc0.*, rmse / std0 AS rmse_std FROM sc0 JOIN stds USING (col)"))
    return ctes


def best(keys: str, value: str) -> str:
    mean = f"SELECT {keys}, imp, avg({value}) AS score FROM scores GROUP BY {keys}, imp"
    return (f"SELECT {keys}, imp, score FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score, imp) AS rn "
            f"FROM ({mean})) WHERE rn = 1")


def dist(a: str, b: str, feats=E) -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in feats) + f") / {len(feats)}.0::DOUBLE"


def neighbours(of: str, among: str, k: int, out: str, same_class: bool = False) -> tuple[str, str]:
    same = " AND q.label = d.label" if same_class else ""
    return (out, f"SELECT * FROM (SELECT q.row_id, q.label, d.row_id AS dk, d.label AS dlabel, {dist('q', 'd')} AS dist, "
            f"row_number() OVER (PARTITION BY q.row_id ORDER BY {dist('q', 'd')}, d.row_id) AS rank "
            f"FROM {of} q JOIN {among} d ON q.row_id <> d.row_id{same}) WHERE rank <= {k}")


SIZES = [("sizes", "SELECT label, count(*) AS n FROM emb GROUP BY label"),
         ("want", "SELECT label, n, (SELECT max(n) FROM sizes) - n AS want FROM sizes WHERE n < (SELECT max(n) FROM sizes)")]


def spread(seeds: str, seed: int, out: str = "plan0") -> list[tuple[str, str]]:
    return [(f"{out}_h", f"SELECT *, {key_numbers_sql('row_id')} FROM {seeds}"),
            (f"{out}_n", f"SELECT label, count(*) AS c FROM {seeds} GROUP BY label"),
            (f"{out}_r", f"SELECT h.*, row_number() OVER (PARTITION BY h.label ORDER BY {hash_uniform_sql(seed, 'seed')}, row_id) AS pos "
             f"FROM {out}_h h"),
            (out, f"SELECT t.*, want // c + CASE WHEN pos <= want % c THEN 1 ELSE 0 END AS n_new FROM {out}_r t "
             f"JOIN want USING (label) JOIN {out}_n USING (label)")]


def synth(plan: str, seed: int, k: int, out: str = "made") -> list[tuple[str, str]]:
    new = "t.row_id || '#' || i::VARCHAR"
    return [neighbours(plan, "emb", k, "near", same_class=True),
            ("near_n", "SELECT row_id, count(*) AS near FROM near GROUP BY row_id"),
            ("new0", f"SELECT t.*, {new} AS new_id, near FROM {plan} t JOIN near_n USING (row_id), "
             "LATERAL (SELECT unnest(range(1, n_new + 1)) AS i) WHERE n_new > 0"),
            ("new1", "SELECT * EXCLUDE (h1, h2, h3), " + key_numbers_sql("new_id") + " FROM new0" if plan == "plan0"
             else "SELECT *, " + key_numbers_sql("new_id") + " FROM new0"),
            ("new2", f"SELECT *, CAST(floor({hash_uniform_sql(seed, 'pick')} * near) + 1 AS BIGINT) AS pick, "
             f"{hash_uniform_sql(seed, 'gap')} AS gap FROM new1"),
            (out, "SELECT t.new_id AS row_id, t.label, " + cols("t.{c} + gap * (o.{c} - t.{c}) AS {c}", E)
             + " FROM new2 t JOIN near ON near.row_id = t.row_id AND near.rank = t.pick JOIN emb o ON o.row_id = near.dk")]


def all_rows(made: str = "made") -> tuple[str, str]:
    both = "row_id, label, " + ", ".join(E)
    return ("full_t", f"SELECT {both} FROM emb UNION ALL SELECT {both} FROM {made}")


SMOTE0 = [TEXT_EMB3, *SIZES, ("minor", "SELECT * FROM emb WHERE label IN (SELECT label FROM want)"),
          *spread("minor", 0), *synth("plan0", 0, 5), all_rows()]
SMOTE1 = [TEXT_EMB3, *SIZES, ("minor", "SELECT * FROM emb WHERE label IN (SELECT label FROM want)"),
          *spread("minor", 1), *synth("plan0", 1, 5), all_rows()]


def links(src: str) -> list[tuple[str, str]]:
    return [neighbours(src, src, 1, "nn1"),
            ("links", "SELECT a.row_id AS key_a, a.dk AS key_b FROM nn1 a JOIN nn1 b ON a.dk = b.row_id AND b.dk = a.row_id "
             "WHERE a.label <> b.label AND a.row_id < a.dk")]


def centers(src: str, feats) -> tuple[str, str]:
    return ("cen", "SELECT label AS cl, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS cluster, " + cols("avg({c}) AS k{i}", feats)
            + f" FROM {src} GROUP BY label")


def assigned(src: str, feats, out: str = "asg") -> list[tuple[str, str]]:
    d = " + ".join(f"(t.{c} - k{i}) * (t.{c} - k{i})" for i, c in enumerate(feats))
    return [centers(src, feats),
            (f"{out}_d", f"SELECT t.*, cluster, {d} AS d FROM {src} t, cen"),
            (out, f"SELECT * EXCLUDE (rn, d) FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, cluster) AS rn FROM {out}_d) WHERE rn = 1")]


def chain(rounds: int, src: str = "m", feats=W) -> list[tuple[str, str]]:
    """Chained least squares, left to right."""
    out = fill(src, feats, "avg({c})", "st0")
    out[-1] = ("st0!", "SELECT t.row_id, t.label, " + cols("coalesce({c}, v{i}) AS {c}, ({c} IS NULL) AS g{i}", feats) + f" FROM {src} t, st0_f")
    at = 0
    for _ in range(rounds):
        for i, y in enumerate(feats):
            out += regress(f"st{at}", y, [c for c in feats if c != y], f"NOT g{i}", f"rg{at}")
            out.append(refit(at, i, f"rg{at}", feats))
            at += 1
    out.append(("imp", f"SELECT * FROM st{at}"))
    return out


def refit(at: int, i: int, fit: str, feats) -> tuple[str, str]:
    """The next state: gaps of column i from its regression."""
    y = feats[i]
    keep = ", ".join(f"CASE WHEN g{i} THEN {fitted(y, feats, fit)} ELSE {c} END AS {c}" if c == y else c for c in feats)
    return (f"st{at + 1}!", f"SELECT row_id, label, {keep}, {cols('g{i}', feats)} FROM st{at}, {fit}")


def column_wise(src: str = "m", feats=W) -> list[tuple[str, str]]:
    """One regression per column on the mean-filled others, then refined left to right."""
    out = chain(0, src, feats)[:-1]
    for i, y in enumerate(feats):
        out += regress("st0", y, [c for c in feats if c != y], f"NOT g{i}", f"rg{i}")
    for i in range(len(feats)):
        out.append(refit(i, i, f"rg{i}", feats))
    return out + [("imp", f"SELECT * FROM st{len(feats)}")]


def long_profile(src: str, feats) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS col_idx, '{c}' AS col, count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        f"{r(f'stddev_pop({c})')} AS std0, min({c}) AS min, max({c}) AS max, {r(f'max({c}) - min({c})')} AS range FROM {src}"
        for i, c in enumerate(feats))


def corr_rows(src: str, feats) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM {src}"
                              for i, a in enumerate(feats) for j, b in enumerate(feats))


def missing_long(src: str, feats, by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {head}{i} AS col_idx, '{c}' AS col, count(*) AS n, count(*) - count({c}) AS n_miss, "
        f"{r(f'avg(({c} IS NULL)::INTEGER)', 6)} AS rate FROM {src}{tail}" for i, c in enumerate(feats))


def closest(rate: str) -> str:
    bins = "[0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]"
    return f"(list_sort(list_transform({bins}, lambda b: {{'d': abs(b - {rate}), 'b': b}}))[1]).b"


def class_folds(src: str, k: int, seed: int) -> list[tuple[str, str]]:
    return [("fh", f"SELECT row_id, label, {key_numbers_sql('row_id')} FROM {src}"),
            ("folds", f"SELECT row_id, label, ntile({k}) OVER (PARTITION BY label ORDER BY {hash_uniform_sql(seed, 'fold')}, row_id)::INTEGER AS fold FROM fh")]


def leak_free() -> str:
    """Scaler and class centres of the training rows, applied to fold 1."""
    d = " + ".join(f"(t.{c} - k{i}) * (t.{c} - k{i})" for i, c in enumerate(W))
    return query([RAW_WIDE, *class_folds("wide", 5, 7), ("parts", "SELECT wide.*, fold FROM wide JOIN folds USING (row_id)"),
                  ("sc", "SELECT " + cols("avg({c}) AS m{i}, stddev_pop({c}) AS s{i}", W) + " FROM parts WHERE fold <> 1"),
                  ("z", "SELECT row_id, label, fold, " + cols("({c} - m{i}) / s{i} AS {c}", W) + " FROM parts, sc"),
                  ("train", "SELECT * FROM z WHERE fold <> 1"), centers("train", W),
                  ("near", f"SELECT t.*, cluster, row_number() OVER (PARTITION BY row_id ORDER BY {d}, cluster) AS rn FROM z t, cen WHERE fold = 1")],
                 table_of("near", W).replace("SELECT row_id", "SELECT cluster, row_id") + " WHERE rn = 1")


def centroid_scores() -> list[tuple[str, str]]:
    """Score of each class by closeness to its centroid, rounded so that ties occur."""
    d = " + ".join(f"(t.{c} - k{i}) * (t.{c} - k{i})" for i, c in enumerate(E))
    return [RAW_EMB3, centers("emb", E),
            ("cd", f"SELECT t.row_id, t.label, cluster, 1.0{D} / (1.0{D} + ({d})) AS s FROM emb t, cen"),
            ("cs", "SELECT row_id, label, cluster, round(s / sum(s) OVER (PARTITION BY row_id), 3) AS score FROM cd")]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    zw = [RAW_WIDE, *scaled("wide", W)]
    m_raw = [RAW_WIDE, *mcar("wide", W, 0.2)]
    m_z = [*zw, *mcar("z", W, 0.2)]

    q["wide_features"] = query([RAW_WIDE], "SELECT row_id, label, " + ", ".join(W) + " FROM wide")
    q["label_index"] = query([RAW_WIDE], "SELECT label, label_idx, count(*) AS n FROM (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_idx FROM wide) GROUP BY ALL")
    q["zscore"] = query(zw, table_of("z", W))
    q["profile"] = query([RAW_WIDE], long_profile("wide", W))
    q["medians"] = query([RAW_WIDE], " UNION ALL ".join(f"SELECT '{c}' AS col, {r(f'median({c})', 6)} AS value FROM wide" for c in W))
    q["quantiles"] = query([RAW_WIDE, sorted_lists("wide", W)], " UNION ALL ".join(
        f"SELECT '{c}' AS col, {p}{D} AS p, {r(quantile(i, str(p)), 6)} AS value FROM srt" for i, c in enumerate(W) for p in (0.1, 0.25, 0.9)))
    q["corr_long"] = query([RAW_WIDE, ("cr", corr_rows("wide", W))], f"SELECT i, j, {r('r', 6)} AS r FROM cr")
    q["corr_offdiag"] = query([RAW_WIDE, ("cr", corr_rows("wide", W))],
                              f"SELECT i AS col_idx, {r('max(abs(r))', 6)} AS max_corr, {r('avg(abs(r))', 6)} AS mean_corr FROM cr WHERE i <> j GROUP BY i")
    q["class_counts"] = query([RAW_WIDE], "SELECT label, count(*) AS n FROM wide GROUP BY label")
    q["head_rows"] = query(zw, f"SELECT row_id, {r('l_quantity')} AS l_quantity FROM z ORDER BY row_id LIMIT 5")
    q["sentinel_to_null"] = query([RAW_WIDE, ("tx", "SELECT label, CASE WHEN label = 'N' THEN '?' ELSE CAST(l_quantity AS BIGINT)::VARCHAR END AS t FROM wide")],
                                  f"SELECT label, count(*) AS n, count(nullif(t, '?')) AS n_known, {r('avg(CAST(nullif(t, $$?$$) AS DOUBLE))')} AS mean FROM tx GROUP BY label")
    q["complete_cases"] = query(m_raw, "SELECT row_id, label, " + ", ".join(W) + " FROM m WHERE " + cols("{c} IS NOT NULL", W, " AND "))
    q["tail_rows"] = query([RAW_WIDE, *tails("wide", W, "0.05", "0.95")],
                           "SELECT DISTINCT row_id FROM wide, q WHERE " + cols("{c} < lo{i} OR {c} > hi{i}", W, " OR "))

    q["stratified_folds"] = query([RAW_WIDE, *class_folds("wide", 5, 7)], "SELECT row_id, label, fold FROM folds")
    fold_counts = "SELECT fold, label, count(*) AS n FROM folds GROUP BY fold, label"
    q["fold_class_counts"] = query([RAW_WIDE, *class_folds("wide", 5, 7)], fold_counts)
    q["fold_write_read"] = query([RAW_WIDE, *class_folds("wide", 5, 7)],
                                 "SELECT part, label, count(*) AS n FROM (SELECT CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS part, label FROM folds) GROUP BY part, label")

    raw_out = "SELECT row_id, label, " + ", ".join(W) + " FROM m"
    q["mcar_mask"] = query(m_raw, raw_out)
    q["mcar_check"] = query([RAW_WIDE, *mcar("wide", W, 0.05)], " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(*) - count({c}) AS n_miss, CAST(round_even(0.05{D} * count(*), 0) AS BIGINT) AS n_need, "
        f"(count(*) - count({c})) = CAST(round_even(0.05{D} * count(*), 0) AS BIGINT) AS ok FROM m" for c in W))
    q["mnar_tail"] = query([RAW_WIDE, *mnar_tail("wide", W, 0.2)], raw_out)
    q["mar_tail"] = query([RAW_WIDE, *mar_tail("wide", W, 0.2)], raw_out)
    q["mnar_logistic"] = query([RAW_WIDE, *mnar_logistic("wide", W, 0.2)], raw_out)
    ev = ("ev", "SELECT event_id AS row_id, value::DOUBLE AS value, event_type AS label FROM events")
    q["mnar_logistic_events"] = query([ev, *mnar_logistic("ev", ("value",), 0.2)], "SELECT row_id, label, value FROM m")
    q["mar_linear"] = query([*zw[:-1], ("z!", zw[-1][1]), *mar_linear("z", 0.3)], table_of("m", W))
    grid, parts = [RAW_WIDE], []
    for k, rate in enumerate((0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)):
        for mech, make in (("mcar", mcar), ("mnar", mnar_tail), ("mar", mar_tail)):
            name = f"{mech}_{k}"
            grid += make("wide", W, rate, name)
            parts += [f"SELECT '{mech}' AS mech, {rate}{D} AS rate, '{c}' AS col, count(*) - count({c}) AS n_miss FROM {name}" for c in W]
    q["scenario_grid"] = query(grid, " UNION ALL ".join(parts))

    q["missing_rate"] = query([RAW_WIDE, *mar_tail("wide", W, 0.2)], missing_long("m", W))
    by_label = [RAW_WIDE, *mar_tail("wide", W, 0.2)]
    q["missing_rate_by_cluster"] = query(by_label, missing_long("m", W, "label"))
    q["rate_bin"] = query([*by_label, ("ml", missing_long("m", W, "label"))],
                          f"SELECT label, col_idx, {closest('rate')} AS rate_bin FROM ml")
    q["max_iter"] = query([*by_label, ("ml", missing_long("m", W, "label"))],
                          "SELECT label, col_idx, CASE WHEN rate <= 0.10::DOUBLE THEN 5 WHEN rate <= 0.30::DOUBLE THEN 10 WHEN rate <= 0.50::DOUBLE THEN 15 ELSE 20 END AS max_iter FROM ml")

    q["mean_fill"] = query([*m_z, *fill("m", W, "avg({c})")], table_of("imp", W))
    q["median_fill"] = query([*m_z, *fill("m", W, "median({c})")], table_of("imp", W))
    q["mode_fill"] = query([*m_raw, *mode_fill("m", W)], "SELECT row_id, label, " + ", ".join(W) + " FROM imp")
    q["constant_fill"] = query(m_raw, "SELECT row_id, label, " + cols("coalesce({c}, 0.0::DOUBLE) AS {c}", W) + " FROM m")

    mean_imp = [*zw, *mnar_tail("z", W, 0.2), *fill("m", W, "avg({c})")]
    q["flagship"] = query(mean_imp, f"SELECT col, {r('rmse', 6)} AS rmse FROM (" + cell_scores("z", "m", "imp", W) + ")")
    q["rmse_cells"] = q["flagship"]
    sums = " + ".join(f"sum(CASE WHEN m.{c} IS NULL THEN power(t.{c} - i.{c}, 2) ELSE 0 END)" for c in W)
    counts = " + ".join(f"sum(CASE WHEN m.{c} IS NULL THEN 1 ELSE 0 END)" for c in W)
    three = "FROM z t JOIN m USING (row_id) JOIN imp i USING (row_id)"
    q["rmse_pooled"] = query(mean_imp, f"SELECT {r(f'sqrt(({sums}) / ({counts}))', 6)} AS rmse {three}")
    whole = " + ".join(f"sqrt(avg(power(t.{c} - i.{c}, 2)))" for c in W)
    number = "dense_rank() OVER (ORDER BY label) - 1"
    nine = f"{whole} + sqrt(avg(power(t.y - i.y, 2)))"
    q["rmse_table"] = query([*mean_imp, ("zy", f"SELECT *, {number} AS y FROM z"), ("iy", f"SELECT *, {number} AS y FROM imp")],
                            f"SELECT {r(f'({nine}) / {len(W) + 1}', 6)} AS rmse FROM zy t JOIN iy i USING (row_id)")
    q["report_write"] = q["rmse_cells"]
    q["csv_round_trip"] = query([TEXT_EMB], table_of("emb", E, 6))
    q["keyless_ingest"] = query([RAW_WIDE], "SELECT label, count(*) AS n, count(*) AS n_keys FROM wide GROUP BY label")
    q["leak_free_scale"] = leak_free()
    sc = score_ctes()
    q["union_scores"] = query(sc, f"SELECT mech, rate, imp, col, {r('rmse', 6)} AS rmse FROM scores")
    q["rmse_std"] = query(sc, f"SELECT mech, rate, imp, col, {r('rmse_std', 6)} AS rmse_std FROM scores")
    diff = "SELECT col, {0} AS mean, {1} AS std, {2} AS max FROM scores GROUP BY col"
    q["col_difficulty"] = query(sc, diff.format(r("avg(rmse)", 6), r("stddev_samp(rmse)", 6), r("max(rmse)", 6)))
    q["col_difficulty_std"] = query(sc, diff.format(r("avg(rmse_std)", 6), r("stddev_samp(rmse_std)", 6), r("max(rmse_std)", 6)))
    pivot = ", ".join(f"{r(f'avg(CASE WHEN rate = {x}{D} AND imp = $${m}$$ THEN rmse END)', 6)} AS \"{x}_{m}\"" for x in RATES for m in ("mean", "median"))
    q["rmse_pivot"] = query(sc, f"SELECT col, {pivot} FROM scores GROUP BY col")
    q["rmse_at_rate"] = query(sc, f"SELECT imp, col, {r('avg(rmse)', 6)} AS rmse FROM scores WHERE rate = 0.1{D} GROUP BY imp, col")
    q["append_metrics"] = query(sc, f"SELECT mech, imp, count(*) AS n, {r('avg(rmse)', 6)} AS rmse FROM scores GROUP BY mech, imp")
    q["best_by_rate"] = query(sc, f"SELECT rate, imp, {r('score', 6)} AS score FROM (" + best("rate", "rmse") + ")")
    q["best_by_rate_col"] = query(sc, f"SELECT rate, col, imp, {r('score', 6)} AS score FROM (" + best("rate, col", "rmse_std") + ")")
    look = [*sc, *mar_tail("z", W, 0.2, "lm"),
            ("ml", missing_long("lm", W, "label")), ("asked", f"SELECT label, col_idx, {closest('rate')} AS rate_bin FROM ml"),
            ("bc", best("rate, col", "rmse_std")), ("br", best("rate", "rmse"))]
    q["policy_lookup"] = query(look, "SELECT a.label, a.col_idx, a.rate_bin, coalesce(bc.imp, br.imp, 'LR') AS imp FROM asked a "
                               "LEFT JOIN bc ON bc.rate = a.rate_bin AND bc.col = a.col_idx LEFT JOIN br ON br.rate = a.rate_bin")
    stats = " UNION ALL ".join(f"SELECT {i} AS col_idx, avg({c}) AS col_mean, stddev_samp({c}) AS col_std, max({c}) - min({c}) AS col_range FROM z" for i, c in enumerate(W))
    q["meta_features"] = query([*sc, ("st", stats), ("cr", corr_rows("z", W)),
                                ("oc", "SELECT i AS col_idx, max(abs(r)) AS max_corr, avg(abs(r)) AS mean_corr FROM cr WHERE i <> j GROUP BY i"),
                                ("bc", best("rate, col", "rmse_std"))],
                               f"SELECT rate, col_idx, {r('col_mean', 6)} AS col_mean, {r('col_std', 6)} AS col_std, {r('col_range', 6)} AS col_range, "
                               f"{r('max_corr', 6)} AS max_corr, {r('mean_corr', 6)} AS mean_corr, imp AS best_imp FROM bc JOIN st ON st.col_idx = bc.col JOIN oc USING (col_idx)")

    q["lr_impute"] = query([*m_z, *column_wise()], table_of("imp", W))
    q["mice_lr_1round"] = query([*m_z, *chain(1)], table_of("imp", W))
    q["mice_lr_rounds"] = query([*m_z, *chain(3)], table_of("imp", W))
    q["saved_model"] = q["mice_lr_rounds"]

    empty = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in W)
    plain = ("p", "SELECT " + cols("avg({c}) AS a{i}", W) + " FROM m")
    wrong = " + ".join(f"sum(CASE WHEN m.{c} IS NULL THEN (z.{c} - p.a{i}) * (z.{c} - p.a{i}) ELSE 0.0{D} END)" for i, c in enumerate(W))
    holes = " + ".join(f"count(*) FILTER (m.{c} IS NULL)" for c in W)
    fill_error = ("e", f"SELECT sqrt(({wrong}) / ({holes})) AS rmse FROM z JOIN m USING (row_id), p")
    for name, imps in (("linear_facts", "lr br svd mf column cluster uncertain"), ("tree_facts", "rf gb et column")):
        listed = ", ".join(f"'{i}'" for i in imps.split())
        q[name] = query([*m_z, ("f", f"SELECT count(*) AS n, CAST({empty} AS BIGINT) AS n_gaps FROM m"), plain, fill_error],
                        f"SELECT unnest([{listed}]) AS imp, n, n_gaps, 0::BIGINT AS n_moved, 0::BIGINT AS n_left, "
                        f"{r('rmse', 6)} AS mean_rmse, TRUE AS near FROM f, e")

    q["knn_join"] = query([RAW_EMB, neighbours("emb", "emb", 3, "nn")], f"SELECT row_id, dk, rank::INTEGER AS rank, {r('dist', 6)} AS dist FROM nn")
    q["knn_join_in_class"] = query([RAW_EMB3, neighbours("emb", "emb", 5, "nn", True)], f"SELECT row_id, dk, rank::INTEGER AS rank, {r('dist', 6)} AS dist FROM nn")
    both = "(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)"
    xs = [*E, "label"]
    ssd = " + ".join(f"CASE WHEN {both.format(c=c)} THEN (q.{c} - d.{c}) * (q.{c} - d.{c}) ELSE 0.0{D} END" for c in xs)
    shared = " + ".join(f"{both.format(c=c)}::INTEGER" for c in xs)
    knn = [RAW_EMB, *mcar("emb", E, 0.3),
           ("pr", f"SELECT q.row_id, d.row_id AS dk, ({ssd}) / ({shared}) AS dist, " + cols("q.{c} IS NULL AS g{i}, d.{c} AS v{i}", E)
            + " FROM m q JOIN m d ON q.row_id <> d.row_id"),
           ("mu", "SELECT " + cols("avg({c}) AS a{i}", E) + " FROM m")]
    for i, c in enumerate(E):
        knn.append((f"w{i}", f"SELECT row_id, sum(v{i} / greatest(dist, 1e-6{D})) / sum(1.0{D} / greatest(dist, 1e-6{D})) AS x{i} FROM ("
                    f"SELECT row_id, v{i}, dist, row_number() OVER (PARTITION BY row_id ORDER BY dist, dk) AS rn FROM pr WHERE g{i} AND v{i} IS NOT NULL) "
                    f"WHERE rn <= 3 GROUP BY row_id"))
    q["knn_impute"] = query(knn, "SELECT m.row_id, label, " + ", ".join(f"{r(f'coalesce({c}, x{i}, a{i})')} AS {c}" for i, c in enumerate(E))
                            + " FROM m, mu " + " ".join(f"LEFT JOIN w{i} ON w{i}.row_id = m.row_id" for i in range(len(E)))) \
        .replace("FROM m, mu ", "FROM m CROSS JOIN mu ")

    q["tomek_links"] = query([RAW_EMB3, *links("emb")], "SELECT key_a, key_b FROM links")
    q["enn"] = query([RAW_EMB3, neighbours("emb", "emb", 3, "nn")],
                     "SELECT row_id, label FROM emb WHERE row_id NOT IN (SELECT row_id FROM nn WHERE label <> dlabel)")
    q["smote"] = query(SMOTE0, table_of("full_t", E, 6))
    q["smote_tomek"] = query([*SMOTE0, *links("full_t")],
                             table_of("full_t", E, 6) + " WHERE row_id NOT IN (SELECT key_a FROM links UNION ALL SELECT key_b FROM links)")
    q["smote_enn"] = query([*SMOTE1, neighbours("full_t", "full_t", 3, "nn3")],
                           table_of("full_t", E, 6) + " WHERE row_id NOT IN (SELECT row_id FROM nn3 WHERE label <> dlabel)")
    border = [TEXT_EMB3, *SIZES, ("minor", "SELECT * FROM emb WHERE label IN (SELECT label FROM want)"),
              neighbours("minor", "emb", 10, "n10"),
              ("danger", "SELECT row_id FROM n10 GROUP BY row_id HAVING count(*) FILTER (label <> dlabel) >= 5 AND count(*) FILTER (label <> dlabel) < 10"),
              ("seeds", "SELECT * FROM minor WHERE row_id IN (SELECT row_id FROM danger)"),
              *spread("seeds", 2), *synth("plan0", 2, 5), all_rows()]
    q["borderline_smote"] = query(border, table_of("full_t", E, 6))
    ada = [TEXT_EMB3, *SIZES, ("minor", "SELECT * FROM emb WHERE label IN (SELECT label FROM want)"),
           neighbours("minor", "emb", 5, "n5"),
           ("ra", f"SELECT row_id, label, count(*) FILTER (label <> dlabel) / 5.0{D} AS r FROM n5 GROUP BY row_id, label"),
           ("rs", "SELECT label, sum(r) AS s FROM ra GROUP BY label"),
           ("plan", "SELECT minor.*, CAST(round_even(r / s * want, 0) AS BIGINT) AS n_new FROM minor JOIN ra USING (row_id, label) JOIN rs USING (label) JOIN want USING (label)"),
           *synth("plan", 3, 5), all_rows()]
    q["adasyn"] = query(ada, table_of("full_t", E, 6))

    q["kmeans_assign"] = query([*zw, *assigned("z", W)], "SELECT row_id, cluster FROM asg")
    q["cluster_sizes"] = query([*zw, *assigned("z", W)], "SELECT cluster, count(*) AS n FROM asg GROUP BY cluster")
    d2 = ", ".join(f"list(greatest(d, 1e-12{D}) ORDER BY cluster)" for _ in (0,))
    u = [f"1.0{D} / (" + " + ".join(f"(ds[{j}] / ds[{l}])" for l in (1, 2, 3)) + ")" for j in (1, 2, 3)]
    fcm = [RAW_EMB3, *assigned("emb", E)[:2], ("dd", f"SELECT row_id, any_value(label) AS label, " + cols("any_value({c}) AS {c}", E) + f", {d2} AS ds FROM asg_d GROUP BY row_id")]
    fcm.append(("uu", "SELECT *, " + ", ".join(f"power({e}, 2) AS u{j}" for j, e in enumerate(u)) + " FROM dd"))
    q["fcm_step"] = query(fcm, " UNION ALL ".join(
        f"SELECT {j} AS cluster, {r(f'sum(u{j})', 6)} AS weight, " + ", ".join(f"{r(f'sum(u{j} * {c}) / sum(u{j})', 6)} AS {c}" for c in E) + " FROM uu" for j in range(3)))
    norm = " + ".join(f"avg({c}) * avg({c})" for c in E)
    q["mcmv"] = query([RAW_EMB3, *assigned("emb", E)], f"SELECT cluster, {r(norm, 6)} AS mcmv FROM asg GROUP BY cluster")
    q["mcmv_feature"] = query([RAW_EMB3, *assigned("emb", E), ("nv", f"SELECT cluster, {norm} AS mcmv FROM asg GROUP BY cluster")],
                              f"SELECT row_id, {r('mcmv', 6)} AS mcmv FROM asg JOIN nv USING (cluster)")
    q["onehot_cluster"] = query([RAW_EMB3, *assigned("emb", E)],
                                "SELECT row_id, " + ", ".join(f"(cluster = {j})::INTEGER::DOUBLE AS c{j}" for j in range(3)) + " FROM asg")
    sq = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in E)
    for name, expr in (("silhouette", f"sqrt({sq})"), ("silhouette_squared", f"({sq})")):
        q[name] = query([RAW_EMB3, *assigned("emb", E), ("sz", "SELECT cluster, count(*) AS n FROM asg GROUP BY cluster"),
                         ("sm", f"SELECT a.row_id, a.cluster, b.cluster AS other, sum({expr}) AS s FROM asg a, asg b GROUP BY ALL"),
                         ("ab", "SELECT row_id, max(CASE WHEN sm.cluster = other THEN s / greatest(sz.n - 1, 1) END) AS a, min(CASE WHEN sm.cluster <> other THEN s / sz.n END) AS b, "
                          "max(CASE WHEN sm.cluster = other THEN sz.n END) AS own FROM sm JOIN sz ON sz.cluster = sm.other GROUP BY row_id")],
                        f"SELECT {r('avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette FROM ab")

    q["accuracy"] = query([*centroid_scores(), ("pick", "SELECT row_id, label, arg_min(cluster, {'s': -score, 'c': cluster}) AS prediction FROM cs GROUP BY row_id, label")],
                          f"SELECT {r('avg((label = prediction)::INTEGER)', 6)} AS accuracy FROM pick")
    auc = ("SELECT a, b, (sum(CASE WHEN label = a THEN rk END) - count(*) FILTER (label = a) * (count(*) FILTER (label = a) + 1) / 2.0) / "
           "(count(*) FILTER (label = a) * count(*) FILTER (label = b)) AS auc FROM rkd GROUP BY a, b")
    q["ovo_auc"] = query([*centroid_scores(),
                          ("prs", "SELECT x.cluster AS a, y.cluster AS b FROM (SELECT DISTINCT cluster FROM cen) x, (SELECT DISTINCT cluster FROM cen) y WHERE x.cluster <> y.cluster"),
                          ("pts", "SELECT a, b, row_id, label, score FROM cs JOIN prs ON cs.cluster = a WHERE label IN (a, b)"),
                          ("rkd", "SELECT *, rank() OVER (PARTITION BY a, b ORDER BY score) + (count(*) OVER (PARTITION BY a, b, score) - 1) / 2.0 AS rk FROM pts"),
                          ("au", auc)], f"SELECT {r('avg(auc)', 6)} AS auc FROM au")
    q["cv_summary"] = query([*centroid_scores(), ("pick", "SELECT row_id, label, arg_min(cluster, {'s': -score, 'c': cluster}) AS prediction FROM cs GROUP BY row_id, label"),
                             *class_folds("pick", 5, 0), ("fa", "SELECT fold, avg((p.label = prediction)::INTEGER) AS score FROM pick p JOIN folds USING (row_id) GROUP BY fold")],
                            f"SELECT {r('avg(score)', 6)} AS mean, {r('stddev_pop(score)', 6)} AS std FROM fa")
    return q
