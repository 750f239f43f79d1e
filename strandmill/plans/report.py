"""Model tables as DataFrames, and reports of a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import matrix as M
from strandmill.functions.alphabet import FROM_MASK, MASK


def normalize(m: DataFrame) -> DataFrame:
    """(motif, col, base, p) with columns to sum 1."""
    return m.withColumn("p", F.try_divide("p", F.sum("p").over(Window.partitionBy("motif", "col"))))


def information(m: DataFrame, q: float = 0.25) -> DataFrame:
    """(motif, col, ic, entropy) in bits."""
    some = lambda x: F.sum(F.when(F.col("p") > 0, F.col("p") * x).otherwise(0.0))
    return m.groupBy("motif", "col").agg(some(F.log2(F.col("p") / q)).alias("ic"), (-some(F.log2("p"))).alias("entropy"))


def log_odds(m: DataFrame, q: float = 0.25) -> DataFrame:
    """Adds log_odds and affinity (share of the column's largest)."""
    return m.withColumn("log_odds", F.log2(F.col("p") / q)).withColumn("affinity", F.try_divide("p", F.max("p").over(Window.partitionBy("motif", "col"))))


def maximum(m: DataFrame, q: float = 0.25) -> DataFrame:
    """(motif, max_probability, max_score, best) of the likeliest string."""
    best = m.groupBy("motif", "col").agg(F.max("p").alias("p"), F.max_by("base", F.struct("p", F.expr("-ascii(base)"))).alias("base"))
    return best.groupBy("motif").agg(F.exp(F.sum(F.ln("p"))).alias("max_probability"), F.sum(F.log2(F.col("p") / q)).alias("max_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "base"))), lambda x: x["base"]), "").alias("best"))


def consensus(m: DataFrame) -> DataFrame:
    """(motif, consensus): the IUPAC string of each model; see ``matrix.consensus`` for the rule."""
    cols = m.groupBy("motif", "col").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("minus"), "base"))).alias("s"))
    p = lambda i: -F.col("s")[i]["minus"]
    n = F.when((p(0) > 0.5) & (p(0) >= 2 * p(1)), 1).when(p(0) + p(1) > 0.75, 2).when(p(3) < 0.01, 3).otherwise(4)
    bits = F.create_map(*[F.lit(x) for b in "ACGT" for x in (b, MASK[b])])
    mask = F.aggregate(F.slice("s", F.lit(1), n), F.lit(0), lambda acc, x: acc + F.element_at(bits, x["base"]))
    letters = F.create_map(*[F.lit(x) for k, c in FROM_MASK.items() for x in (k, c)])
    cols = cols.select("motif", "col", F.element_at(letters, mask).alias("c"))
    return cols.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "c"))), lambda x: x["c"]), "").alias("consensus"))


def logo_heights(m: DataFrame, q: float = 0.25) -> DataFrame:
    """(motif, col, base, height): a letter's share of its column's information."""
    return m.join(information(m, q).drop("entropy"), ["motif", "col"]).select("motif", "col", "base", (F.col("p") * F.col("ic")).alias("height"))


def history(spark: SparkSession, result) -> DataFrame:
    """A row for each round of a fit."""
    schema = "round int, ll double, expected_ll double, n_params int, lambda_bg double, lambdas array<double>, seeds array<string>, avg_ic array<double>, max_dist double"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(h[n] for n in names) for h in result.history], schema)


def models(spark: SparkSession, state, cfg) -> DataFrame:
    """(motif, col, prev, base, p, ip): transitions and marginals; prev is null in column 0 and for order-zero models."""
    from strandmill.functions.adm import Adm

    rows = []
    for k, t in enumerate(state.models):
        ip = Adm(t).ip
        for j in range(t.shape[2]):
            for a in range(1 if j == 0 or cfg.model == "ppm" else 4):
                for b in range(4):
                    prev = None if j == 0 or cfg.model == "ppm" else "ACGT"[a]
                    rows.append((k, j, prev, "ACGT"[b], float(ip[b, j] if prev is None else t[a, b, j]), float(ip[b, j])))
    return spark.createDataFrame(rows, "motif int, col int, prev string, base string, p double, ip double")


def cob_table(spark: SparkSession, state) -> DataFrame:
    """(pair, orient, d, lambda) of all dimer cases."""
    rows = [(f"{p.tf1}-{p.tf2}", o, d, float(x)) for p in state.pairs for (o, d), x in p.lambdas.items()]
    return spark.createDataFrame(rows, "pair string, orient string, d int, lambda double")


def cob_matrix(cob: DataFrame, distances: list[int]) -> DataFrame:
    """One row for each pair and orientation, a column for each distance; the table behind a heat map."""
    return cob.groupBy("pair", "orient").pivot("d", distances).agg(F.first("lambda"))


def best_cases(cob: DataFrame) -> DataFrame:
    """(pair, orient, d, lambda) of each pair's heaviest case."""
    best = cob.groupBy("pair").agg(F.max(F.struct("lambda", "orient", "d")).alias("b"))
    return best.select("pair", "b.orient", "b.d", "b.lambda")


def deviations(spark: SparkSession, state) -> DataFrame:
    """(pair, orient, d, row, col, delta): observed less expected of the learned cases, non-zero cells."""
    rows = []
    for p in state.pairs:
        for (o, d), dev in p.deviation.items():
            flat = dev.reshape(16, -1)
            rows += [(f"{p.tf1}-{p.tf2}", o, d, i, j, float(flat[i, j])) for i in range(16) for j in range(flat.shape[1]) if flat[i, j]]
    return spark.createDataFrame(rows, "pair string, orient string, d int, row int, col int, delta double")


def observed_expected(spark: SparkSession, state, cfg) -> DataFrame:
    """(pair, orient, d, base, col, observed, expected): marginals of the learned cases."""
    from strandmill.functions.adm import Adm
    from strandmill.plans.em import expected

    rows = []
    for p in state.pairs:
        for (o, d), t in p.observed.items():
            x, y = Adm(t).ip, Adm(expected(state, p, o, d, cfg)).ip
            rows += [(f"{p.tf1}-{p.tf2}", o, d, "ACGT"[i], j, float(x[i, j]), float(y[i, j])) for i in range(4) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "pair string, orient string, d int, base string, col int, observed double, expected double")


def logo_svg(m, width: int = 40, height: int = 100) -> str:
    """A sequence logo of a 4 x k matrix as SVG: letters stacked by height, the tallest on top."""
    colours = dict(zip("ACGT", ("#109648", "#255C99", "#F7B32B", "#D62839"), strict=True))
    k = m.shape[1]
    ic = M.information_content(m)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width * k}" height="{height}" font-family="monospace" font-weight="bold">']
    for j in range(k):
        y = float(height)
        for i in sorted(range(4), key=lambda i: m[i, j]):
            h = float(m[i, j] * ic[j] / 2 * height)
            if h > 0.5:
                out.append(f'<g transform="translate({j * width},{y:.2f}) scale({width / 60:.4f},{h / 72:.4f})"><text font-size="100" fill="{colours["ACGT"[i]]}">{"ACGT"[i]}</text></g>')
            y -= h
    return "\n".join([*out, "</svg>"])


def heatmap_svg(pair, cell: int = 36) -> str:
    """A pair's weights by orientation and distance, in thousandths."""
    distances = list(range(pair.dmin, pair.dmax + 1))
    top = max([*pair.lambdas.values(), 1e-12])
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{cell * (len(distances) + 1)}" height="{cell * (len(pair.orientations) + 1)}" font-family="sans-serif" font-size="11">']
    for i, d in enumerate(distances):
        out.append(f'<text x="{cell * (i + 1.3):.0f}" y="{cell * 0.6:.0f}">{d}</text>')
    for r, o in enumerate(pair.orientations):
        out.append(f'<text x="4" y="{cell * (r + 1.6):.0f}">{o}</text>')
        for i, d in enumerate(distances):
            x = pair.lambdas.get((o, d), 0.0)
            shade = int(255 - 200 * x / top)
            out.append(f'<rect x="{cell * (i + 1)}" y="{cell * (r + 1)}" width="{cell}" height="{cell}" fill="rgb(255,{shade},{shade})"/>')
            out.append(f'<text x="{cell * (i + 1.15):.0f}" y="{cell * (r + 1.6):.0f}">{1000 * x:.0f}</text>')
    return "\n".join([*out, "</svg>"])


def html(result, cfg, names: list[str] | None = None, visual: bool = True) -> str:
    """A page with the fit's parameters, its rounds, and each motif and pair; without pictures if not ``visual``."""
    from dataclasses import asdict

    from strandmill.plans.em import ppm

    state = result.state
    names = names or [f"motif{k}" for k in range(len(state.models))]
    table = lambda head, rows: "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in [head, *rows]) + "</table>"
    show = lambda x: f"{x:.4g}" if isinstance(x, float) else ", ".join(map(show, x)) if isinstance(x, list) else str(x)
    out = ["<html><head><meta charset='utf-8'><style>td{padding:2px 8px}</style></head><body>", "<h2>Parameters</h2>", table(("name", "value"), asdict(cfg).items())]
    if result.history:
        keys = list(result.history[0])
        out += ["<h2>Rounds</h2>", table(keys, [[show(h[k]) for k in keys] for h in result.history])]
    out += ["<h2>Motifs</h2>", table(("motif", "seed", "weight"), [(n, s, f"{x:.6f}") for n, s, x in zip(names, state.seeds, state.lambdas, strict=True)])]
    if visual:
        out += [f"<h3>{n}</h3>{logo_svg(ppm(t))}" for n, t in zip(names, state.models, strict=True)]
    for p in state.pairs:
        out.append(f"<h2>{names[p.tf1]} - {names[p.tf2]}</h2>")
        out.append(heatmap_svg(p) if visual else table(("orientation", "distance", "weight"), [(o, d, f"{x:.5f}") for (o, d), x in p.lambdas.items()]))
    return "\n".join([*out, "</body></html>"])
