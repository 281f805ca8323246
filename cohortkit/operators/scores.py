"""S operators: quantile scores, RFM codes, ordered segment rules, ABC classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.core import add_scalars
from cohortkit.operators.ordering import exact_quantiles, prefix_sums
from cohortkit.operators.selection import quantiles, rank_cuts
from cohortkit.session import cut

# Built-in RFM segment rules, priority order, full match, first wins.
SEGMENT_RULES = [
    ("[4-5][4-5][4-5]", "Champions"),
    ("[2-3][4-5][4-5]", "Loyal Customers"),
    ("[4-5][2-5][4-5]", "Potential Loyalists"),
    ("[4-5][2-5][1-3]", "Recent Customers"),
    ("[2-3][2-3][4-5]", "Occasional Customers"),
    ("[2-4][1-5][1-4]", "Potential Customers"),
    ("[2-3][4-5][2-3]", "Economic Loyalists"),
    ("[1][4-5][4-5]", "Risky Customers"),
    ("[1-2][1-3][4-5]", "Nearly Lost"),
    ("[1-2][4-5][1-3]", "Need Attention"),
    ("[3-4][1-3][1-3]", "Average Customers"),
    ("[1-3][1-3][1-3]", "Non Active"),
    ("[1-3][1-3][1-2]", "Sleeping"),
    ("[4-5][1][1-5]", "New Customers"),
    ("[1][1][1]", "Lost"),
]
DEFAULT_SEGMENT = "Other"

# The app's default rules, prefix match, last matching rule wins.
APP_RULES = [
    ("^[4-5][4-5][4-5]$", "Champions"),
    ("^[1-2][4-5][4-5]$", "Cant Lose Them"),
    ("^[3-5][1-3][4-5]$", "Big Spenders"),
    ("^[3-5][3-5][1-5]$", "Loyal Customers"),
    ("^[4-5][1-2][1-3]$", "New Customers"),
    ("^[1-3][1-2][1-5]$", "At Risk"),
    ("^[1-2][1-2][1-2]$", "Lost"),
]
APP_DEFAULT = "Other / Unassigned"

# The script's regex dictionary (replace; unmatched keeps the code).
SCRIPT_RULES = [
    ("[4-5][4-5][4-5]", "Champions"),
    ("[2-3][4-5][4-5]", "Loyal Customers"),
    ("[4-5][2-5][4-5]", "Potential Loyalists"),
    ("[4-5][2-5][1-3]", "Recent Customers"),
    ("[2-3][2-3][4-5]", "Ocasional Customers"),
    ("[2-4][1-5][1-4]", "Potential Customers"),
    ("[2-3][4-5][2-3]", "Economic Loyalists"),
    ("[1][4-5][4-5]", "Risky Customers"),
    ("[1-2][1-3][4-5]", "Nearly Lost"),
    ("[1-2][4-5][1-3]", "Need Attention"),
    ("[3-4][1-3][1-3]", "Average Customers"),
    ("[1-3][1-3][1-3]", "Non active"),
    ("[1-3][1-3][1-2]", "Sleeping"),
    ("[4-5][1][1-5]", "New Customers"),
    ("[1][1][1]", "Lost"),
]

# Cluster type names used when naming static LRFM clusters.
CLUSTER_TYPES = {
    "new_active": "CLIENTES NUEVOS ACTIVOS",
    "new_inactive": "CLIENTES NUEVOS INACTIVOS",
    "vip": "CLIENTES VIP/LEALES",
    "loyal": "CLIENTES LEALES",
    "at_risk": "CLIENTES EN RIESGO",
}


def qcut_edges(df: DataFrame, col: str, q: int = 5) -> DataFrame:
    """One row ``e0..e{q}``: min, the q-1 inner quantiles, max (pandas qcut edges)."""
    return exact_quantiles(df, col, [i / q for i in range(q + 1)], prefix="e")


def qcut_score(df: DataFrame, col: str, out: str, q: int = 5, descending: bool = False,
               on_ties: str = "raise", edges: DataFrame | None = None) -> DataFrame:
    """Quantile bin 1..q (right-closed bins, lowest edge included).

    ``descending`` gives labels q..1 (Recency).  Equal edges raise as
    ``pd.qcut`` does; ``on_ties="collapse"`` counts only distinct edges.
    """
    if edges is None:
        edges = qcut_edges(df, col, q)
    x = F.col(col)
    inner = [F.col(f"e{j}") for j in range(1, q)]
    if on_ties == "collapse":
        above = sum((F.when((x > inner[j - 1]) & (F.col(f"e{j}") > F.col(f"e{j - 1}")), 1)
                     .otherwise(0) for j in range(1, q)), F.lit(0))
    else:
        above = sum((F.when(x > e, 1).otherwise(0) for e in inner), F.lit(0))
    score = (F.lit(q) - above) if descending else (F.lit(1) + above)
    if on_ties == "raise":
        dup = F.lit(False)
        for j in range(1, q + 1):
            dup = dup | (F.col(f"e{j}") <= F.col(f"e{j - 1}"))
        score = F.when(dup, F.raise_error(F.lit(f"qcut: bin edges of {col} are not unique"))
                       ).otherwise(score)
    out_df = add_scalars(df, edges).withColumn(out, score.cast("int"))
    return out_df.drop(*[f"e{j}" for j in range(q + 1)])


def rank_qcut_score(df: DataFrame, col: str, out: str, q: int = 5,
                    tie: str = "customer_id") -> DataFrame:
    """Quantile bin of ``rank(method='first')`` (ties in ``tie`` order).

    Ranks are 1..n, so the edges are 1 + (n-1)j/q and the bin is
    max(1, ceil(q(rank-1)/(n-1))): bin b ends at the row with floor(b(n-1)/q)
    rows before it.  These q - 1 rows are found by narrowing, and bins are
    comparisons with them: the table is neither sorted nor exchanged.
    ``tie`` is compared as text.
    """
    cuts = rank_cuts(df, col, tie, lambda n: [b * (n - 1) // q for b in range(1, q)])
    inf = float("inf")
    x = F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(inf)), F.lit(-inf))
    above = sum((F.when((x > F.lit(v)) | ((x == F.lit(v)) & (F.col(tie).cast("string") > F.lit(t))), 1).otherwise(0) for v, t in cuts), F.lit(0))
    return df.withColumn(out, (F.lit(1) + above).cast("int"))


def rfm_code(df: DataFrame, out: str = "RFM_Score") -> DataFrame:
    """S3."""
    return df.withColumn(out, F.concat(F.col("Recency_score").cast("string"),
                                       F.col("Frequency_score").cast("string"),
                                       F.col("Monetary_score").cast("string")))


def rule_expr(code: Column, rules: list, mode: str = "first", match: str = "full",
              default=DEFAULT_SEGMENT) -> Column:
    """An ordered regex rule list as one ``when`` chain (no UDF).

    mode: ``first`` (first matching rule wins) or ``last`` (last one wins).
    match: ``full`` (whole code), ``prefix`` (re.match) or ``search``.
    default: a label, or ``None`` to keep the code itself.
    """
    wrap = {"full": "^(?:{})$", "prefix": "^(?:{})", "search": "{}"}[match]
    ordered = list(rules) if mode == "first" else list(reversed(rules))
    expr = None
    for pattern, name in ordered:
        cond = code.rlike(wrap.format(pattern))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    fallback = code if default is None else F.lit(default)
    return fallback if expr is None else expr.otherwise(fallback)


def assign_segment(df: DataFrame, rules=None, code: str = "RFM_Score", out: str = "segment",
                   mode: str = "first", match: str = "full", default=DEFAULT_SEGMENT) -> DataFrame:
    rules = SEGMENT_RULES if rules is None else rules
    return df.withColumn(out, rule_expr(F.col(code), rules, mode, match, default))


def custom_rules(segments: list[dict]) -> list:
    """caller's rules ``{pattern, name, enabled?}`` -> ordered enabled list."""
    return [(s["pattern"], s["name"]) for s in segments if s.get("enabled", True)]


def multi_qcut_edges(df: DataFrame, cols: list[str], q: int = 5) -> dict:
    """qcut edges of several columns, found together by narrowing; returns {column: one-row edges DataFrame}."""
    edges = quantiles(df, cols, [i / q for i in range(q + 1)])
    kinds = ", ".join(f"e{j} double" for j in range(q + 1))
    return {c: df.sparkSession.createDataFrame([tuple(edges[c])], kinds) for c in cols}


def rfm_scores(rfm_df: DataFrame, q: int = 5, on_ties: str = "raise") -> DataFrame:
    """Recency (reversed) and Monetary by S1, Frequency by S2, code by S3."""
    rfm_df = rfm_df.transform(cut)  # read by each score; small rows, one per customer
    edges = multi_qcut_edges(rfm_df, ["Recency", "Monetary"], q)
    out = qcut_score(rfm_df, "Recency", "Recency_score", q, descending=True, on_ties=on_ties,
                     edges=edges["Recency"])
    out = qcut_score(out, "Monetary", "Monetary_score", q, on_ties=on_ties, edges=edges["Monetary"])
    out = rank_qcut_score(out, "Frequency", "Frequency_score", q)
    return rfm_code(out)


def rfm_quintile_segments(rfm_df: DataFrame, rules=None, n_quantiles: int = 5) -> DataFrame:
    """A3 output -> scores -> code -> first-match segment."""
    scored = rfm_scores(rfm_df, n_quantiles)
    return assign_segment(scored, rules).select(
        "customer_id", "Recency", "Frequency", "Monetary", "Recency_score",
        "Frequency_score", "Monetary_score", "RFM_Score", "segment")


def abc(orders: DataFrame, a: float = 0.80, b: float = 0.95, keep_pos: bool = False) -> DataFrame:
    """Customers by revenue, descending; class by the *previous*
    cumulative share (< a -> A, < b -> B, else C).  Zero total -> all C.

    The running sum is a distributed prefix sum over (monetary desc,
    customer_id); no single-partition window.
    """
    rev = orders.groupBy("customer_id").agg(F.sum("order_total").alias("monetary")).transform(cut)
    cum = prefix_sums(rev, [F.desc("monetary"), F.asc("customer_id")],
                      {"_cum": F.col("monetary")}, pos_col="pos")
    total = rev.agg(F.sum("monetary").alias("_total"))
    j = add_scalars(cum, total)
    zero = F.col("_total") == 0
    pct = F.when(zero, F.lit(0.0)).otherwise(F.col("_cum") / F.col("_total"))
    prev = F.when(zero, F.lit(0.0)).otherwise((F.col("_cum") - F.col("monetary")) / F.col("_total"))
    seg = (F.when(zero, "C").when(prev < a, "A").when(prev < b, "B").otherwise("C"))
    cols = ["customer_id", "monetary", pct.alias("cumulative_pct"), seg.alias("segment")]
    if keep_pos:
        cols.append("pos")
    return j.select(*cols)


def rename_segments(df: DataFrame, renames: dict, col: str = "segment") -> DataFrame:
    """Old label -> new label; unknown labels kept."""
    if not renames:
        return df
    m = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return df.withColumn(col, F.coalesce(m[F.col(col)], F.col(col)))


def cluster_type(profile: DataFrame, population: DataFrame, l: str = "L", r: str = "R",
                 m: str = "M") -> DataFrame:
    """Name clusters by comparing mean L, R', M with population medians."""
    pop = population.select(F.col(l).alias("_l"), F.col(r).alias("_r"), F.col(m).alias("_m"))
    q = quantiles(pop, ["_l", "_r", "_m"], [0.5])
    med = pop.sparkSession.createDataFrame([(q["_l"][0], q["_r"][0], q["_m"][0])], "ml0 double, mr0 double, mm0 double")
    t = (F.when(F.col(l) < F.col("ml0"),
                F.when(F.col(r) < F.col("mr0"), CLUSTER_TYPES["new_active"])
                .otherwise(CLUSTER_TYPES["new_inactive"]))
         .otherwise(F.when(F.col(r) < F.col("mr0"),
                           F.when(F.col(m) > F.col("mm0"), CLUSTER_TYPES["vip"])
                           .otherwise(CLUSTER_TYPES["loyal"]))
                    .otherwise(CLUSTER_TYPES["at_risk"])))
    return add_scalars(profile, med).withColumn("cluster_type", t).drop("ml0", "mr0", "mm0")


def quantile_scores(df: DataFrame, cols: list[str], q: int = 5, on_ties: str = "collapse") -> DataFrame:
    """S1 score ``{c}_score`` for each metric (all edges from one job)."""
    df = df.transform(cut)
    edges = multi_qcut_edges(df, cols, q)
    for c in cols:
        df = qcut_score(df, c, f"{c}_score", q, on_ties=on_ties, edges=edges[c])
    return df

