"""Quality rules: text statistics and a robust multivariate outlier test per language and source.

Only DataFrame functions, statistics and matrices included: a minimum covariance determinant estimate
needs counts, means and covariances per group, which are aggregates, and a 5 x 5 triangular inverse,
which is arithmetic on columns.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.functions.scratch import materialize

#: Fixed value: what separates words.
GAP = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
P = 5
X = [f"x{i}" for i in range(P)]
#: Smallest spread taken for each transformed statistic, so that a constant one (no symbols at all)
#: does not make every other value infinitely far.
FLOORS = (0.5, 0.25, 0.08, 0.15, 0.15)
BUCKETS = 64
BROADCAST_ROWS = 50_000


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` and the counts of every whole text, in one pass without a shuffle."""
    words = F.array_remove(F.split("_text", f"{GAP}+", -1), "")
    lines = F.filter(F.split("_text", "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    start = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        *keep, words.alias("_words"), lines.alias("_lines"),
        F.char_length(F.regexp_replace("_text", f"{GAP}+", "")).alias("_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).alias("_symbols"),
    )
    grams = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
    )
    # Sorted by hash, equal windows are neighbours; the positions of those that have one are kept.
    with_grams = start.withColumn("_grams", F.when(F.size("_words") >= 3, F.sort_array(grams)))
    again = F.sort_array(F.filter(F.transform(
        "_grams",
        lambda g, k: F.when((g["h"] == F.get("_grams", k - 1)["h"]) | (g["h"] == F.get("_grams", k + 1)["h"]), g["i"]),
    ), lambda i: i.isNotNull()))
    with_again = with_grams.withColumn("_again", again)
    covered = F.aggregate(
        F.transform("_again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_again", k + 1) - i, F.lit(3)))),
        F.lit(0), lambda a, b: a + b,
    )
    big = lambda c: c.cast("bigint")
    return with_again.select(
        *keep,
        big(F.size("_words")).alias("n_words"), big(F.col("_chars")).alias("word_chars"),
        big(F.col("_symbols")).alias("n_symbols"),
        big(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        big(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        big(F.size("_lines")).alias("n_lines"),
    )


def _transformed() -> list[Column]:
    """Statistics on scales where clean text is roughly symmetric; shares as square roots."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(n.cast("double")), F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _quantile(df: DataFrame, by: list[str], bucket: str, share: float, name: str) -> DataFrame:
    """The bucket that holds the given share of each group's rows.

    Rows are counted per bucket before any shuffle, so a group of any size is a few thousand counts.
    """
    counts = df.groupBy(*by, bucket).count()
    order = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return (
        counts.withColumn("_seen", F.sum("count").over(order)).withColumn("_all", F.sum("count").over(whole))
        .where(F.col("_seen") >= F.ceil(F.lit(share) * F.col("_all")))
        .groupBy(*by).agg(F.min(bucket).alias(name))
    )


def _attach(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Join written per-group figures; broadcast while they are few, else a join by key."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, by)


def _log_bucket(d: Column) -> Column:
    return F.floor(F.log(d + 1e-6) * BUCKETS).cast("int")


def _distance() -> Column:
    """Squared length of W (x - m), W the lower triangular inverse Cholesky factor."""
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"w{i}{j}") * (F.col(X[j]) - F.col(f"m{j}"))
        total = total + part * part
    return total


def _shape(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: mean, inverse Cholesky factor of the floored covariance, log determinant, count."""
    aggs = [F.count(F.lit(1)).alias("n_subset")]
    for i in range(P):
        aggs.append(F.avg(X[i]).alias(f"m{i}"))
        for j in range(i + 1):
            aggs.append(F.coalesce(F.nanvl(F.covar_samp(X[i], X[j]), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}{j}"))
    df = rows.groupBy(*by).agg(*aggs)
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                # The floor keeps the pivot positive where a group is constant or short of rows.
                df = df.withColumn(f"l{i}{i}", F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOORS[i] ** 2))
            else:
                df = df.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    for i in range(P):
        df = df.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(i):
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            df = df.withColumn(f"w{i}{j}", -rest / F.col(f"l{i}{i}"))
    det = F.lit(0.0)
    for i in range(P):
        det = det + F.log(F.col(f"l{i}{i}")) * 2
    return df.select(
        *by, "n_subset", *[f"m{i}" for i in range(P)],
        *[f"w{i}{j}" for i in range(P) for j in range(i + 1)], det.alias("log_det"),
    )


def chi2_quantile(p: float, k: int = P) -> float:
    """Wilson and Hilferty's approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def mcd(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """Minimum covariance determinant per ``key`` of ``rows`` (key, x0..x4).

    Two deterministic starts per key, the rows nearest to the medians by sum and by largest of the
    scaled deviations, are each refined by concentration steps: take the ``share`` of rows with the
    smallest distances, estimate anew. The start with the smaller determinant wins. Every step is
    two aggregates that combine before their shuffle, and writes one row of figures per key.
    """
    by = ["key", "start"]
    long = rows.select("key", F.posexplode(F.array(*X)).alias("i", "x"))
    place = lambda c: F.floor(c * BUCKETS).cast("int")
    middle = materialize(_quantile(long.withColumn("b", place(F.col("x"))), ["key", "i"], "b", 0.5, "mid"))
    off = _attach(long, middle, ["key", "i"]).withColumn("b", place(F.abs(F.col("x") - F.col("mid") / BUCKETS)))
    spread = materialize(_quantile(off, ["key", "i"], "b", 0.5, "dev").join(middle, ["key", "i"]))
    centre = materialize(spread.groupBy("key").pivot("i", list(range(P))).agg(
        F.first("mid").alias("mid"), F.first("dev").alias("dev")
    ))
    z = [
        F.abs(F.col(X[i]) - F.col(f"{i}_mid") / BUCKETS) / (F.col(f"{i}_dev") / BUCKETS * 1.4826 + FLOORS[i])
        for i in range(P)
    ]
    squares = F.lit(0.0)
    for c in z:
        squares = squares + c * c
    near = _attach(rows, centre, ["key"]).select(
        "key", *X, F.posexplode(F.array(squares, F.greatest(*z))).alias("start", "d")
    ).withColumn("b", _log_bucket(F.col("d")))
    figures = None
    for _ in range(steps + 1):
        limit = materialize(_quantile(near, by, "b", share, "limit"))
        figures = materialize(_shape(_attach(near, limit, by).where("b <= limit"), by))
        near = _attach(rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), figures, by).select(
            *by, *X, _log_bucket(_distance()).alias("b")
        )
    best = figures.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("_best")).select("key", "_best.start")
    middle_distance = _quantile(near, by, "b", 0.5, "mid")
    totals = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return materialize(
        figures.join(best, by).join(middle_distance, by).join(totals, by)
        .withColumn("scale", F.greatest(F.lit(1.0), F.exp(F.col("mid") / BUCKETS) / chi2_quantile(0.5)))
        .drop("start", "mid", "n_subset")
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    tail: float = 1e-8, min_rows: int = 100,
) -> DataFrame:
    """One row per row of ``docs``: counts, the base rules' verdict, the distance and ``kept``.

    A document that passes the base rules is kept if its squared Mahalanobis distance, from the MCD
    estimate of its language and source, is within the chi-squared quantile at 1 - ``tail``. Groups
    of fewer than ``min_rows`` passing documents are judged by their language, then by all documents;
    with fewer than ``min_rows`` in all, the base rules alone decide.

    NULL text counts as empty (no words: base rules fail). NULL language or source is a group of its
    own. Repeated rows each count. Other columns are ignored. An empty table gives no row.
    """
    measured = text_statistics(
        docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_t"), F.col(lang).cast("string").alias("_lang"),
                    F.col(source).cast("string").alias("_source")),
        "_t", ["_doc", "_lang", "_source"],
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    # The texts are read once; all further passes are over these few numbers per document.
    table = materialize(measured.select(
        "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.array(F.concat_ws("\t", name("_lang"), name("_source")), name("_lang"), F.lit("")).alias("_keys"),
        *[x.alias(c) for x, c in zip(_transformed(), X)],
        F.monotonically_increasing_id().alias("_row"),
    ))
    passing = table.where(~F.col("base_failed"))
    figures = mcd(passing.select(F.explode("_keys").alias("key"), *X))
    levels = passing.select("_row", *X, F.posexplode("_keys").alias("level", "key"))
    scored = _attach(levels, figures, ["key"]).where(F.col("n") >= min_rows).select(
        "_row", F.struct("level", (_distance() / F.col("scale")).alias("d")).alias("s")
    ).groupBy("_row").agg(F.min("s").alias("s")).select("_row", F.col("s.d").alias("distance"))
    cutoff = chi2_quantile(1 - tail)
    return table.join(scored, "_row", "left").select(
        F.col("_doc").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
        "distance",
    )
