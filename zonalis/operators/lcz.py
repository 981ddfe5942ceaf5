"""Local climate zone of a cell from up to ten parameters (classes after Stewart and Oke 2012).

The 17 classes are a fixed table, so it enters the plan as one constant array. The best class of a
cell is the minimum of that array after scoring, found inside the cell's row without join or
shuffle. Long results repeat the row beside the 17 entries, after the cells have been spread over
the cluster.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.text import number_text
from zonalis.schemas import ensure_column, require_columns

PARAMETERS = (
    "sky_view_factor", "aspect_ratio", "building_surface_fraction", "impervious_surface_fraction",
    "pervious_surface_fraction", "height_roughness", "terrain_roughness", "surface_admittance",
    "surface_albedo", "anthropogenic_heat",
)

# Class code, description, then min..max of each parameter in the order above.
CLASS_TABLE = """
1  | Compact highrise    | 0.2..0.4 | 2..inf     | 40..60 | 40..60  | 0..10   | 25..inf | 8..8 | 1500..1800 | 0.1..0.2   | 50..300
2  | Compact midrise     | 0.3..0.6 | 0.75..2    | 40..70 | 30..50  | 0..20   | 10..25  | 6..7 | 1500..2200 | 0.1..0.2   | 0..75
3  | Compact lowrise     | 0.2..0.6 | 0.75..1.5  | 40..70 | 20..50  | 0..30   | 3..10   | 6..6 | 1200..1800 | 0.1..0.2   | 0..75
4  | Open highrise       | 0.5..0.7 | 0.75..1.25 | 20..40 | 30..40  | 30..40  | 25..inf | 7..8 | 1400..1800 | 0.12..0.25 | 0..50
5  | Open midrise        | 0.5..0.8 | 0.3..0.75  | 20..40 | 30..50  | 20..40  | 10..25  | 5..6 | 1400..2000 | 0.12..0.25 | 0..25
6  | Open lowrise        | 0.6..0.9 | 0.3..0.75  | 20..40 | 20..50  | 30..60  | 3..10   | 5..6 | 1200..1800 | 0.12..0.25 | 0..25
7  | Lightweight lowrise | 0.2..0.5 | 1..2       | 60..90 | 0..20   | 0..30   | 2..4    | 4..5 | 800..1500  | 0.15..0.35 | 0..35
8  | Large lowrise       | 0.7..inf | 0.1..0.3   | 30..50 | 40..50  | 0..20   | 3..10   | 5..5 | 1200..1800 | 0.15..0.25 | 0..50
9  | Sparsely built      | 0.8..1   | 0.1..0.25  | 10..20 | 0..20   | 60..80  | 3..10   | 5..6 | 1000..1800 | 0.12..0.25 | 0..10
10 | Heavy industry      | 0.6..0.9 | 0.2..0.5   | 20..30 | 20..40  | 40..50  | 5..15   | 5..6 | 1000..2500 | 0.12..0.2  | 300..inf
A  | Dense trees         | 0..0.4   | 1..inf     | 0..10  | 0..10   | 90..100 | 3..30   | 8..8 | 1000..1800 | 0.12..0.2  | 0..0
B  | Scattered trees     | 0.5..0.8 | 0.25..0.75 | 0..10  | 0..10   | 90..100 | 3..15   | 5..6 | 1200..1800 | 0.15..0.25 | 0..0
C  | Bush, scrub         | 0.7..0.9 | 0.25..1    | 0..10  | 0..10   | 90..100 | 0..2    | 4..5 | 700..1500  | 0.15..0.3  | 0..0
D  | Low plants          | 0.9..1   | 0..0.1     | 0..10  | 0..10   | 90..100 | 0..1    | 3..4 | 1200..1600 | 0.15..0.25 | 0..0
E  | Bare rock or paved  | 0.9..1   | 0..0.1     | 0..10  | 90..100 | 0..10   | 0..0.25 | 1..2 | 1200..2500 | 0.15..0.3  | 0..0
F  | Bare soil or sand   | 0.9..1   | 0..0.1     | 0..10  | 0..10   | 90..100 | 0..0.25 | 1..2 | 600..1400  | 0.2..0.35  | 0..0
G  | Water               | 0.9..1   | 0..0.1     | 0..10  | 0..10   | 90..100 | 0..0.25 | 1..1 | 1500..1500 | 0.02..0.1  | 0..0
"""
UNKNOWN_CLASS = "Class not found"
BUILT_THRESHOLD = 0.0
WHOLE = 100.0


def _classes() -> list[tuple[str, str, list[tuple[float, float]]]]:
    rows = []
    for line in CLASS_TABLE.strip().splitlines():
        code, text, *ranges = (part.strip() for part in line.split("|"))
        rows.append((code, text, [tuple(float(x) for x in r.split("..")) for r in ranges]))
    return rows


CLASSES = _classes()
SUM_ORDER = ("building_surface_fraction", "impervious_surface_fraction", "pervious_surface_fraction")


def lcz_ranges(spark: SparkSession) -> DataFrame:
    """The class table in long form, 170 rows."""
    rows = [
        (code, i, text, name, low, high)
        for i, (code, text, ranges) in enumerate(CLASSES, 1)
        for name, (low, high) in zip(PARAMETERS, ranges)
    ]
    return spark.createDataFrame(
        rows, "lcz_class STRING, class_ord INT, description STRING, param STRING, min_val DOUBLE, max_val DOUBLE")


def _number(x: float) -> str:
    return "CAST('Infinity' AS DOUBLE)" if x == float("inf") else f"{x!r}D"


def _class_array() -> str:
    """The class table as one constant array of structs, in SQL."""
    entries = []
    for i, (code, _, ranges) in enumerate(CLASSES, 1):
        fields = [f"{i} AS class_ord, '{code}' AS lcz_class, {str(code.isdigit()).lower()} AS built"]
        for p, (low, high) in zip(PARAMETERS, ranges):
            target = low if high == float("inf") else (low + high) / 2
            fields.append(f"{_number(low)} AS {p}_low, {_number(high)} AS {p}_high, {_number(target)} AS {p}_target")
        entries.append(f"struct({', '.join(fields)})")
    return f"array({', '.join(entries)})"


# The SQL below compares a cell's parameters with a class entry ``c``. An unknown parameter is NaN
# there, which lies in no range.
ELIGIBLE = f"(building_surface_fraction > {BUILT_THRESHOLD}D) = {{c}}.built"


def _inside(c: str, p: str) -> str:
    return f"({p} >= {c}.{p}_low AND {p} <= {c}.{p}_high)"


def _contribution(c: str, p: str) -> str:
    """Squared error relative to the class target: 0 inside the range, infinite for a target of 0."""
    error = f"(({p} - {c}.{p}_target) / {c}.{p}_target)"
    return (f"CASE WHEN {_inside(c, p)} OR isnan({p}) THEN 0D WHEN {c}.{p}_target = 0D THEN {_number(float('inf'))} "
            f"ELSE {error} * {error} END")


#: The same for one gathered entry (value, min_val, max_val, target) with a known value.
_ENTRY_CONTRIBUTION = (
    f"CASE WHEN value >= min_val AND value <= max_val THEN 0D WHEN target = 0D THEN {_number(float('inf'))} "
    "ELSE ((value - target) / target) * ((value - target) / target) END")


def _tally(c: str, denominator: str) -> tuple[str, str]:
    """Counts and summed squared errors over the ten parameters of one class.

    The first packs three counts as decimal digits: parameters inside their range, 100 times those
    outside it, 10000 times those outside it whose error is defined. One sum instead of three keeps
    the generated loop within the size that the JVM compiles, which makes it about ten times faster.
    A parameter whose target is 0 counts for nothing when it is outside.
    """
    if denominator not in ("value", "target"):
        raise ValueError("denominator is 'value' or 'target'")
    counts, errors = [], []
    for p in PARAMETERS:
        target = f"{c}.{p}_target"
        base = p if denominator == "value" else target
        ignored = f"isnan({p}) OR {target} = 0D"
        error = f"(({p} - {target}) / {base})"
        counts.append(f"CASE WHEN {_inside(c, p)} THEN 1D WHEN {ignored} THEN 0D WHEN {base} = 0D THEN 100D ELSE 10100D END")
        errors.append(f"CASE WHEN {_inside(c, p)} OR {ignored} OR {base} = 0D THEN 0D ELSE {error} * {error} END")
    return f"CAST({' + '.join(counts)} AS INT)", " + ".join(errors)


def _matches(n: str) -> str:
    return f"{n} % 100"


def _score(n: str, total: str) -> str:
    """0 if no parameter is outside its range, NULL if none of those outside has a defined error."""
    return (f"CASE WHEN {n} div 100 % 100 = 0 THEN 0D "
            f"WHEN {n} div 10000 > 0 THEN sqrt({total} / ({n} div 10000) * 100) / 100 END")


def input_status(tolerance: float = 0.0) -> Column:
    """Whether a cell can be classified: the building share is known and the shares add up to 100."""
    building, impervious, pervious = (F.col(c) for c in SUM_ORDER)
    return (
        F.when(building.isNull(), "missing_building")
        .when(impervious.isNull() | pervious.isNull(), "missing_fraction")
        .when(F.abs(building + impervious + pervious - WHOLE) > tolerance, "bad_sum")
        .otherwise("ok")
    )


def available_params() -> Column:
    """How many of the ten parameters are known."""
    return F.expr(" + ".join(f"CAST({p} IS NOT NULL AS INT)" for p in PARAMETERS))


def _prepared(cells: DataFrame, tolerance: float) -> DataFrame:
    if "lcz_status" in cells.columns:
        return cells
    for p in PARAMETERS:
        cells = ensure_column(cells, p, "double")
    cells = cells.withColumns({p: F.col(p).cast("double") for p in PARAMETERS})
    return cells.withColumns({"lcz_status": input_status(tolerance), "available_params": available_params()})


def lcz_input_status(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Add ``lcz_status`` and ``available_params``; no row is dropped.

    The default tolerance asks for a sum of exactly 100, which computed percentages often miss by a
    rounding error.
    """
    require_columns(cells, "cell_id")
    return _prepared(cells, tolerance)


def _spread(cells: DataFrame) -> DataFrame:
    """Cells dealt over all tasks: a cell becomes up to 170 rows, and a small file is read by one task.

    A count of partitions is given because adaptive execution would merge the short rows again.
    """
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _by_class(cells: DataFrame, tolerance: float, *fields: str) -> DataFrame:
    """One row per valid cell and class, with the given SQL over the class entry ``_c``."""
    ok = _prepared(cells, tolerance).where("lcz_status = 'ok'")
    known = [f"coalesce({p}, CAST('NaN' AS DOUBLE)) AS {p}" for p in PARAMETERS]
    beside = _spread(ok.selectExpr("cell_id", "available_params", *known)).selectExpr("*", f"explode({_class_array()}) AS _c")
    return beside.selectExpr(
        "cell_id", "_c.class_ord", "_c.lcz_class", "available_params", f"{ELIGIBLE.format(c='_c')} AS eligible", *fields)


def lcz_eligible(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cell and class pairs that may be matched."""
    return _by_class(cells, tolerance).where("eligible").select("cell_id", "class_ord", "lcz_class")


def lcz_contributions(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per cell, eligible class and known parameter: inside the range or not, and the contribution."""
    # The ten entries only gather values; what is computed from them is written once, after the
    # explode, so that the generated method stays within the size that the JVM compiles.
    entries = ", ".join(
        f"struct({i} AS param_ord, '{p}' AS param, {p} AS value, _c.{p}_low AS min_val, _c.{p}_high AS max_val, _c.{p}_target AS target)"
        for i, p in enumerate(PARAMETERS, 1))
    rows = _by_class(cells, tolerance, f"explode(array({entries})) AS p").where("eligible AND NOT isnan(p.value)")
    return rows.select("cell_id", "class_ord", "lcz_class", "p.*").selectExpr(
        "cell_id", "class_ord", "lcz_class", "param_ord", "param", "value", "min_val", "max_val",
        "value >= min_val AND value <= max_val AS matched", f"{_ENTRY_CONTRIBUTION} AS contribution")


def lcz_matches(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The parameters of each cell that lie inside the range of an eligible class."""
    return lcz_contributions(cells, tolerance).where("matched").select(
        "cell_id", "lcz_class", "param", "value", "min_val", "max_val")


def _scored(cells: DataFrame, tolerance: float, denominator: str, *extra: str) -> DataFrame:
    """All 17 classes per cell with their matches and score; an ineligible one has neither.

    The score is the root mean square percentage error over the parameters outside their range; it
    is 0 if there are none and NULL if none of them has a defined error.
    """
    n, total = _tally("_c", denominator)
    rows = _by_class(cells, tolerance, f"{n} AS _n", f"{total} AS _sum", *extra)
    return rows.withColumns({
        "perfect_matches": F.expr(f"IF(eligible, {_matches('_n')}, 0)"),
        "score": F.expr(f"IF(eligible, {_score('_n', '_sum')}, NULL)"),
    }).drop("_n", "_sum")


def lcz_scores(cells: DataFrame, tolerance: float = 0.0, denominator: str = "value") -> DataFrame:
    """Matches, score and mean contribution of the eligible classes.

    ``denominator`` says whether an error is relative to the cell's ``value`` or the class ``target``.
    """
    entries = ", ".join(
        f"struct({p} AS value, _c.{p}_low AS min_val, _c.{p}_high AS max_val, _c.{p}_target AS target)" for p in PARAMETERS)
    scored = _scored(cells, tolerance, denominator, f"array({entries}) AS _p").where("eligible")
    # One lambda over ten entries instead of ten expressions, which the JVM would not compile.
    step = _ENTRY_CONTRIBUTION
    for field in ("value", "min_val", "max_val", "target"):
        step = re.sub(rf"\b{field}\b", f"x.{field}", step)
    total = f"aggregate(_p, 0D, (a, x) -> a + IF(isnan(x.value), 0D, {step}))"
    return scored.withColumn("mean_contribution", F.expr(f"sqrt({total} / CAST(available_params AS DOUBLE) * 100)")).drop("eligible", "_p")


def lcz_all_results(cells: DataFrame, tolerance: float = 0.0, denominator: str = "value") -> DataFrame:
    """All 17 classes per cell with the contribution of each known parameter as a map.

    An ineligible class has no score, no match and an empty map.
    """
    pairs = ", ".join(
        f"'{p}', IF({ELIGIBLE.format(c='_c')} AND NOT isnan({p}), {_contribution('_c', p)}, NULL)" for p in PARAMETERS)
    errors = f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS error_contributions"
    return _scored(cells, tolerance, denominator, errors)


def _with_contenders(cells: DataFrame, denominator: str, pick: str) -> DataFrame:
    """Add ``_b``, what the SQL function ``pick`` makes of a cell's contenders.

    The contenders are the eligible classes as structs that sort best first: most matches, lowest
    score, class order; unknown scores last. Scores are compared to 12 decimals, so that the order
    of summation cannot break a tie. An ineligible class never wins: an eligible one has a match or
    a defined error in the building share.
    """
    n, total = _tally("c", denominator)
    tallied = (f"transform(filter({_class_array()}, c -> {ELIGIBLE.format(c='c')}), "
               f"c -> struct({n} AS n, {total} AS total, c.class_ord AS o, c.lcz_class AS k))")
    score = _score("x.n", "x.total")
    ordered = (f"transform({tallied}, x -> struct(-({_matches('x.n')}) AS neg_matches, "
               f"coalesce(rint(({score}) * 1e12D), CAST('Infinity' AS DOUBLE)) AS rounded, "
               f"x.o AS class_ord, x.k AS lcz_class, {score} AS score))")
    # The comparison sees NaN for unknown parameters; the cell's own columns stay as they are.
    own = [f"{c} AS _own_{c}" if c in PARAMETERS else f"`{c}`" for c in cells.columns]
    known = [f"coalesce({p}, CAST('NaN' AS DOUBLE)) AS {p}" for p in PARAMETERS]
    back = [f"_own_{c} AS {c}" if c in PARAMETERS else f"`{c}`" for c in cells.columns]
    return cells.selectExpr(*own, *known).selectExpr(
        *back, f"IF(lcz_status = 'ok', {pick}({ordered}), NULL) AS _b")


def lcz_classify(cells: DataFrame, tolerance: float = 0.0, denominator: str = "value") -> DataFrame:
    """Add the class of each cell: most perfect matches, then the lowest score, then class order.

    Adds lcz_class, lcz_score and perfect_matches, NULL where ``lcz_status`` is not ``ok``. The
    classes are compared inside the cell's row: nothing is shuffled and every column is kept.
    """
    best = _with_contenders(_prepared(cells, tolerance), denominator, "array_min")
    return best.withColumns({
        "lcz_class": F.col("_b.lcz_class"), "lcz_score": F.col("_b.score"), "perfect_matches": -F.col("_b.neg_matches"),
    }).drop("_b")


def _ranking(cells: DataFrame, tolerance: float, denominator: str) -> DataFrame:
    """One row per cell and class that shares the cell's highest number of matches and has a score."""
    ok = _spread(_prepared(cells, tolerance).where("lcz_status = 'ok'"))
    ordered = _with_contenders(ok, denominator, "array_sort")
    top = "filter(_b, x -> x.neg_matches = _b[0].neg_matches AND x.score IS NOT NULL)"
    return ordered.selectExpr("*", f"posexplode({top}) AS (_pos, _r)").drop("_b").withColumn("rank", F.expr("_pos + 1"))


def lcz_ranked(cells: DataFrame, tolerance: float = 0.0, denominator: str = "value") -> DataFrame:
    """The classes that share a cell's highest number of matches and have a score, best first."""
    return _ranking(cells, tolerance, denominator).select(
        "cell_id", "rank", "_r.lcz_class", "_r.score", (-F.col("_r.neg_matches")).alias("perfect_matches"), "available_params")


def lcz_explain(cells: DataFrame, tolerance: float = 0.0, denominator: str = "value") -> DataFrame:
    """For each ranked class, one row per known parameter: a perfect match, or the range it missed."""
    ranked = _ranking(cells, tolerance, denominator).selectExpr(
        "cell_id", "rank", *PARAMETERS, f"element_at({_class_array()}, _r.class_ord) AS _c")
    entries = ", ".join(
        f"struct({i} AS param_ord, '{p}' AS param, {p} AS value, _c.{p}_low AS low, _c.{p}_high AS high)"
        for i, p in enumerate(PARAMETERS, 1))
    rows = ranked.selectExpr("cell_id", "rank", "_c.lcz_class", f"explode(array({entries})) AS p").where("p.value IS NOT NULL")
    low, high = number_text(F.col("p.low")), number_text(F.col("p.high"))
    wanted = F.when(F.col("p.high") == float("inf"), F.concat(F.lit(">"), low)).otherwise(
        F.concat(F.lit("("), low, F.lit(", "), high, F.lit(")")))
    return rows.select(
        "cell_id", "rank", "lcz_class", "p.param_ord", "p.param",
        F.when(F.col("p.value").between(F.col("p.low"), F.col("p.high")), "perfect match").otherwise(wanted).alias("explanation"),
        "p.value")


def describe(lcz_class: Column) -> Column:
    """Description of a class code, or a fixed text for an unknown one."""
    out = F.when(F.lit(False), F.lit(""))
    for code, text, _ in CLASSES:
        out = out.when(lcz_class == code, text)
    return out.otherwise(UNKNOWN_CLASS)


def lcz_describe(cells: DataFrame) -> DataFrame:
    """Add the description of ``lcz_class``."""
    return cells.withColumn("description", describe(F.col("lcz_class")))


def attach_parameters(cells: DataFrame, external: DataFrame) -> DataFrame:
    """Add parameters that come from outside (one row per cell_id); cells without them get NULL."""
    unknown = sorted(set(external.columns) - {"cell_id", *PARAMETERS})
    if unknown:
        raise ValueError(f"not classifier parameters: {', '.join(unknown)}")
    return cells.join(external, "cell_id", "left")
