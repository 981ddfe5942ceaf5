"""Classification of cells and the whole pipeline."""

import uuid

from pyspark.sql import functions as F

from checks.fixtures import EXTERNAL, PARAM, PARAM_BAD, PX, PX_STORED, grid_over, raster, read, sql
from checks.raster import CELL_ID, PROFILE_CTE, PX_CTE, RATIO, SPACING_CTE
from checks.registry import query, r6, rounded
from zonalis.functions.scratch import scratch_dir
from zonalis.operators import algebra, lcz, sky
from zonalis.plans import pipeline
from zonalis.schemas import TILES as TILE_TABLE
from zonalis.sources import overlaps, tiles

PAR_CTE = f"par AS MATERIALIZED ({sql(PARAM)})"
BAD_CTE = f"par AS MATERIALIZED ({sql(PARAM_BAD)})"


def _number(x: float) -> str:
    return "'inf'::DOUBLE" if x == float("inf") else f"{x}::DOUBLE"


RANGE_CTE = "ranges(class_ord, lcz_class, param_ord, param, lo, hi) AS (VALUES " + ", ".join(
    f"({i}, '{code}', {j}, '{p}', {_number(low)}, {_number(high)})"
    for i, (code, _, ranges) in enumerate(lcz.CLASSES, 1)
    for j, (p, (low, high)) in enumerate(zip(lcz.PARAMETERS, ranges), 1)) + ")"
TEXT_CTE = "texts(class_ord, lcz_class, description) AS (VALUES " + ", ".join(
    f"({i}, '{code}', '{text}')" for i, (code, text, _) in enumerate(lcz.CLASSES, 1)) + ")"
STATUS = """CASE WHEN building_surface_fraction IS NULL THEN 'missing_building'
    WHEN impervious_surface_fraction IS NULL OR pervious_surface_fraction IS NULL THEN 'missing_fraction'
    WHEN abs(building_surface_fraction + impervious_surface_fraction + pervious_surface_fraction - 100) > {tolerance}
    THEN 'bad_sum' ELSE 'ok' END"""
AVAILABLE = " + ".join(f"CAST({p} IS NOT NULL AS INTEGER)" for p in lcz.PARAMETERS)
LONG = " UNION ALL ".join(
    f"SELECT cell_id, {i} AS param_ord, '{p}' AS param, {p} AS v, building_surface_fraction AS b FROM okpar"
    for i, p in enumerate(lcz.PARAMETERS, 1))


def score_cte(tolerance: str = "0.0", denominator: str = "v") -> str:
    """Match every known parameter with every class, then fold to cell and class."""
    return f"""{RANGE_CTE}, {TEXT_CTE},
okpar AS MATERIALIZED (SELECT *, {AVAILABLE} AS available_params FROM par WHERE {STATUS.format(tolerance=tolerance)} = 'ok'),
long AS MATERIALIZED ({LONG}),
pair AS MATERIALIZED (SELECT l.cell_id, l.param_ord, l.param, l.v, r.class_ord, r.lcz_class, r.lo, r.hi,
        l.v >= r.lo AND l.v <= r.hi AS matched, CASE WHEN isinf(r.hi) THEN r.lo ELSE (r.lo + r.hi) / 2 END AS t,
        CASE WHEN r.class_ord <= 10 THEN l.b > 0 ELSE l.b <= 0 END AS eligible
    FROM long l JOIN ranges r USING (param) WHERE l.v IS NOT NULL),
contrib AS MATERIALIZED (SELECT *, CASE WHEN matched THEN 0 WHEN t = 0 THEN 'inf'::DOUBLE ELSE ((v - t) / t) * ((v - t) / t) END AS contribution,
        NOT matched AND t <> 0 AS missed, ((v - t) / nullif({denominator}, 0)) * ((v - t) / nullif({denominator}, 0)) AS err FROM pair),
fold AS MATERIALIZED (SELECT cell_id, class_ord, lcz_class, bool_and(eligible) AS eligible,
        CAST(CASE WHEN bool_and(eligible) THEN count(*) FILTER (WHERE matched) ELSE 0 END AS INTEGER) AS perfect_matches,
        CASE WHEN bool_and(eligible) THEN CASE WHEN count(*) FILTER (WHERE missed) = 0 THEN 0
             ELSE sqrt(100 * avg(err) FILTER (WHERE missed)) / 100 END END AS score,
        CASE WHEN bool_and(eligible) THEN sqrt(avg(contribution) * 100) END AS mean_contribution,
        CAST(CASE WHEN bool_and(eligible) THEN count(*) ELSE 0 END AS INTEGER) AS n_contributions
    FROM contrib GROUP BY cell_id, class_ord, lcz_class),
ranked AS MATERIALIZED (SELECT *, max(perfect_matches) OVER (PARTITION BY cell_id) AS top,
        row_number() OVER (PARTITION BY cell_id ORDER BY perfect_matches DESC, round(score, 12) ASC NULLS LAST, class_ord) AS rn FROM fold)"""


SCORE_CTE = score_cte()


@query("lcz_ranges", f"""WITH {PAR_CTE}, {SCORE_CTE} SELECT r.lcz_class, r.class_ord, t.description, r.param, r.lo AS min_val,
    r.hi AS max_val, count(l.v) AS n_inside FROM ranges r JOIN texts t USING (class_ord)
    LEFT JOIN long l ON l.param = r.param AND l.v BETWEEN r.lo AND r.hi GROUP BY ALL""")
def lcz_ranges(spark, sf):
    """The range table, with how many cells of the input lie in each range."""
    ranges = lcz.lcz_ranges(spark)
    cells = read(spark, sf, PARAM)
    counts = cells.agg(*[
        F.count_if(F.col(r.param).between(r.min_val, r.max_val)).alias(f"{r.lcz_class}|{r.param}") for r in ranges.collect()])
    long = counts.unpivot([], counts.columns, "k", "n_inside")
    return ranges.withColumn("k", F.concat_ws("|", "lcz_class", "param")).join(long, "k").drop("k")


@query("lcz_input_status", f"WITH {BAD_CTE} SELECT cell_id, {STATUS.format(tolerance='0.0')} AS lcz_status FROM par")
def lcz_input_status(spark, sf):
    return lcz.lcz_input_status(read(spark, sf, PARAM_BAD)).select("cell_id", "lcz_status")


@query("lcz_available_params", f"WITH {BAD_CTE} SELECT cell_id, {AVAILABLE} AS available_params FROM par")
def lcz_available_params(spark, sf):
    return read(spark, sf, PARAM_BAD).select("cell_id", lcz.available_params().alias("available_params"))


@query("lcz_eligible", f"WITH {PAR_CTE}, {SCORE_CTE} SELECT cell_id, class_ord, lcz_class FROM fold WHERE eligible")
def lcz_eligible(spark, sf):
    return lcz.lcz_eligible(read(spark, sf, PARAM))


@query("lcz_matches", f"""WITH {PAR_CTE}, {SCORE_CTE} SELECT cell_id, lcz_class, param, round(v, 6) AS value, lo AS min_val,
    hi AS max_val FROM contrib WHERE eligible AND matched""")
def lcz_matches(spark, sf):
    return rounded(lcz.lcz_matches(read(spark, sf, PARAM)))


@query("lcz_contributions", f"""WITH {PAR_CTE}, {SCORE_CTE} SELECT cell_id, class_ord, lcz_class, param_ord, param,
    round(v, 6) AS value, lo AS min_val, hi AS max_val, matched, round(contribution, 6) AS contribution FROM contrib WHERE eligible""")
def lcz_contributions(spark, sf):
    return rounded(lcz.lcz_contributions(read(spark, sf, PARAM)))


SCORES_SQL = """SELECT f.cell_id, class_ord, lcz_class, available_params, perfect_matches, round(score, 6) AS score,
    round(mean_contribution, 6) AS mean_contribution FROM fold f JOIN okpar USING (cell_id) WHERE eligible"""


@query("lcz_scores", f"WITH {PAR_CTE}, {SCORE_CTE} {SCORES_SQL}")
def lcz_scores(spark, sf):
    return rounded(lcz.lcz_scores(read(spark, sf, PARAM)))


@query("lcz_scores_by_target", f"WITH {PAR_CTE}, {score_cte(denominator='t')} {SCORES_SQL}")
def lcz_scores_by_target(spark, sf):
    return rounded(lcz.lcz_scores(read(spark, sf, PARAM), denominator="target"))


@query("lcz_all_results", f"""WITH {PAR_CTE}, {SCORE_CTE}, listed AS (
    SELECT cell_id, class_ord, string_agg(param || '=' || CASE WHEN isinf(contribution) THEN 'inf'
        ELSE CAST(CAST(round(contribution * 1000000) AS BIGINT) AS VARCHAR) END, ',' ORDER BY param) AS contributions
    FROM contrib WHERE eligible GROUP BY ALL)
    SELECT f.cell_id, class_ord, lcz_class, available_params, eligible, perfect_matches, round(score, 6) AS score, n_contributions,
        coalesce(contributions, '') AS contributions
    FROM fold f JOIN okpar USING (cell_id) LEFT JOIN listed USING (cell_id, class_ord)""")
def lcz_all_results(spark, sf):
    """Every class of every cell, with each parameter's contribution in millionths."""
    out = lcz.lcz_all_results(read(spark, sf, PARAM))
    million = "IF(e.value = double('inf'), 'inf', string(bigint(round(e.value * 1000000))))"
    text = F.expr(f"array_join(array_sort(transform(map_entries(error_contributions), e -> concat(e.key, '=', {million}))), ',')")
    return rounded(out.withColumns({"n_contributions": F.size("error_contributions"), "contributions": text}).drop("error_contributions"))


CLASSIFY_SQL = """SELECT p.cell_id, {status} AS lcz_status, {available} AS available_params, r.lcz_class,
    round(r.score, 6) AS lcz_score, r.perfect_matches FROM par p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (cell_id)"""


@query("lcz_classify", f"WITH {BAD_CTE}, {SCORE_CTE} {CLASSIFY_SQL.format(status=STATUS.format(tolerance='0.0'), available=AVAILABLE)}")
def lcz_classify(spark, sf):
    out = lcz.lcz_classify(read(spark, sf, PARAM_BAD))
    return rounded(out.select("cell_id", "lcz_status", "available_params", "lcz_class", "lcz_score", "perfect_matches"))


RANK_CTE = "listed AS (SELECT *, CAST(rn AS INTEGER) AS rank FROM ranked WHERE perfect_matches = top AND score IS NOT NULL)"


@query("lcz_ranked", f"""WITH {PAR_CTE}, {SCORE_CTE}, {RANK_CTE} SELECT cell_id, rank, lcz_class, round(score, 6) AS score,
    perfect_matches, available_params FROM listed JOIN okpar USING (cell_id)""")
def lcz_ranked(spark, sf):
    return rounded(lcz.lcz_ranked(read(spark, sf, PARAM)))


@query("lcz_explain", f"""WITH {PAR_CTE}, {SCORE_CTE}, {RANK_CTE} SELECT l.cell_id, l.rank, l.lcz_class, c.param_ord, c.param,
    CASE WHEN c.matched THEN 'perfect match' WHEN isinf(c.hi) THEN '>' || regexp_replace(CAST(c.lo AS VARCHAR), '\\.0$', '')
         ELSE '(' || regexp_replace(CAST(c.lo AS VARCHAR), '\\.0$', '') || ', ' || regexp_replace(CAST(c.hi AS VARCHAR), '\\.0$', '') || ')'
    END AS explanation, round(c.v, 6) AS value FROM listed l JOIN contrib c USING (cell_id, lcz_class)""")
def lcz_explain(spark, sf):
    return rounded(lcz.lcz_explain(read(spark, sf, PARAM)))


@query("lcz_describe", f"""WITH {BAD_CTE}, {SCORE_CTE} SELECT p.cell_id, r.lcz_class, coalesce(t.description, 'Class not found') AS description
    FROM par p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (cell_id) LEFT JOIN texts t ON t.lcz_class = r.lcz_class""")
def lcz_describe(spark, sf):
    out = lcz.lcz_describe(lcz.lcz_classify(read(spark, sf, PARAM_BAD)))
    return out.select("cell_id", "lcz_class", "description")


@query("attach_parameters", f"""WITH {PAR_CTE}, ext AS ({sql(EXTERNAL)}) SELECT p.cell_id,
    round(p.aspect_ratio, 6) AS aspect_ratio, round(e.sky_view_factor, 6) AS sky_view_factor,
    round(e.terrain_roughness, 6) AS terrain_roughness FROM par p LEFT JOIN ext e USING (cell_id)""")
def attach_parameters(spark, sf):
    cells = read(spark, sf, PARAM).select("cell_id", "aspect_ratio")
    return rounded(lcz.attach_parameters(cells, read(spark, sf, EXTERNAL)))


GRID_PAR_CTE = f"""{PROFILE_CTE}, {SPACING_CTE}, ext AS ({sql(EXTERNAL)}),
par AS MATERIALIZED (SELECT p.cell_id, e.sky_view_factor, {RATIO} AS aspect_ratio,
    perc_buildings AS building_surface_fraction, perc_impervious AS impervious_surface_fraction,
    perc_pervious AS pervious_surface_fraction, dsm_median - dtm_median AS height_roughness, e.terrain_roughness,
    CAST(NULL AS DOUBLE) AS surface_admittance, albedo_majority / 10000 AS surface_albedo, CAST(NULL AS DOUBLE) AS anthropogenic_heat
    FROM profile p LEFT JOIN spacing USING (cell_id) LEFT JOIN ext e USING (cell_id))"""


GRID_SQL = f"""WITH px AS MATERIALIZED ({sql(PX_STORED)}), {GRID_PAR_CTE}, {score_cte('1e-6')}
    SELECT p.cell_id, {STATUS.format(tolerance='1e-6')} AS lcz_status, {AVAILABLE} AS available_params, r.lcz_class,
           round(r.score, 6) AS lcz_score, r.perfect_matches, coalesce(t.description, 'Class not found') AS description,
           round(p.aspect_ratio, 9) AS aspect_ratio, round(p.height_roughness, 6) + 0.0 AS height_roughness
    FROM par p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (cell_id) LEFT JOIN texts t ON t.lcz_class = r.lcz_class"""


def _zones(spark, sf, **how):
    px, geo = raster(spark, sf, PX_STORED)
    return _shown(pipeline.lcz_grid(px, geo, grid_over(geo), read(spark, sf, EXTERNAL), **how))


def _shown(out):
    return out.select(
        "cell_id", "lcz_status", "available_params", "lcz_class", r6("lcz_score").alias("lcz_score"), "perfect_matches",
        "description", r6("aspect_ratio", 9).alias("aspect_ratio"), r6("height_roughness").alias("height_roughness"))


@query("lcz_grid", GRID_SQL)
def lcz_grid(spark, sf):
    return _zones(spark, sf)


@query("lcz_grid_blocks", GRID_SQL)
def lcz_grid_blocks(spark, sf):
    """The same over seven block columns."""
    return _zones(spark, sf, block=16)


@query("tiles_to_zones", GRID_SQL)
def tiles_to_zones(spark, sf):
    """From a stored table of overlapping tiles, by mosaic and alignment, to classified cells."""
    px, geo = raster(spark, sf, PX)
    names = ("dsm", "mask", "class", "albedo")
    long = px.selectExpr("row_idx", "col_idx", "1 AS band", f"stack({len(names)}, " + ", ".join(
        f"'{n}', CAST({n} AS DOUBLE)" for n in names) + ") AS (layer, value)")
    path = f"{scratch_dir(spark)}/tiles-{uuid.uuid4().hex}"
    stored = tiles.pixels_to_tiles(long, 16).withColumn("priority", F.lit(1))
    # Older tiles of another size lie below them, with other values.
    older = tiles.pixels_to_tiles(long.where("layer <> 'albedo'").withColumn("value", F.col("value") + 1), 24).withColumn("tile_id", -1 - F.col("tile_id"))
    tiles.write_tiles(stored.unionByName(older).select(*spark.createDataFrame([], TILE_TABLE).columns), path)
    pixels = overlaps.mosaic_tiles(tiles.read_tiles(spark, path, names), block=32)
    aligned = algebra.align_layers(pixels, names, how="outer").where("dsm IS NOT NULL")
    inside = aligned.where((F.col("row_idx") < geo.n_rows) & (F.col("col_idx") < geo.n_cols))
    return _shown(pipeline.lcz_grid(inside, geo, grid_over(geo), read(spark, sf, EXTERNAL)))


def _sight(same, step, length):
    """Rise per metre from a pixel to every other one on a line through it, and the way to look."""
    return f"""SELECT a.row_idx, a.col_idx, '{step}' || sign(b.{step} - a.{step}) || '{same}' AS way,
        (b.dsm - a.dsm) / (abs(b.{step} - a.{step}) * 0.5::DOUBLE * {length}) AS rise
        FROM px a JOIN px b ON {same.format(a='a', b='b')} AND b.{step} <> a.{step}"""


SIGHT_CTE = "sight AS (" + " UNION ALL ".join((
    _sight("b.row_idx = a.row_idx", "col_idx", "1"), _sight("b.col_idx = a.col_idx", "row_idx", "1"),
    _sight("b.row_idx - b.col_idx = a.row_idx - a.col_idx", "row_idx", "sqrt(2)"),
    _sight("b.row_idx + b.col_idx = a.row_idx + a.col_idx", "row_idx", "sqrt(2)"))) + """),
steepest AS (SELECT row_idx, col_idx, way, greatest(max(rise), 0) AS rise FROM sight GROUP BY ALL),
sky AS MATERIALIZED (SELECT row_idx, col_idx, (sum(1 / (1 + rise * rise)) + 8 - count(*)) / 8 AS sky_view FROM steepest GROUP BY ALL)"""


@query("sky_view", f"WITH {PX_CTE}, {SIGHT_CTE} SELECT row_idx, col_idx, round(sky_view, 9) AS sky_view FROM sky")
def sky_view(spark, sf):
    """Seven block columns, so that most horizons lie in another block."""
    px, geo = raster(spark, sf, PX)
    return rounded(sky.sky_view(px, geo, block=16), 9)


@query("lcz_grid_sky", GRID_SQL.replace(f"ext AS ({sql(EXTERNAL)})", f"""{SIGHT_CTE}, ext AS (
    SELECT {CELL_ID} AS cell_id, avg(sky_view) AS sky_view_factor, CAST(NULL AS DOUBLE) AS terrain_roughness FROM sky GROUP BY 1)"""))
def lcz_grid_sky(spark, sf):
    """Cells classified with the sky view of their own surface model."""
    px, geo = raster(spark, sf, PX_STORED)
    spec = grid_over(geo)
    return _shown(pipeline.lcz_grid(px, geo, spec, sky.sky_view_cells(px, geo, spec, block=64)))
