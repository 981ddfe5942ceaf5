"""Secrets in text, judged by how many repositories and owners hold the same one.

Only DataFrame functions: the spans come from ``split`` and ``regexp_extract_all``, so the whole scan
stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize

#: The kinds of the base scan, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: The candidates that only their owners can tell from an identifier: long words of letters and digits.
KEY = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "key")
MIN_ASSIGNED = 8


def _spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Array of (start, rank, end, kind, value) of the matches, in characters, left to right.

    The pieces between the matches give the offsets, since no function returns positions.
    """
    regex = F.lit(pattern)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["piece"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"),
        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.char_length(x["piece"])).cast("bigint").alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (acc["at"] + F.char_length(x["piece"]) + F.char_length(x["hit"])).cast("bigint").alias("end"),
            F.lit(kind).alias("kind"),
            x["value"].alias("value"),
        )))).alias("out"),
    )
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")
    walk = F.aggregate(
        F.arrays_zip(
            F.split(text, pattern, -1).alias("piece"),
            F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, regex, F.lit(group)).alias("value"),
        ),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        step,
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secret_scan(
    docs: DataFrame, repo: str = "doc_id", owner: str = "source", text: str = "text",
    max_owners: int = 1, max_repos: int = 3,
) -> DataFrame:
    """One row per row of ``docs`` with its secrets.

    Columns: ``repo``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (base and
    added ones as kind:start:end), ``live`` and ``shared`` (the same form, parted by the verdict),
    ``n_live``, ``n_shared``. A value is live-looking if at most ``max_owners`` distinct owners and
    ``max_repos`` distinct repositories in the whole table hold it, and a shared example beyond
    that. Base spans stay whatever the verdict; a ``key`` candidate (20 or more characters with a
    letter and a digit, apart from base spans) is added only if it is live.

    NULL or empty text has no span. A NULL repository or owner counts as one of its own name, so
    missing owners never look like many. Repeated rows are scanned each, and count as one holder if
    they share repository and owner. Other columns are ignored. An empty table gives no row.
    """
    rows = docs.select(
        F.col(repo).alias("repo"), F.col(owner).cast("string").alias("owner"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    base = F.concat(
        F.filter(_spans(F.col("text"), ASSIGN, "assign", 2), lambda s: F.char_length(s["value"]) >= MIN_ASSIGNED),
        _spans(F.col("text"), ACCESS, "access"),
        _spans(F.col("text"), HEX, "hex"),
    )
    keys = F.filter(
        _spans(F.col("text"), KEY, "key"),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"),
    )
    found = rows.select("repo", "owner", F.sort_array(base).alias("base"), keys.alias("keys")).select(
        "repo", "owner", "base",
        F.filter("keys", lambda k: ~F.exists("base", lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"]))).alias("keys"),
    )
    # Written once: the regular expressions run a single time, and the row number holds from here on.
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))
    candidates = found.select(
        "row", F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("repo"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.explode(F.concat("base", "keys")).alias("span"),
    ).withColumn("hash", F.sha2("span.value", 256))
    held = candidates.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    spread = held.groupBy("hash").agg(
        F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners")
    )
    verdict = spread.select(
        "hash", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("is_live")
    )
    judged = candidates.select("row", "span", "hash").join(verdict, "hash").groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_live"), F.col("span")))).alias("live"),
        F.sort_array(F.collect_list(F.when(~F.col("is_live"), F.col("span")))).alias("shared"),
    )
    none = F.filter("base", lambda s: F.lit(False))
    scored = found.drop("keys").join(judged, "row", "left").select(
        "repo", "base",
        F.coalesce("live", none).alias("live"), F.coalesce("shared", none).alias("shared"),
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    added = F.filter("live", lambda s: s["kind"] == "key")
    return scored.select(
        F.col("repo").alias(repo),
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", added))).alias("spans"),
        _listed(F.col("live")).alias("live"), _listed(F.col("shared")).alias("shared"),
        F.size("live").cast("bigint").alias("n_live"), F.size("shared").cast("bigint").alias("n_shared"),
    )


def _sql() -> str:
    """The scan of ``documents`` by DuckDB, its patterns written for that engine."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": (f"""({word})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
        "access": (r"AKIA[A-Z0-9]+", 0), "hex": ("[0-9a-f]+", 0), "key": ("[A-Za-z0-9+/_=-]{20,}", 0),
    }
    keep = {"assign": "len(v) >= 8", "access": "len(v) >= 16", "hex": "len(v) >= 32",
            "key": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')"}
    parts = []
    for rank, (kind, (p, g)) in enumerate(patterns.items()):
        q = "'" + p.replace("'", "''") + "'"
        parts.append(f"""
        SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, v, b, b + h AS e FROM (
          SELECT doc_id, source, vs[i] AS v, len(hs[i]) AS h,
                 list_sum(list_transform(ps[1:i], lambda x: len(x)))
                 + COALESCE(list_sum(list_transform(hs[1:i-1], lambda x: len(x))), 0) AS b
          FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM (
            SELECT doc_id, source, regexp_split_to_array(text, {q}) AS ps,
                   regexp_extract_all(text, {q}, 0) AS hs, regexp_extract_all(text, {q}, {g}) AS vs
            FROM documents WHERE text IS NOT NULL))) WHERE {keep[kind]}""")
    return f"""
    WITH raw AS ({' UNION ALL '.join(parts)}),
    spans AS (SELECT * FROM raw k WHERE kind <> 'key' OR NOT EXISTS (
        SELECT 1 FROM raw b WHERE b.kind <> 'key' AND b.doc_id = k.doc_id AND b.b < k.e AND k.b < b.e)),
    held AS (SELECT v, count(DISTINCT doc_id) <= 3 AND count(DISTINCT COALESCE(source, '')) <= 1 AS is_live
             FROM spans GROUP BY v),
    judged AS (SELECT s.*, is_live FROM spans s JOIN held USING (v))
    SELECT d.doc_id,
      count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex,
      sha256(COALESCE(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank)
             FILTER (kind <> 'key'), '')) AS base_sha256,
      COALESCE(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank)
             FILTER (kind <> 'key' OR is_live), '') AS spans,
      count(*) FILTER (is_live) AS n_live, count(*) FILTER (NOT is_live) AS n_shared
    FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
