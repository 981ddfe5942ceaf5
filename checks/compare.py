"""Run queries against their oracle: ``python -m checks.compare [sf_dir] [name ...]``."""

import math
import sys
import time

import duckdb


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v) if not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, names=None):
    from checks import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    results = {}
    for name in names or QUERIES:
        start = time.time()
        df = QUERIES[name](spark, sf_dir)
        got = [tuple(r) for r in df.collect()]
        took = time.time() - start
        if name not in ORACLES:
            results[name] = (True, len(got), took, "rows only")
            continue
        cur = con.execute(ORACLES[name])
        want, cols = cur.fetchall(), [d[0] for d in cur.description]
        types = {d[0]: str(d[1]) for d in cur.description}
        if sorted(cols) != sorted(df.columns):
            results[name] = (False, len(got), took, f"columns {sorted(df.columns)} != {sorted(cols)}")
            continue
        a, b = canonical(got, df.columns), canonical(want, cols)
        note = ""
        if a != b:
            sa, sb = set(a), set(b)
            note = f"rows {len(a)} vs {len(b)}; spark only {sorted(sa - sb)[:3]}; oracle only {sorted(sb - sa)[:3]}"
        kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
                 "SMALLINT": "smallint", "NUMBER": None, "STRING": "string"}
        odd = [f"{c}: {t} vs {types[c]}" for c, t in df.dtypes if kinds.get(types[c], types[c]) not in (t, None)]
        results[name] = (a == b, len(got), took, note or ("types " + "; ".join(odd) if odd else ""))
    return results


if __name__ == "__main__":
    from tests.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    bad = 0
    for name in sys.argv[2:] or __import__("checks").QUERIES:
        try:
            ok, n, took, note = compare(spark, sf, [name])[name]
        except Exception as e:  # keep going, report at the end
            ok, n, took, note = False, -1, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} rows={n:<7d} {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
