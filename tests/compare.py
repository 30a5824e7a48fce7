"""Compare registered queries with their oracle SQL (development tool)."""
import sys, time
import duckdb
sys.path.insert(0, "/root/repo")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    a = norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    b = norm(cur.fetchall(), [d[0] for d in cur.description])
    if sorted(df.columns) != sorted(d[0] for d in cur.description):
        return False, len(a), len(b), "columns differ"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return a == b, len(a), len(b), diff[:3]


if __name__ == "__main__":
    from __spark_entry__ import queries, oracle_sql
    from pyspark.sql import SparkSession
    from warmgrid.session import local_session
    sf = sys.argv[1]
    pick = sys.argv[2:]
    spark = local_session("compare", 8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pick and not any(p in name for p in pick):
            continue
        t0 = time.time()
        try:
            if name in os_:
                ok, n, m, d = compare(spark, con, fn, os_[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect()); ok, m, d = n > 0, None, "rows only"
        except Exception as e:
            ok, n, m, d = False, None, None, str(e).split(chr(10))[0][:400]
        bad += not ok
        print(f"{'ok ' if ok and n else 'EMPTY' if ok else 'BAD'} {name} {n} {m} {time.time()-t0:.1f}s {'' if ok else d}", flush=True)
    print("bad:", bad)
    spark.stop()
