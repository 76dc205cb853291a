import corpus_pipeline
from eventlake.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs.selectExpr("*", "'own' as component_id", "1 as row_")
    counts = [now.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == now.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in now.collect()}
        now = spark.createDataFrame(rows, now.schema)
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in now.collect()}


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (10**12, None, "en", "s", 0), (10**12, " \n", None, "s", 0), (10**12 + 1, "word " * 40_000, "en", "s", 0)]
    odd += [odd[4], (10**12 + 2, "only here, twice", "en", "s", 0), (10**12 + 2, "only here, twice", "en", "s", 0)]
    now = docs.limit(40).unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' as root_", "1 as mark_", "2 as p_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, now, SF).collect()
        ids = [r.doc_id for r in rows]
        assert 10**12 + 1 in ids and 10**12 + 2 in ids
        if "dedup" in name:
            assert ids.count(10**12 + 1) == 1 and sum((r.text or "").strip() == "" for r in rows) == 1
        now = spark.createDataFrame(rows, now.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sum(p.length for p in pieces if p.doc_id == 10**12 + 1) == 40_001


def test_every_operator_is_registered():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")]
    assert numbers == list(range(1, 11)) and "pipeline" in queries.QUERIES
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        text = lambda rows: sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in rows), key=str)
        assert text(got.select(columns).collect()) == text(want.select(*columns).fetchall())
