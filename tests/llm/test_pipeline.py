"""The pipeline's stages in their order, each on all that the one before kept."""

import duckdb

import corpus_pipeline
from strandline.llm import decontam
from strandline.llm.queries import OP9_SQL, QUERIES, SQL
from strandline.llm.runtime import stored, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA), name)
        assert docs.columns == table(spark, DATA, "documents").columns
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] > kept[4] > 0.5 * kept[0]
    matcher = decontam.Matcher([(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()], 0.08)
    assert not any(matcher.find(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}
    run = corpus_pipeline.run(spark, DATA)
    assert run.select("doc_id", "piece", "length", "ids_crc32").exceptAll(packed.select("doc_id", "piece", "length", "ids_crc32")).count() == 0


def test_near_duplicate_stage_equals_sql(spark):
    docs = table(spark, DATA, "documents")
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()}
    sql = OP9_SQL.replace("len(ws) >= 4", "len(ws) >= 5").replace("len(ws) - 2", "len(ws) - 3").replace("ws[i:i + 3]", "ws[i:i + 4]").replace("85 *", "80 *")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == {r[0] for r in db.sql(sql).fetchall() if r[0] == r[2]}


def test_queries_equal_sql(spark):
    db = duckdb.connect()
    for view in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    for name, sql in SQL.items():
        wanted, found = db.sql(sql), QUERIES[name](spark, DATA).select(*db.sql(sql).columns)
        assert sorted(wanted.fetchall(), key=str) == sorted(map(tuple, found.collect()), key=str), name


def rows(spark, values):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in values], table(spark, DATA, "documents").schema)


def test_near_duplicates_of_odd_rows(spark):
    """Repeated rows, null ids, several texts under one id, ties, empty texts; all against a plain rule."""
    base = " ".join(f"w{i}" for i in range(40))
    near, other = base + " tail", " ".join(f"v{i}" for i in range(30))
    values = [(5, base), (5, base), (5, other), (3, near), (None, base), (None, other), (None, other), (7, None), (8, None), (9, ""), (9, ""), (10, "alone one two")]
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, rows(spark, values), DATA).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(3, near), (5, other), (7, None), (8, None), (9, ""), (10, "alone one two")], key=str)
    nothing = corpus_pipeline.keep_one_of_near_duplicates(spark, rows(spark, []), DATA)
    assert nothing.columns == table(spark, DATA, "documents").columns and nothing.collect() == []


def test_stages_on_odd_rows_and_extra_columns(spark):
    """Every stage but the last keeps all columns, clashing names too, and defines nulls, empties and repeats."""
    values = [(1, None), (2, ""), (None, "some words of a text that is good enough to stay in the set"), (4, "word " * 30_000)]
    docs = rows(spark, values + values[:2]).selectExpr("*", "1 AS id", "2 AS gone", "3 AS _removed", "4 AS key", "5 AS n", "6 AS hash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), DATA).collect() == [], name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("doc_id = 1").count() == 2 and {r["length"] for r in packed.where("doc_id in (1, 2)").collect()} == {1}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).collect() == []


def test_line_stage_takes_all_that_chunks_take(spark):
    """The stage cuts and compares op3's chunks, those of blank lines too, and leaves no repeated pair of lines."""
    from strandline.llm import line_dedup

    lines = [f"line {i} of a passage" for i in range(12)]
    values = [(1, "\n\n"), (2, "\n\n"), (3, "\n".join(lines)), (4, "\n".join(["x", *lines[2:9], "y"])), (5, None), (6, "")]
    docs = rows(spark, values)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, DATA).collect()}
    assert got == dict(values) | {2: "", 4: "x\ny"}
    for r in line_dedup.dedup_line_chunks(docs).collect():
        assert r["text"] is None or len(got[r["doc_id"]]) <= len(r["text"])
