import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandline.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session


@pytest.fixture(scope="session")
def small_dir(spark, tmp_path_factory):
    """A folder with a small ``documents`` table: short texts of the given data, and odd ones."""
    folder = tmp_path_factory.mktemp("small")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 20 and 400").orderBy("doc_id").limit(24)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 3."), (9004, "n u N"), (9005, "uuuuuuuuuuuuuuuuuuuuuu")], "doc_id long, text string")
    rows = given.select("doc_id", "text").union(odd).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) as bigint) AS n_chars")
    rows.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    items = [(1, given.first()["text"]), (2, None), (3, " ".join(r["text"] for r in given.tail(2)))]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)
