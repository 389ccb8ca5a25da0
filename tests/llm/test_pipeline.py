"""Registered queries next to their SQL, and the pipeline's stages on planted documents."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_url_rules", "op8_decontamination", "op11_ranked_search", "op12_prefix_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    line = "a planted passage " + " ".join(f"word{i}" for i in range(60))
    body = " ".join(f"plain{i}" for i in range(80))
    near = body.replace("plain40", "other")
    texts = [f"{line}\nfirst text of its own words and more of them", f"second text has other words, all its own\n{line}", body, near, body, bench[0].text, None, ""]
    docs = docs.unionByName(documents(texts, range(5_000_001, 5_000_009)))
    columns = docs.columns
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    left = {r.doc_id: r.text for r in kept.filter("doc_id > 5000000").collect()}
    assert kept.columns == columns
    assert left[5_000_001] == texts[0] and left[5_000_002] == texts[1].split("\n")[0]
    assert 5_000_005 not in left and {5_000_007, 5_000_008} <= set(left)
    copies = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).filter("doc_id > 5000000").collect()}
    assert 5_000_003 in copies and not {5_000_004, 5_000_005} & copies and {5_000_007, 5_000_008} <= copies
    clean = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).filter("doc_id > 5000000").collect()}
    assert 5_000_006 not in clean and len(clean) == 7
    assert corpus_pipeline.drop_toxic(spark, docs, SF).columns == columns


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
