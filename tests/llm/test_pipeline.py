import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from timberline.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from timberline.llm.runtime import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages(spark):
    """Each stage on all that the one before kept, against a plain version."""
    from timberline.llm.sentencepiece_trie import Vocabulary

    docs = written(spark.read.parquet(f"{SF}/documents.parquet"), "docs")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        kept[name + "<"] = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        kept[name] = [r for r in docs.collect()]
        assert name == "sentencepiece" or docs.columns == columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(kept["toxicity<"]) - {r.doc_id for r in kept["toxicity"]}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert not gone & clean and (not toxic or gone & toxic)
    best = {}
    for i, r in sorted(kept["exact_dedup<"].items()):
        best.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), i)
    assert sorted(best.values()) == sorted(r.doc_id for r in kept["exact_dedup"])
    from itertools import combinations

    from tests.llm.test_python import roots
    from tests.llm.test_similar import plain, similarity

    ids = sorted(kept["simhash_near_dedup<"])
    sets = [plain(kept["simhash_near_dedup<"][i].text) for i in ids]
    near = [(a, b) for a, b in combinations(range(len(ids)), 2) if similarity(sets[a], sets[b]) >= 0.8]
    assert sorted({ids[k] for k in roots(len(ids), near)}) == sorted(r.doc_id for r in kept["simhash_near_dedup"])
    library = Vocabulary(vocabulary("piece_bpe_32k.model")).library
    texts = kept["sentencepiece<"]
    assert len(kept["sentencepiece"]) == len(kept["mixing"])
    assert all(r.ids == library.encode(texts[r.doc_id].text or "") for r in kept["sentencepiece"])


def test_repeated_rows_and_null_ids(spark):
    """Rows that repeat are one document to the stages that drop copies; a row without an id goes where its text has one."""
    text = "one two three four five six seven " * 3
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + "!", "en", "s", 9), (None, text, "en", "s", 9), (3, "w " * 20_000, None, None, None), (3, "w " * 20_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
        found = sorted((r.doc_id or 0) for r in docs.collect())
        assert set(found) <= {1, 2, 3} if name != "toxicity" else len(found) == 6
        assert name not in ("exact_dedup", "simhash_near_dedup") or len(found) == len(set(found))


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() == 0, name
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "a b c", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        odd = written(stage(spark, odd, SF), "odd")
    # Texts without words are copies of the first one, which has no words to mix.
    assert {r.doc_id for r in odd.select("doc_id").collect()} <= {1, 4}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(plain(dict(zip(names, r))[k]) for k in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr) == want


def test_run(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "ids"] and rows.filter(F.size("ids") > 0).count() > 0
