"""Excerpts of every document, long and multi-byte ones too, against brute force."""

from timberline.plans.catalogue import QUERIES


def plain(text):
    out, at = "", 0
    for c in text or "":
        if at >= 160:
            break
        out += c
        at += len(c.encode())
    return out


def test_every_document_has_its_excerpt(spark, tmp_path):
    texts = [None, "", "short", "x" * 160, "x" * 161, "a" * 5000, "é" * 79 + "ab", "é" * 81, "a" + "é" * 300, "日本" * 400, "ab🎉" * 2000, "x" * 159 + "🎉 tail", "line\n" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.excerpt for r in QUERIES["document_excerpts"](spark, str(tmp_path)).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
