"""Values of one owner are live in however many documents they stand."""

from tidewatch.llm import secret_scan


def test_one_owner_in_many_documents(spark):
    rows = [(i, f"copy {i} Bearer abcdefghij0123456789xyz end", "own") for i in range(25)]
    rows += [(100 + i, "see Bearer placeholder0123456789abc end", f"s{i % 3}") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.secret_scan(docs).collect()}
    assert all(got[i] == (["bearer"] if i < 100 else []) for i, _, _ in rows)
    red = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(red[i] == (f"copy {i} <bearer> end" if i < 100 else text) for i, text, _ in rows)
