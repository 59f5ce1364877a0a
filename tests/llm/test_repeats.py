"""Repeated passages across rows that share a doc_id or have none."""

from heddle.llm import stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_passages_repeated_across_shared_and_missing_ids_are_cut(spark, sf):
    passage = " ".join(f"p{i}" + "." * (i % 8 == 7) for i in range(64))
    own = lambda k: " ".join(f"o{k}x{i}" + "." * (i % 8 == 7) for i in range(24))
    ids = [7, 7, None, None, 9]
    docs = [(i, f"{own(k)} {passage} {own(k + 10)}", "en", "s", 0) for k, i in enumerate(ids)]
    out = stages.cut_repeats(spark, spark.createDataFrame(docs, DOCS).repartition(3), sf).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, ids))
    assert sum("p20 p21 p22" in r.text for r in out) == 1
    assert all(r.n_chars == len(r.text) for r in out if "p20" not in r.text)
