import os
import shutil

import corpus_pipeline as p
from quillgraph.llm import golay_simhash
from tests.llm.data import odd
from tests.llm.test_op5 import PATH
from tests.llm.test_op6 import slow as secrets_of
from tests.llm.test_op8 import planted
from tests.llm.test_op10 import slow as groups_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    benchmark = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    now = {r.doc_id: r for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = golay_simhash.saved(out, "t")
        kept = {r.doc_id: r for r in docs.collect()}
        gone = set(now) - set(kept)
        assert set(kept) <= set(now)
        if name == "toxicity":
            assert sum(labels.get(d) == 0 for d in gone) <= 2 and len(gone) < 0.3 * len(now)
        if name == "near_dedup":
            slow = groups_of([(d, r.text) for d, r in now.items()])
            assert set(kept) == {d for d, _, c in slow if d == c}
        if name == "decontamination":
            held = {d for d, r in now.items() if any(b in r.text for b in benchmark)}
            assert held <= gone and len(gone - held) <= 1 + len(held)
        if name == "secrets":
            assert not gone and not any(secrets_of(r.text) for r in kept.values())
            assert all(kept[d].text == r.text for d, r in now.items() if not secrets_of(r.text) and "[secret]" not in kept[d].text)
            assert all(r.n_chars == len(r.text) for d, r in kept.items() if r.text != now[d].text)
        now = kept
    rows = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(now) and PATH and planted
    assert len(rows) == p.run(spark, SF).count()


def odd_folder(spark, path, rows):
    """Tables of odd documents, with extra columns whose names the stages use or quote."""
    names = ["fitting_rules", "secret_spans", "text_is_null", "toxicity_score", "score", "component_id", "fp", "hash", "a`b"]
    docs = odd(spark).limit(rows).selectExpr("*", *(f"coalesce(doc_id, 0) + {k} as `{c.replace('`', '``')}`" for k, c in enumerate(names)))
    docs.write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    return names, spark.read.parquet(f"{path}/documents.parquet")


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    names, docs = odd_folder(spark, tmp_path, 100)
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = golay_simhash.saved(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == columns
        kept = docs.collect()
        # of the equal texts (1, 4, 4) and those without words (2, 3, 5) the first stays
        want = [None, 1, 2, 6, 7, 8, 9] if name != "toxicity" else [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
        if name in ("toxicity", "near_dedup"):
            assert sorted((r.doc_id for r in kept), key=lambda d: (d is not None, d)) == want
        assert len(kept) <= before
        assert all([r[c] for c in names] == [(r.doc_id or 0) + k for k in range(len(names))] for r in kept)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[2] is None and texts[1] == "one two three"
    rows = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert next(r for r in rows if r.doc_id == 2).n_tokens == 0


def test_empty_tables(spark, tmp_path):
    odd_folder(spark, tmp_path, 0)
    assert p.run(spark, str(tmp_path)).count() == 0
    odd_folder(spark, tmp_path / "b", 100)
    for t in ("labels", "benchmark"):
        schema = spark.read.parquet(f"{SF}/{t}.parquet").schema
        os.remove(tmp_path / "b" / f"{t}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/{t}.parquet")
    assert p.run(spark, f"{tmp_path}/b").count() == 7
