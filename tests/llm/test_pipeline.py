"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

from llm.conftest_llm import SF, odd_rows
from llm.test_near_duplicates import brute
from llm.test_suffix_dedup import brute as cut
from llm.test_tokens import check_packing

import corpus_pipeline as P
from vacancy_spark.llm import toxicity
from vacancy_spark.session import fresh_path


def staged(spark, docs, sf_dir):
    """(name, input, output) of every stage, written and read as run() does."""
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"test-{name}")
        out.write.parquet(path)
        out = spark.read.schema(out.schema).parquet(path)
        yield name, docs, out
        docs = out


def check(spark, docs, sf_dir):
    for name, before, after in staged(spark, docs, sf_dir):
        old, new = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "toxicity":
            from pyspark.sql import functions as F
            m = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
            score = m.scores([(r.text or "").encode() for r in old])
            assert Counter(new) == Counter(r for r, s in zip(old, score) if s < 0.5)
        if name == "near_duplicates":
            root, _ = brute([(r.doc_id, r.text) for r in old])
            assert len(new) == len(set(root)) and not Counter(new) - Counter(old)
            of = {}
            for r, k in zip(old, root):
                of.setdefault(r, set()).add(k)
            assert len(set().union(*(of[r] for r in new)) if new else set()) == len(new)
        if name == "suffix_dedup":
            want = cut([(r.text or "").encode() for r in old], 200)
            assert Counter(r.doc_id for r in old) == Counter(r.doc_id for r in new)
            for r, (n, removed, *_) in zip(old, want):
                mine = [x for x in new if x.doc_id == r.doc_id]
                assert removed or r.text in [x.text for x in mine]
            assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in new)
        if name == "mixing":
            assert set(new) <= set(old)
            most = Counter(old)
            assert all(n <= 2 * most[r] for r, n in Counter(new).items())
        if name == "packing":
            check_packing(new, [(r.doc_id, r.text) for r in old], 4096)


def test_driver_documents(spark, sf_docs):
    check(spark, sf_docs, SF)


def test_odd_rows(spark, odd, none):
    check(spark, odd, SF)
    check(spark, none, SF)


def test_registered_run(spark):
    import __spark_entry__ as E

    rows = E.queries()["pipeline"](spark, SF).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert not E.llm.ORACLE.keys() - E.queries().keys()
