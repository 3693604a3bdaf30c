"""The pipeline: its stages one by one against plain Python."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import brute_cover
from tests.llm.test_nearcopies import brute_kept
from tidelog.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name == "language":
            want = {d: t for d, t in rows.items() if any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            kept = brute_kept(rows)  # five words, 0.8: the stage's own rule, not operator 2's three bits
            want = {d: t for d, t in rows.items() if d in kept}
        elif name == "repeated_substrings":
            mark = brute_cover({d: t.encode() for d, t in rows.items()}, 100, False)
            want = {d: bytes(x for x, m in zip(t.encode(), mark[d]) if not m).decode("utf-8", "ignore") for d, t in rows.items()}
            want = {d: t for d, t in want.items() if t}
        elif name == "benchmark_passages":
            want = {d: t for d, t in rows.items() if not any(x in t for x in items)}
        else:
            assert {r["doc_id"] for r in out.collect()} == set(rows)
            assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())
            break
        assert out.columns == corpus_pipeline.COLUMNS
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
        else:
            assert got == want
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        docs, rows = out, got


def test_stages_keep_odd_rows(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).count() == 0
        assert stage(spark, odd, sf).columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.near_duplicates(spark, odd, sf).count() < 12
    assert np.all([r["n_chars"] == 9 for r in corpus_pipeline.language(spark, odd, sf).collect()])


def test_tokens_of_odd_rows(spark, sf, odd, empty):
    """Equal to the library's ids, whatever the text; the empty table and null texts too."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    from tidelog.llm.queries import tokenizer_path

    with open(tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines())}
    library = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.tokens(spark, odd.withColumn("uid", odd.did), sf).collect()
    texts = sorted(library.encode_ordinary(r["text"] or "") for r in odd.collect())
    assert sorted(r["ids"] for r in rows) == texts and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert corpus_pipeline.tokens(spark, empty, sf).count() == 0


def test_run_on_odd_and_empty_tables(spark, sf, odd, empty, tmp_path):
    """Every case at once, from the first stage to the last."""
    benchmark = table(spark, sf, "benchmark")
    for name, docs in (("odd", odd.withColumn("more", F.create_map(F.lit("a"), F.lit(1)))), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    assert set(got) <= {(False, 1), (True, 0), (False, 5), (False, 8)} and (False, 1) in got
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
