import re

import public_tokenizers as public
import tiktoken

from litsieve.llm.pieces import load_ranks

from .data import frame, repeats_brute, texts
from .test_decontamination import brute as leaks_brute
from .test_near_dedup import brute as near_brute

key = lambda x: tuple((y is None, y) for y in x)


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = texts()
    long = [t for _, t in rows if t and len(t.split()) > 100]
    bench = [(1, " ".join(long[1].split()[20:45])), (2, "nothing like it in any of these documents " * 3)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/stage{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns or k == 4, name
        got.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) if k < 4 else sorted(((r.doc_id, r.n_tokens) for r in docs.collect()), key=key))
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert got[0] == sorted(want, key=key)
    kept = near_brute(want, 5, 80)
    want = list(dict.fromkeys(r for r, k in zip(want, kept, strict=True) if k[3] or r[0] is None))
    assert got[1] == sorted(want, key=key)
    cut = repeats_brute(want, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), " ".join, 50)
    want = [(i, c[4] if c[2] else t) for (i, t), c in zip(want, cut, strict=True) if c[4]]
    assert got[2] == sorted(want, key=key)
    want = [r for r, c in zip(want, leaks_brute(want, bench, 10), strict=True) if not c[5]]
    assert got[3] == sorted(want, key=key) and 0 < len(want) < len(got[2])
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert got[4] == sorted(((i, len(plain.encode_ordinary(t))) for i, t in want), key=key)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.n_tokens) for r in whole.collect()), key=key) == got[4]


def test_language_stage_without_labels_keeps_documents_with_letters(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Plain words.", None), (2, "12 + 3", None), (3, None, None), (4, "été", None), (5, "", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.language_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]


def test_stages_take_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    names = ["rid", "kept", "row", "lang_pred", "score", "nats", "component", "digest", "every", "nth", "shingles", "copy", "marks", "spans", "items", "id", "c", "t"]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n}{i}" for n in names)) for i, t in [*texts(), (None, None), (7, "the one and only"), (7, "the one and only")]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(1, None), (None, "the one and only text of them all, or so it was said")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            out = f"{tmp_path}/{len(table)}-{k}"
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
            for r in docs.collect():
                assert all(r[n] == f"{n}{r.doc_id}" for n in names)
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_language_stage_rejects_gibberish_and_keeps_clean_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "xkqzj vbnmq wqzxk jhgfd qqzzx " * 3, None), (-2, "the town", None), (-3, "a", None), (-4, "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=qqzzxxjj", None), (-5, None, None), (-6, "12 + 3", None)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    left = corpus_pipeline.language_stage(spark, both, "").select("doc_id")
    assert sorted(r.doc_id for r in left.where("doc_id < 0").collect()) == [-3, -2]
    gone = docs.where("lang is not null and text rlike '[a-z]'").join(left, "doc_id", "left_anti")
    assert gone.count() == 0
