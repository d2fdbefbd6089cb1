import hashlib

import corpus_pipeline
import pyarrow as pa
import pytest
from testsieve.llm import common as C
from testsieve.llm import piece_encoding, secret_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_texts_stay_in_the_language_stage(spark):
    table = [(i, f"{a} {b} gemein", lang, "s", 1) for i, (a, b, lang) in enumerate([("wort", "haus", "de"), ("word", "house", "en"), ("mot", "maison", "fr")] * 20)]
    table += [(100, "gemein", "en", "s", 1), (101, "Ωψ", "en", "s", 1), (102, "1 2 !", "en", "s", 1), (103, None, "en", "s", 1)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(table, SCHEMA), "")
    assert {r.doc_id for r in got.collect()} == {r[0] for r in table} - {102, 103}


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_in_turn(spark, tmp_path, rows):
    clean = lambda i: " ".join(f"word{(i * 31 + k * 7) % 997} of" for k in range(40))
    item = " ".join(f"bench{k}" for k in range(20))
    table = [(i, clean(i), "en", "s", len(clean(i))) for i in range(rows)]
    if rows:
        table += [(100, clean(1), "en", "s", 1), (101, clean(2) + " extra", "en", "s", 1), (102, "12 345 !!", "en", "s", 1), (103, None, "en", "s", 1),
                  (104, "lead in " + item + " lead out", "en", "s", 1),
                  (105, "a text of its own with token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" inside of it", "en", "s", 1)]
    docs = spark.createDataFrame(table, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = C.written(stage(spark, at, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "pieces":
            assert at.columns == docs.columns
    if rows:
        all_ = {r[0] for r in table}
        assert set(seen["language"]) == all_ - {102, 103}
        assert set(seen["near_duplicates"]) == set(seen["language"]) - {100, 101}
        assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {104}
        assert set(seen["secrets"]) == set(seen["decontamination"]) == set(seen["pieces"])
        assert seen["secrets"][105].text == "a text of its own with [SECRET]\" inside of it"
        assert seen["secrets"][105].text == secret_spans.redacted(table[-1][1], secret_spans.base_spans(table[-1][1]))
        assert seen["secrets"][105].n_chars == len(seen["secrets"][105].text)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == set(seen["pieces"])


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_keep_columns_of_any_name(spark, tmp_path, repeated):
    extra = ["kept_id", "fp", "kept", "_set", "_bare", "found", "digest", "bands", "sig", "spans", "ids", "row"]
    words = lambda i: " ".join(f"word{(i * 31 + k * 7) % 997} of" for k in range(40))
    table = [(i % 20 if repeated else i, words(i % 30), "en", "s", "many", *extra) for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars string, " + ", ".join(f"{c} string" for c in extra))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no words of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = C.written(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        rows = at.collect()
        assert all(list(r[5:]) == extra for r in rows) and {r.text for r in rows} == {t[1] for t in table}
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == len(rows)


def test_the_last_stage_decodes_its_ids(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m, rows, seen = piece_encoding.PieceModel(path), [], []
    monkeypatch.setattr(m, "decode", lambda ids: seen.append(ids) or "back", raising=False)
    monkeypatch.setattr(piece_encoding, "model", lambda *_: m)
    monkeypatch.setattr(C, "map_rows", lambda df, fn, schema: rows.append(fn))
    texts = ["one two", None, "Ünï  cödé 中文\n"]
    corpus_pipeline.encode_pieces(spark, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "")
    (got,) = rows[0](pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2], "text": texts}))
    want = [sp.encode(t or "", add_eos=True) for t in texts]
    assert seen == want == [x.tolist() for x in got["ids"]]
    assert got["decoded_sha256"] == [hashlib.sha256(b"back").hexdigest()] * 3
