import zlib

import corpus_pipeline
from assayer.llm import decontamination, minhash, packing, pii, toxicity
from assayer.llm.common import settle, table
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


def test_each_stage_does_its_job_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "decontamination", "personal_data", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = settle(stage(spark, before, SF))
        assert docs.columns == columns and docs.schema == before.schema
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept[name] = rows
        gone = before.join(docs.select("doc_id"), "doc_id", "left_anti")
        if name == "toxicity":
            grammar = toxicity.learn(toxicity.sample_of(before, table(spark, SF, "labels"), "doc_id", "toxic", 20_000))
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(before, grammar, ["doc_id"]).collect()}
            assert set(rows) == {k for k, s in scores.items() if s < 0.5} and 0 < len(scores) - len(rows) < 0.2 * len(scores)
        elif name == "minhash":
            classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(before).collect()}
            assert set(rows) == set(classes.values()) and len(rows) < len(classes)
        elif name == "decontamination":
            found = decontamination.contaminated(before, table(spark, SF, "benchmark")).select("doc_id").distinct()
            assert {r["doc_id"] for r in gone.collect()} == {r["doc_id"] for r in found.collect()}
        else:
            assert set(rows) == set(kept["decontamination"])
            assert pii.find(docs, ["doc_id"]).where("size(spans) > 0").count() == 0
            assert any("<EMAIL>" in (t or "") for t in rows.values())
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == rows.keys()
    for doc, got in list(pieces.items())[::20]:
        raw = b"".join(i.to_bytes(4, "little") for i in [*tokenizer.encode(rows[doc] or "", add_special_tokens=False).ids, 1])
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_run_gives_the_pieces(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_odd_rows(spark, tmp_path):
    text = "some words that are long enough to be told apart by their shingles of five words each"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (3, text + " and others here that differ from all that came before it, by very much indeed as one can see"), (4, "write to bob@x.org, please, all of you who read this")]
    docs = spark.createDataFrame([(i, t, "en", "s", 7, "row", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, __spans int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, "not in any document at all, this")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = settle(stage(spark, current, str(tmp_path)))
        assert current.schema.names == docs.schema.names and [f.dataType for f in current.schema] == [f.dataType for f in docs.schema]
    got = sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path)).collect())
    assert [k for k, _ in got] == [1, 2, 3, 3, 4] and got[0][1] == got[1][1] == 1
    empty = tmp_path / "empty"
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
