import corpus_pipeline
import plain
import public_tokenizers
from test_operators import corpus, frame

from lodestone.llm import pieces, quality


def write(spark, folder, rows):
    frame(spark, rows, extra=False).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0)) for i, _ in rows if i % 2], "doc_id bigint, quality int").selectExpr("*", "0 AS toxic").write.parquet(f"{folder}/labels.parquet")
    words = next(t for _, t in rows if t and len(t.split()) > 60).split()
    spark.createDataFrame([(1, " ".join(words[5:40])), (2, "nothing like it in any of these texts here")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_plain_versions(spark, tmp_path):
    folder, rows = str(tmp_path), corpus(8, 40)
    write(spark, folder, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        docs = step(spark, docs, folder)
        if k < 4:
            assert docs.columns == columns
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            frame_ = spark.read.parquet(f"{folder}/documents.parquet")
            assert set(after) == {r.doc_id for r in quality.score(frame_, model).collect() if r.predicted}
        elif name == "near duplicates":
            assert set(after) == {c for _, _, c in plain.components(before)}
            assert all(dict(before)[i] == t for i, t in after.items())
        elif name == "substrings":
            assert {i: plain.sha(" ".join(plain.WORD.findall(t or ""))) for i, t in after.items()} == {i: s for i, n, gone, s in plain.later_phrases(before) if not n or gone < n}
        elif name == "decontamination":
            bad = {i for i, *_, contaminated in plain.leaks(before, benchmark) if contaminated}
            assert not bad & set(after)
            assert all(hit == 0 for _, _, hit, *_ in plain.leaks(sorted(after.items()), benchmark))
            assert all(after[i] == t for (i, t), (_, _, hit, *_) in zip(before, plain.leaks(before, benchmark)) if not hit)
        else:
            table = pieces.ChunkTable(public_tokenizers.path(pieces.MODEL))
            assert sorted((r.doc_id, r.n_tokens) for r in docs.collect()) == [(i, n) for (i, _), (n, _, _) in zip(before, table.code([t or "" for _, t in before]))]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(i for i, _ in before)
