import random

import corpus_pipeline
from tests.llm.test_corpus_operators import prose


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, tmp_path):
    r = random.Random(1)
    clean = {k: prose(120, 5000 + k) for k in range(200)}
    toxic = {300 + k: prose(80, 6000 + k) + " " + " ".join(r.sample(["vile", "rotten", "nasty", "foul"], 3)) for k in range(60)}
    copies = {400: clean[1], 401: clean[2] + " end"}
    item = prose(60, 7000)
    contaminated = {500: prose(100, 7001) + " " + item}
    passage = prose(80, 7100)
    repeats = {600: prose(90, 7101) + " " + passage, 601: prose(90, 7102) + " " + passage}
    rows = [(i, t, "en", "s", len(t)) for part in (clean, toxic, copies, contaminated, repeats) for i, t in part.items()] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in (*clean, *toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({x.doc_id: x.text for x in docs.collect()})
    assert len([k for k in kept[0] if 300 <= k < 400]) <= 6 and set(clean) <= set(kept[0])
    assert not {400, 401} & set(kept[1]) and set(clean) <= set(kept[1])
    assert all(kept[2][k] == t for k, t in clean.items()) and len(kept[2][601]) < len(repeats[601]) and kept[2][600] == repeats[600]
    assert 500 not in kept[3] and set(clean) <= set(kept[3])
    assert kept[3][900] is None and kept[3][901] == ""
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in done.collect()} == set(kept[3]) and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(done.columns)
