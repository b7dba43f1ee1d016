import random

import corpus_pipeline as p
from foldquery.llm.queries import QUERIES, SQL


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor"]) + str(rng.randrange(10**5)) for _ in range(n)) + "."
    item = text(30)
    shared = " ".join(text(12) for _ in range(6))
    docs, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        body = (text(40).upper() + "!! ***") * 2 if bad else f"{text(40)}\n{text(30)}"
        docs.append([i, body])
        labels.append((i, int(not bad), 0))
    docs[1][1] += " " + item + " " + text(10)
    docs[7][1] = docs[2][1] = text(90)
    docs[3][1] += "\n" + shared + "\n" + text(50)
    docs[9][1] += "\n" + shared + "\n" + text(50)
    d = str(tmp_path)
    rows = [(i, t, "en", "src1", len(t)) for i, t in docs] + [(None, text(50), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    current = spark.read.parquet(f"{d}/documents.parquet")
    names, left = current.columns, {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, current, d)
        out.write.parquet(f"{d}/out{k}")
        current = spark.read.parquet(f"{d}/out{k}")
        left[name] = {r.doc_id for r in current.select("doc_id").collect()}
        if k < 4:
            assert current.columns == names
        if k == 2:
            texts = {r.doc_id: r.text for r in current.collect()}
    good = {i for i in range(120) if i % 6}
    a, b, c, e, f = left.values()
    assert len(good - a) <= 2 and not a & {i for i in range(120) if i % 6 == 0}
    assert a - b == {7} and b == c and c - e == {1} and e == f and None in f
    assert shared in texts[3] and shared[100:-100] not in texts[9] and len(texts[9]) > 400
    assert {tuple(r) for r in p.run(spark, d).select("doc_id", "n_tokens").collect()} == {tuple(r) for r in current.select("doc_id", "n_tokens").collect()}


def test_odd_tables(spark, tmp_path):
    """Every stage on an empty table, with empty labels and benchmark, on nulls, repeats and columns of any name."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed int, found string, _x int, id string, quality_score int, y int"
    long = "many words stand here " * 3000
    rows = [(1, "some text of this row", "en", "s", 21, 1, "f", 2, "i", 3, 4), (1, "some text of this row", "en", "s", 21, 1, "f", 2, "i", 3, 4), (None, None, None, None, None, None, None, None, None, None, None), (2, "", "", "", 0, 1, "f", 2, "i", 3, 4), (3, long, "en", "s", len(long), 1, "f", 2, "i", 3, 4)]
    for k, (docs, labels, items) in enumerate((([], [], []), (rows, [], []), (rows, [(1, 1, 0), (2, 0, 0), (None, None, None)], [(0, "no such text stands in any of these rows"), (None, None)]))):
        d = str(tmp_path / str(k))
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        current = spark.read.parquet(f"{d}/documents.parquet")
        names = current.columns
        for i, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, current, d)
            if i < 4:
                assert out.columns == names
            out.write.parquet(f"{d}/out{i}")
            current = spark.read.parquet(f"{d}/out{i}")
            if k == 1 and 0 < i < 4:
                assert sorted((r.doc_id or 0, r.removed or 0, r.found or "") for r in current.collect()) == sorted((r[0] or 0, r[5] or 0, r[6] or "") for r in rows)
        assert current.columns == ["doc_id", "ids", "n_tokens", "exact"] and bool(current.count()) == bool(docs)
