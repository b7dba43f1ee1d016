import pytest
from pyspark.sql import functions as F

from foldquery.engine import Engine, RequestError, register
from foldquery.operators import store
from foldquery.plans.search import search
from foldquery.sources.files import fasta, sequence_files
from foldquery.sources.sinks import SCHEMAS
from foldquery.streaming.changes import all_changes, changes, deliver, for_user, running_counters


def test_service(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    s = e.create_sequence("virus", "a made-up sequence", "ACC1", "gggaaaccc", 7)
    c = e.create_cssd("stem", "<<<___>>>", "1", 7, published=True)
    job = e.create_job(s, c, 7)
    hits = e.results(job).collect()
    assert [(r.position, r.hit_string) for r in hits] == [(1, "<<<___>>>"), (2, "<<___>>")]
    assert e.results(job, start=2, limit=1).count() == 1
    summary = e.results_summary(job).collect()
    assert [(r.position, r.n, r.std_fe) for r in summary] == [(1, 1, None), (2, 1, None)]
    assert e.result_index(job, 2, hits[1].fe) == 1
    assert e.jobs(7).first().accession == "ACC1" and e.jobs(8).count() == 0
    e.update_cssd(c, 7, name="renamed")
    assert e.cssds(9).first().name == "renamed"
    with pytest.raises(RequestError):
        e.create_cssd("bad", "<<___>", "", 7)
    with pytest.raises(RequestError):
        e.create_sequence("virus", "a made-up sequence", "ACC2", "xyz", 7)
    for taken in (("another definition", "ACC1"), ("a made-up sequence", "ACC9")):
        with pytest.raises(RequestError):
            e.create_sequence("virus", *taken, "gggaaaccc", 7)
    with pytest.raises(RequestError):
        e.create_cssd("another", "<<<___>>>", "1", 7)
    assert e.sequences(7).count() == 1
    e.delete_job_with_results(job, 7)
    assert e.results(job).count() == 0 and e.job(job).count() == 0
    e.delete_sequence(s, 7)
    assert e.sequences(7).count() == 0


def test_jobs(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "store"))
    s, c = e.create_sequence("virus", "a made-up sequence", "ACC1", "gggaaaccc", 7), e.create_cssd("stem", "<<<___>>>", "1", 7)
    jobs = [e.create_job(s, c, 7) for _ in range(5)]
    assert jobs == sorted(set(jobs)) and all(e.results(j).count() == 2 for j in jobs)
    assert [r._id for r in e.jobs(7).collect()] == jobs[::-1]

    def fails(*_):
        raise RuntimeError("no search")

    monkeypatch.setattr(e, "scan", fails)
    with pytest.raises(RuntimeError):
        e.create_job(s, c, 7)
    assert e.jobs(7).count() == 5


def test_functions_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "gggaaaccc")], "seq_id int, nt string").createOrReplaceTempView("one")
    search(spark.table("one"), "<<<___>>>", context=0).createOrReplaceTempView("hits")
    r = spark.sql("SELECT round(rna_fe(around, chain, constraints), 2) AS fe, rna_hit_string(chain, constraints) AS hit FROM hits").first()
    assert (r.fe, r.hit) == (-1.12, "<<<___>>>")


def test_users(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert [e.create_user(n, f"sub-{n}") for n in ("ann", "bob")] == [1, 2]
    with pytest.raises(RequestError):
        e.create_user("eve", "sub-ann")
    assert e.user("sub-bob").first().ref_id == 2


def test_a_broken_rewrite_is_mended(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_user("ann", "sub-ann")
    (tmp_path / "users").rename(tmp_path / "users.new")
    assert e.user("sub-ann").count() == 1


def test_all_changes(spark, tmp_path):
    root, seen = str(tmp_path / "store"), []
    e = Engine(spark, root)
    c = e.create_cssd("stem", "<<<___>>>", "1", 7)
    e.update_cssd(c, 7, name="renamed")
    e.delete_cssd(c, 7)
    deliver(for_user(all_changes(spark, root), 7), lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"), once=True).awaitTermination()
    assert sorted((r.op, r._id, r.collection) for r in seen) == [(op, c, "cs") for op in ("delete", "insert", "update")]


def test_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("GGG AAA\n12 TTT\n")
    assert sequence_files(spark, str(tmp_path / "one.txt")).first().nt == "gggaaauuu"
    (tmp_path / "two.fa").write_text(">A first one\nACGT\nAC\n>B\nGGTT\n")
    assert [(r.accession, r.definition, r.nt) for r in fasta(spark, str(tmp_path / "two.fa")).orderBy("accession").collect()] == [("A", "first one", "acguac"), ("B", "", "gguu")]


def test_changes(spark, tmp_path):
    path, seen = str(tmp_path / "results"), []
    rows = spark.createDataFrame([("1", "j", 0.0, 1, -1.0, "<>", 5), ("2", "j", 0.0, 2, -1.0, "<>", 6)], SCHEMAS["results"])
    rows.write.parquet(path)
    events = for_user(changes(spark, path, SCHEMAS["results"], "results"), 5)
    deliver(events, lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"), once=True).awaitTermination()
    assert [(r.op, r._id, r.collection) for r in seen] == [("insert", "1", "results")]


def test_running_counters(spark, tmp_path):
    path = str(tmp_path / "windows")
    rows = spark.createDataFrame([(1, True), (1, False), (1, None), (2, True)], "job_id int, ok boolean")
    rows.write.parquet(path)
    stream = running_counters(spark.readStream.schema("job_id int, ok boolean").parquet(path))
    stream.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = store.window_counters(rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counters")) == key(batch) == [(1, 3, 1, 1), (2, 1, 1, 0)]


def test_counters_and_changes(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in (5, 3, 9)], "k int, name string")
    assert sorted((r.k, r.seq) for r in store.next_ids(df, 10, "k").collect()) == [(3, 11), (5, 12), (9, 13)]
    assert sorted(r.name for r in store.update(df, F.col("k") > 4, name="x").collect()) == ["n3", "x", "x"]
    assert [r.k for r in store.delete(df, F.col("k") > 4).collect()] == [3]
    with pytest.raises(ValueError):
        store.page(df, 0, 1)
    assert [r.value for r in spark.createDataFrame([("a\t1\t2\t<>",), ("x",)], "value string").transform(lambda d: store.parse_results(d)).select(F.col("hit_string").alias("value")).collect()] == ["<>"]
