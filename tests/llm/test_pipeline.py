import os

import duckdb
import pytest


def connect(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op4_url_filter", "op8_curriculum_mix", "op9_decontamination"])
def test_sql(spark, data, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, data)
    want = connect(data).execute(entry.oracle_sql()[name]).df()[got.columns]
    key = lambda row: tuple(str(x) for x in row)
    clean = lambda rows: sorted((tuple(None if x != x or x is None else x for x in r) for r in rows), key=key)
    assert clean(map(tuple, got.collect())) == clean(want.itertuples(index=False, name=None))


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, data, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    ids = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, data)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        ids.append({r.doc_id for r in docs.collect()})
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert ids[1] < ids[0] and ids[2] < ids[1] and ids[3] < ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]
    final = docs.collect()
    assert len(final) == seen[4]
    by_shard = {}
    for r in final:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_run_equals_its_stages(spark, data, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(map(tuple, P.run(spark, data).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_empty_input(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_slots_keep_the_training_order(spark, data, tmp_path):
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    from lanewise.llm.mixing import curriculum

    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = [(r.id, r.copy) for r in curriculum(docs).select("id", "copy").collect()]
    P.mixing(spark, docs, data).repartitionByRange(7, F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    got = P.sharding(spark, mixed, data).collect()
    shard = {}
    for r in got:
        shard.setdefault(r["shard"], []).append((r.slot, r.doc_id))
    place = {}
    for k, (d, _) in enumerate(want):
        place.setdefault(d, []).append(k)
    for rows in shard.values():
        at = -1
        for _, d in sorted(rows):  # each copy stands after the one before it
            later = [k for k in place[d] if k > at]
            assert later
            at = later[0]
    assert sum(map(len, shard.values())) == len(want)


def test_sharding_of_a_table_without_files(spark, docs):
    import corpus_pipeline as P

    assert P.sharding(spark, docs, "").count() == docs.count()


class Session:
    """As much of a session as the choice of a folder reads."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_needs_a_shared_folder():
    from lanewise.llm.common import shared_folder

    assert shared_folder(Session("spark://x:7077", "hdfs://x/shared")) == "hdfs://x/shared"
    assert shared_folder(Session("local[4]")) and shared_folder(Session("local"))
    for master in ("spark://x:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(Session(master))
