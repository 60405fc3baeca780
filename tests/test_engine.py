import datetime
import math
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.__main__ import main

from orbweave.config import Config
from orbweave.errors import DimensionError, LimitError, NotFoundError, QuerySyntaxError
from orbweave.functions import text as T
from orbweave.functions import vectors as V
from orbweave.operators import kv, ordered_index, retrieval, text_index, vector
from orbweave.session import Engine
from orbweave.sources import files, log, snapshot
from orbweave.sources.shared import numbered
from orbweave.streaming import jobs


@pytest.fixture
def engine(spark):
    return Engine(spark, Config(dimension=4))


def test_nearest_of_unit_basis(engine):
    for i in range(4):
        engine.vector_insert(i + 1, [float(i == j) for j in range(4)])
    first = engine.vector_search([1, 0, 0, 0], 2).first()
    assert first["vec_id"] == 1 and first["distance"] < 0.01
    assert [r["vec_id"] for r in engine.query("[0, 1, 0, 0]").collect()][0] == 2
    engine.vector_delete(1)
    engine.vector_delete(1)
    assert engine.vector_count() == 3
    assert 1 not in [r["vec_id"] for r in engine.vector_search([1, 0, 0, 0], 4).collect()]
    engine.vector_insert(1, [1, 0, 0, 0])
    assert engine.vector_count() == 4
    with pytest.raises(DimensionError):
        engine.vector_insert(9, [1, 2])
    with pytest.raises(DimensionError):
        engine.vector_search([1, 2])
    with pytest.raises(NotFoundError):
        engine.vector_delete(77)


def test_euclidean_and_unknown_space(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector.knn(d, [0, 0], 2, "euclidean").collect()] == [(1, 0.0), (2, 5.0)]
    with pytest.raises(ValueError):
        vector.knn(d, [0, 0], 2, "manhattan")
    assert vector.knn(d, [0, 0], 1).first()["distance"] == 1.0
    assert [list(r[0]) for r in d.select(V.normalised(F.col("embedding"))).collect()] == [[0, 0], [0.6, 0.8]]


def test_batch_equals_single(spark):
    rows = [(i, [float((i * 8 + j) % 13) / 100 + 0.01 for j in range(8)]) for i in range(100)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = d.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for most in (1 << 20, 64):
        got = {}
        for r in vector.knn_batch(d, q, 5, most_bytes=most).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        for i, e in rows:
            if i % 25 == 0:
                assert [v for _, v in sorted(got[i])] == [r["vec_id"] for r in vector.knn(d, e, 5).collect()]


def test_graph(engine):
    u, v, t = engine.add_node("User", {"name": "a"}), engine.add_node("User"), engine.add_node("Topic", {"name": "x"})
    assert (u, v, t) == (1, 2, 3)
    engine.add_edge(u, t, "PREFERS", 0.9)
    engine.add_edge(v, t, "PREFERS", 0.5)
    assert engine.traverse("User", "PREFERS", "Topic").count() == 2
    assert engine.find_nodes("User").count() == 2
    assert [tuple(r) for r in engine.neighbors(u).collect()] == [(3, "PREFERS", 0.9)]
    assert engine.query("MATCH (t:Topic)<-[r:PREFERS]-(u:User) WHERE u.name = \"a\" RETURN t, u").collect() == [(3, 1)]
    with pytest.raises(NotFoundError):
        engine.add_edge(u, 999, "X")
    with pytest.raises(QuerySyntaxError):
        engine.query("MATCH (a:User) RETURN zzz")
    engine.remove_node(u)
    assert engine.tables["nodes"].count() == 2 and engine.tables["edges"].count() == 1
    assert engine.query("DELETE (x:User)").first()["value"] == 1
    assert engine.tables["edges"].count() == 0
    assert engine.query("SELECT count(*) AS n FROM {nodes}").first()["n"] == 1


def test_key_value(engine):
    engine.kv_set("k", b"one")
    engine.kv_set("k", b"two")
    assert engine.kv_get("k") == b"two" and engine.kv_count() == 1
    engine.kv_delete("k")
    assert engine.kv_get("k") is None
    engine.kv_set("t", b"v", 1)
    later = F.timestamp_micros(F.lit((time.time_ns() // 1000) + 2_000_000))
    assert engine.kv_get("t", later) is None
    with pytest.raises(LimitError):
        engine.kv_set("x" * 600, b"")
    assert engine.command("KVSET a b") == "OK" and engine.command("KVGET a") == "b" and engine.command("PING") == "PONG"


def test_tokenizers_and_embeddings(spark):
    d = spark.createDataFrame([(1, "Hello, World! This is ABC."), (2, ""), (3, "é ab"), (4, "Hello World! This is TEST.")], "doc_id long, text string")
    got = {r[0]: (list(r[1]), list(r[2])) for r in d.select("doc_id", T.embedding_tokens(F.col("text")), T.index_terms(F.col("text"))).collect()}
    assert got[1][0] == ["hello", ",", "world", "!", "this", "is", "abc", "."]
    assert {"hello", "world", "test"} <= set(got[4][1]) and got[3][1] == ["é", "ab"] and got[2] == ([], [])
    e = {r[0]: list(r[1]) for r in d.select("doc_id", T.embed_text(F.col("text"))).collect()}
    assert len(e[1]) == 384 and abs(math.hypot(*e[1]) - 1) < 0.01 and set(e[2]) == {0.0}

    def slow(tokens):
        ids, out = {}, [0.0] * 384
        for t in tokens:
            ids.setdefault(t, len(ids) + 1)
        for t, i in ids.items():
            w = tokens.count(t) / max(map(tokens.count, ids)) * (math.log((len(ids) + 1) / (i + 1)) + 1)
            for j in range(384):
                h = 0xCBF29CE484222325
                for b in f"{t}_{j}".encode():
                    h = ((h ^ b) * 0x100000001B3) % 2**64
                out[j] += ((h % 2000) / 1000 - 1) * w
        size = math.hypot(*out)
        return [x / size for x in out]

    assert max(abs(a - b) for a, b in zip(e[1], slow(got[1][0]), strict=True)) < 1e-5
    b = T.byte_embedding("ab")
    assert len(b) == 128 and abs(math.hypot(*b) - 1) < 1e-6 and b[1] > b[0]


@pytest.mark.parametrize("vocabulary", [4, 8, 100])
def test_bpe_tokens(spark, vocabulary):
    tokens = ["a", "ab", "abc", "hello", "é", "ééé", "longerword"]

    def slow(t):
        return [t] if len(t.encode()) <= 2 or len(t) - 1 <= vocabulary // 2 else [t[i : i + 2] for i in range(0, len(t), 2)]

    d = spark.createDataFrame([(tokens,)], "t array<string>")
    assert list(d.select(T.bpe_tokens(F.col("t"), vocabulary)).first()[0]) == [x for t in tokens for x in slow(t)]


def test_text_search(spark):
    d = spark.createDataFrame([(1, "the lazy dog"), (2, "a brown fox"), (3, "the quick brown fox and the quick dog")], "doc_id long, text string")
    p = text_index.postings(d)
    assert 3 in [r["doc_id"] for r in text_index.search(p, 3, "quick dog", 3).collect()]
    assert text_index.search(p, 3, "...", 3).count() == 0


def test_ordered_index(spark, tmp_path):
    d = spark.createDataFrame([(f"key_{i:03}", i) for i in range(20)] + [("key_001", 99), ("key_001", 7)], "key string, value_id long")
    assert list(ordered_index.lookup(d, "key_001").first()["value_ids"]) == [1, 7, 99]
    assert [r["key"] for r in ordered_index.range_scan(d, "key_005", "key_010").collect()] == [f"key_{i:03}" for i in range(5, 11)]
    assert ordered_index.delete(d, d.filter("value_id = 99")).count() == 21
    ordered_index.rebuild(d, str(tmp_path / "i"), 2)
    assert ordered_index.fragmentation(spark.read.parquet(str(tmp_path / "i")), 11).first()["files"] <= 2


def test_ranker(spark):
    as_of = F.lit("2024-03-01 00:00:00").cast("timestamp")
    d = spark.createDataFrame([("2024-02-15 00:00:00",), ("2024-01-01 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    half, none, never = [r[0] for r in d.select(retrieval.recency(F.col("t"), as_of, 30)).collect()]
    assert 0.4 < half < 0.6 and none == 0 and never == 0


def test_strict_merge_and_summary(spark):
    d = spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0), (3, 1, 5.0), (4, 2, 7.0)], "seq long, vec_id long, score double")
    assert {r[0]: r[1] for r in retrieval.merge_weighted_strict(d).collect()} == {1: 3.5, 2: 7.0}
    m = spark.createDataFrame([(1, i, "user", "x" * 100) for i in range(6)], "conv_id long, turn long, role string, text string")
    out = retrieval.context_summarised(m, 80).orderBy("turn").collect()
    assert out[0]["role"] == "system" and out[0]["text"].startswith("[Summarized: ") and sum(r["tokens"] for r in out) <= 80
    assert [r["turn"] for r in retrieval.context_window(m, 60).orderBy("turn").collect()] == [4, 5]
    assert [r["turn"] for r in retrieval.context_window(m, 1).collect()] == [5]


def test_context_of_a_long_conversation(spark):
    rows = [(1, t, "user", "x" * (t % 90)) for t in range(3000)] + [(2, None, "user", "only"), (None, 5, "user", "y" * 5000), (3, 1000, "user", "a"), (3, 2, "user", "b"), (3, None, "user", "c")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = set()
    for conv in {r[0] for r in rows}:
        used = 0
        for i, r in enumerate(sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1], reverse=True)):
            used += len(r[3]) // 4 + 1
            if used <= 3000 or not i:
                want.add(r[:2])
    for span in (1, 7, 256):
        assert {tuple(r)[:2] for r in retrieval.context_window(d, 3000, span).collect()} == want
    assert retrieval.context_window(d.limit(0), 9).count() == 0


def test_sketches_find_the_nearest_with_few_distances(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").cache()
    q = d.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vector.knn_sketched(vector.sketched(d, 64), q, 10).collect()
    exact = {(r["query_id"], r["vec_id"]) for r in vector.knn_batch(d, q, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in near}
    assert len(found) == len(near) == len(exact) and len(found & exact) >= 0.9 * len(exact)
    assert max(r["compared"] for r in near) <= d.count() / 3
    assert vector.knn_sketched(vector.sketched(d, 64), q.limit(0), 10).count() == 0


def test_near_ties_are_ordered_by_distance(spark):
    rows = [(1, [1.0, 2e-4]), (2, [1.0, 1e-4]), (3, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vector.knn(d, [1, 0], 3).collect()] == [3, 2, 1]
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["vec_id"] for r in vector.knn_batch(d, q, 3).orderBy("rank").collect()] == [3, 2, 1]


def test_upsert_keeps_the_last_of_a_batch(spark):
    schema = "vec_id long, embedding array<float>, created timestamp, deleted boolean"
    at = [datetime.datetime(2024, 1, i) for i in range(1, 4)]
    table = spark.createDataFrame([(1, [0.0], at[0], True), (2, [0.5], at[0], False)], schema)
    rows = spark.createDataFrame([(1, [3.0], at[2], False), (1, [2.0], at[1], False), (3, [1.0], None, False)], schema)
    out = vector.upsert(table, rows, Config(dimension=1)).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["embedding"], r["deleted"]) for r in out] == [(1, [3.0], False), (2, [0.5], False), (3, [1.0], False)]


ENTRY = "op string, layer string, entity_key string, payload string, seq long"


def test_log(spark, tmp_path):
    path = str(tmp_path / "wal")
    rows = spark.createDataFrame([("insert", "kv", "a", "1", 1), ("update", "kv", "a", "2", 2), ("insert", "kv", "b", "3", 3), ("delete", "kv", "b", None, 4)], ENTRY)
    assert log.last_lsn(spark, path) == 0 and log.replay(spark, path).count() == 0
    assert log.append(rows, path) == 4 and log.append(rows, path) == 8 and log.append(rows.limit(0), path) == 8
    assert log.append_entries(spark, path, [("insert", "kv", "c", "9")]) == 9
    back = log.replay(spark, path)
    assert sorted(r["lsn"] for r in back.collect()) == [*range(1, 10)]
    assert sorted((r["entity_key"], r["payload"]) for r in log.compacted(back).collect()) == [("a", "2"), ("c", "9")]
    assert log.replay(spark, path, after=8).count() == 1
    # A damaged entry is skipped, an unfinished batch is not seen.
    bad = spark.createDataFrame([(10, "insert", "kv", "c", "x", 1, 0)], log.SCHEMA + ", segment long")
    bad.write.partitionBy("segment").parquet(f"{path}/batch={10:020d}-{10:020d}-bad")
    rows.write.parquet(f"{path}/_new-unfinished")
    assert log.last_lsn(spark, path) == 10 and log.replay(spark, path).count() == 9
    assert log.rewrite(spark, path) == 9 - 3
    assert sorted(r["lsn"] for r in log.replay(spark, path).collect()) == [6, 8, 9] and log.last_lsn(spark, path) == 10


def test_every_entry_gets_its_own_number(spark, tmp_path):
    """Wide rows over many partitions, with coalescing, keep their count, order and numbers."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        wide = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(4)])
        rows = spark.range(0, 200_000, 1, 16).select(F.lit("insert").alias("op"), F.lit("kv").alias("layer"), F.col("id").cast("string").alias("entity_key"), wide.alias("payload"), (F.col("id") * 7919 % 200_003).alias("seq"))
        path = str(tmp_path / "wal")
        assert log.append(rows, path, segment_entries=50_000) == 200_000
        back = log.replay(spark, path)
        assert back.agg(F.count("*"), F.count_distinct("lsn"), F.min("lsn"), F.max("lsn")).first() == (200_000, 200_000, 1, 200_000)
        seq = back.join(rows.select("entity_key", "seq"), "entity_key").select("lsn", "seq", F.lag("seq").over(Window.orderBy("lsn")).alias("before"))
        assert seq.filter("before >= seq").count() == 0
        assert log.truncate(spark, path, 2, 100_000, 50_000) == 2  # numbers start at 1, so the fifth segment has one entry
        assert back.sparkSession.read.parquet(path).count() < 200_000 and log.last_lsn(spark, path) == 200_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_ranks_over_ranges(spark):
    d = spark.range(1000).select((F.col("id") % 10).alias("x"), "id").repartition(7)
    got = numbered(d, F.desc("x"), "id", start=5).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [*range(6, 1006)] and [(r["x"], r["id"]) for r in got] == sorted(((i % 10, i) for i in range(1000)), key=lambda p: (-p[0], p[1]))
    assert numbered(d.limit(0), "id").count() == 0


def test_log_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "wal")
    log.append_entries(spark, path, [("insert", "kv", str(i), None) for i in range(5)])
    assert jobs.drain(log.tail(spark, path), str(tmp_path / "one"), "append").count() == 5
    log.append_entries(spark, path, [("insert", "kv", "x", "y")])
    assert jobs.drain(log.tail(spark, path), str(tmp_path / "one"), "append").count() == 6


def test_reopened_engine_has_what_was_logged(spark, tmp_path):
    root = str(tmp_path)
    engine = Engine(spark, Config(dimension=2), root)
    a, b = engine.add_node("User", {"name": "a"}), engine.add_node("User")
    engine.add_edge(a, b, "KNOWS", 0.5)
    engine.vector_insert(1, [1, 0], b"m")
    engine.kv_set("k", b"one")
    engine.save()
    engine.vector_insert(2, [0, 1])
    engine.vector_delete(1)
    engine.kv_set("k", b"two")
    engine.kv_set("t", b"gone", 1)
    c = engine.add_node("User")
    engine.add_edge(c, a, "KNOWS")
    engine.add_message(7, "user", "hello")
    engine.record_access(2)
    engine.remove_node(b)
    engine.add_rows("vectors", spark.createDataFrame([(5, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    for _ in range(2):
        again = Engine.open(spark, root, engine.config)
        assert sorted(r["node_id"] for r in again.find_nodes("User").collect()) == [a, c] and again.get_node(a)["properties"] == {"name": "a"}
        assert [tuple(r) for r in again.tables["edges"].select("from_node", "to_node", "weight").collect()] == [(c, a, 1.0)]
        assert sorted(r["vec_id"] for r in again.vector_search([1, 0]).collect()) == [2, 5]
        assert again.kv_get("k") == b"two" and again.kv_get("t", F.timestamp_micros(F.lit(time.time_ns() // 1000 + 2_000_000))) is None
        assert again.context_text(7) == "user: hello" and again.tables["accesses"].count() == 1
    assert again.add_node("User") == c + 1
    assert again.collect_garbage()["vectors"] == 0 and again.save()
    last = Engine.open(spark, root, engine.config)
    assert last.node_count() == 3 and last.vector_count() == 2


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    engine = Engine(spark, Config(dimension=4, max_snapshots=3), root)
    engine.add_node("User", {"name": "a"})
    for i in range(5):
        engine.save(f"2024-01-0{i + 1}")
    listed = engine.snapshots().collect()
    assert [r["created"] for r in listed] == ["2024-01-05", "2024-01-04", "2024-01-03"]
    again = Engine.open(spark, root, engine.config)
    assert again.get_node(1)["properties"] == {"name": "a"}
    with pytest.raises(NotFoundError):
        snapshot.restore(spark, root, "missing")
    with pytest.raises(NotFoundError):
        snapshot.latest(spark, str(tmp_path / "none"))


def test_compaction_of_small_files(spark, tmp_path):
    for _ in range(3):
        files.write_rows(spark.range(10), str(tmp_path / "a"))
    assert files.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"), 1 << 20) == 1
    assert spark.read.parquet(str(tmp_path / "b")).count() == 30


def test_engine_queries_of_all_kinds(spark):
    engine = Engine(spark, Config(dimension=32))
    engine.add_node("User", {"name": "from nodes"}), engine.add_node("Topic")
    assert engine.query("SELECT count(*) AS n FROM nodes WHERE properties['name'] = 'from nodes'").first()["n"] == 1
    assert engine.query("select a.label from nodes a join nodes b on a.node_id < b.node_id, Nodes c where c.node_id = 1").first()["label"] == "User"
    texts = spark.createDataFrame([(1, "the quick brown fox"), (2, "an unrelated remark"), (3, "a lazy dog")], "vec_id long, text string")
    engine.add_rows("vectors", engine.embed_texts(texts).select("vec_id", "embedding"))
    assert engine.query("quick brown fox").first()["vec_id"] == 1
    found = engine.process_query("brown fox", k=2)
    assert found.count() == 2 and found.first()["vec_id"] == 1 and engine.tables["accesses"].count() == 2
    assert {r["vec_id"] for r in engine.vector_search_near(engine.vector_index(), engine.embed("lazy dog"), 3).collect()} >= {3}
    own = Engine(spark, Config(dimension=2), embedder=lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")))
    own.add_rows("vectors", own.embed_texts(texts).select("vec_id", "embedding"))
    assert own.embed("four") == [4.0, 1.0] and own.query("x" * 19).first()["vec_id"] in (1, 2)


def test_contexts_of_the_engine(spark):
    engine = Engine(spark, Config(max_context_tokens=40))
    for i in range(5):
        engine.add_message(1, "user", f"{i}" * 60)
    assert [r["turn"] for r in engine.context(1).orderBy("turn").collect()] == [4, 5] and engine.context_count(1) == 2
    assert engine.context(1, summarise=True).orderBy("turn").first()["role"] in ("system", "user")
    engine.clear_context(1)
    assert engine.context_count(1) == 0 and engine.context_text(1) == ""
    engine.add_message(1, "user", "new")
    assert engine.context_text(1) == "user: new"


def test_promotion_and_stored_tiers(spark, tmp_path):
    engine = Engine(spark, Config(hot_capacity=1, warm_capacity=1))
    for k in ("a/x", "b", "c"):
        engine.kv_set(k, k.encode())
    tier = lambda: {r["k"]: r["tier"] for r in engine.kv_tiers().collect()}
    assert tier() == {"a/x": "cold", "b": "warm", "c": "hot"} and [r["k"] for r in engine.warm_keys().collect()] == ["b"]
    kv.store_tiers(engine.kv_tiers(), str(tmp_path / "t"))
    now = F.timestamp_micros(F.lit(time.time_ns() // 1000))
    assert [tuple(r) for r in kv.tiered_get(spark, str(tmp_path / "t"), "a/x", now).collect()] == [("a/x", b"a/x", "cold")]
    assert spark.read.parquet(str(tmp_path / "t")).filter("tier = 'cold'").first()["name"] == "a_x"
    engine.promote("b")
    assert tier() == {"a/x": "cold", "b": "hot", "c": "warm"} and [r["k"] for r in engine.hot_keys().collect()] == ["b"]
    with pytest.raises(NotFoundError):
        engine.promote("zzz")


def test_stored_indexes(spark, tmp_path):
    engine = Engine(spark, root=str(tmp_path))
    docs = spark.createDataFrame([(1, 1, "the quick fox"), (1, 2, "the slow fox"), (2, 1, "a dog")], "doc_id long, v long, text string")
    engine.index_documents(docs, version="v")
    for _ in range(2):
        assert engine.search_documents("quick").count() == 0 and [r["doc_id"] for r in engine.search_documents("slow dog").collect()] == [1, 2]
        engine.rebuild_indexes()
    engine.index_documents(spark.createDataFrame([(2, "slow slow")], "doc_id long, text string"))
    assert [r["doc_id"] for r in engine.search_documents("slow").collect()] == [1, 2] and engine.search_documents("dog").count() == 0
    assert engine.indexes.postings.count() == 2 and engine.indexes.postings.vocabulary_size() == 3
    index = engine.indexes.ordered("names")
    index.insert(spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("b", 2)], "key string, value_id long"))
    index.delete(spark.createDataFrame([("b", 1), ("zz", 9)], "key string, value_id long"))
    assert [tuple(r) for r in index.range_scan("a", "b").collect()] == [("a", 1), ("b", 2)] and index.lookup("b").count() == 1 and index.count() == 2
    assert index.fragmentation(1000) > 0.9 and engine.indexes.names() == ["names"]
    index.rebuild()
    assert [tuple(r) for r in index.pairs().orderBy("key").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        engine.indexes.ordered("../x")
    # Documents with several rows count once by version.
    assert {(r["term"], r["freq"]) for r in text_index.postings(docs, "v").filter("doc_id = 1").collect()} == {("the", 1), ("slow", 1), ("fox", 1)}


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    assert main(["--init", root]) == 0 and main([root, "GADD", "User name=a"], spark) == 0 and main([root, "KVSET", "k v"], spark) == 0
    assert main([root, "--snapshot"], spark) == 0 and main([root, "--replay-wal"], spark) == 0
    capsys.readouterr()
    assert main([root, "QUERY", "MATCH (n:User) RETURN n.name AS name"], spark) == 0 and capsys.readouterr().out.strip() == "a"
    assert main([root, "--list-snapshots"], spark) == 0
    first = capsys.readouterr().out.split("\t")[0]
    assert main([root, "GADD", "User"], spark) == 0 and main([root, "--restore", first], spark) == 0 and main([root, "--gc"], spark) == 0
    capsys.readouterr()
    assert main([root, "QUERY", "SELECT count(*) FROM nodes"], spark) == 0 and capsys.readouterr().out.strip() == "1"
    assert main([root], spark) == 2


def test_keys_expire_in_a_stream(spark, tmp_path):
    rows = [("a", "1", 10, "2024-01-01 00:00:00", 1, "set"), ("a", "2", 3600, "2024-01-01 00:00:05", 2, "set"), ("b", "3", 10, "2024-01-01 00:00:00", 3, "set"), ("c", "4", 0, "2024-01-01 00:05:00", 4, "set")]
    schema = "k string, v string, ttl int, ts string, seq long, op string"
    d = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    d(rows).write.parquet(str(tmp_path / "m"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.kv_live(spark.readStream.schema(d(rows).schema).parquet(str(tmp_path / "m")), "1 second")
        got = {(r["k"], r["op"], r["v"]) for r in jobs.drain(out, str(tmp_path / "c"), "update").collect()}
        assert got == {("a", "set", "2"), ("b", "set", "3"), ("c", "set", "4"), ("b", "expire", None)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stateful_streams(spark, tmp_path):
    m = spark.createDataFrame([(c, i, "user", "x" * 100) for c in (1, 2) for i in range(4)], "conv_id long, turn long, role string, text string")
    m.write.parquet(str(tmp_path / "m"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.contexts(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), 60)
        got = jobs.drain(out, str(tmp_path / "c"), "update").collect()
        assert sorted((r["conv_id"], r["turn"]) for r in got) == [(1, 2), (1, 3), (2, 2), (2, 3)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_garbage(spark):
    engine = Engine(spark, Config(dimension=2))
    engine.vector_insert(1, [1, 0])
    engine.vector_delete(1)
    assert engine.collect_garbage() == {"kv_log": 0, "vectors": 1}
