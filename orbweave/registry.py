"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import text as T
from .functions import vectors as V
from .operators import graph, kv, ordered_index, retrieval, text_index, vector
from .plans.parser import parse
from .plans.resolver import resolve
from .sources import log, snapshot, tables
from .sources.index_store import IndexManager
from .sources.shared import scratch
from .streaming import jobs

AS_OF = "2024-01-31 00:00:00"
SEARCH = "the data of information"
BUDGET = 300
CONFIG = Config(dimension=64, hot_capacity=100, warm_capacity=200)
QUERIES: dict = {}
SQL: dict[str, str] = {}

VIEWS = {"nodes": tables.NODES_SQL, "edges": tables.EDGES_SQL, "kv_log": tables.KV_SQL, "access_log": tables.ACCESS_SQL, "wal": tables.WAL_SQL}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query and its SQL, which may use the named views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ctes = [f"{v} as ({VIEWS[v]})" for v in views]
            SQL[name] = f"with {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(tables.read(spark, d, "embeddings").orderBy("vec_id").first()["embedding"])


def match(spark: SparkSession, d: str, text: str, strict: bool = False) -> DataFrame:
    return resolve(parse(text, strict), tables.nodes(spark, d), tables.edges(spark, d))


# Graph

query("graph_nodes_by_label", "select node_id, label, name from nodes where label = 'Supplier'", "nodes")(
    lambda s, d: graph.nodes_by_label(tables.nodes(s, d), "Supplier").select("node_id", "label", F.col("properties")["name"].alias("name"))
)
query(
    "graph_traverse_placed",
    "select a.node_id as from_id, b.node_id as to_id, weight from edges e join nodes a on a.node_id = e.from_node join nodes b on b.node_id = e.to_node where a.label = 'Customer' and relation = 'PLACED' and b.label = 'Purchase'",
    "nodes", "edges",
)(lambda s, d: graph.traverse(tables.nodes(s, d), tables.edges(s, d), "Customer", "PLACED", "Purchase"))
query("graph_neighbors", "select to_node, relation, weight from edges where from_node = 11 and relation = 'SUPPLIES'", "edges")(lambda s, d: graph.neighbors(tables.edges(s, d), 11, "SUPPLIES"))
query("graph_edge_integrity", "select from_node, to_node, relation, weight from edges e where exists (select 1 from nodes n where n.node_id = e.from_node and n.label <> 'Part') and exists (select 1 from nodes n where n.node_id = e.to_node and n.label <> 'Part')", "nodes", "edges")(
    lambda s, d: graph.edges_with_ends(tables.nodes(s, d).filter("label <> 'Part'"), tables.edges(s, d))
)
query("graph_dangling_edges", "select from_node, to_node, relation, weight from edges e where not exists (select 1 from nodes n where n.node_id = e.from_node and n.label <> 'Part') or not exists (select 1 from nodes n where n.node_id = e.to_node and n.label <> 'Part')", "nodes", "edges")(
    lambda s, d: graph.dangling_edges(tables.nodes(s, d).filter("label <> 'Part'"), tables.edges(s, d))
)

PAIR = "from edges e join nodes a on a.node_id = e.from_node join nodes b on b.node_id = e.to_node"
for _name, _text, _sql, *_views in [
    ("graph_match_where", "MATCH (c:Customer)-[p:PLACED]->(o:Purchase) WHERE p.weight > 400000 AND c.grp = \"BUILDING\" RETURN c, o, p.weight AS weight", f"select a.node_id as c, b.node_id as o, e.weight {PAIR} where a.label = 'Customer' and relation = 'PLACED' and b.label = 'Purchase' and weight > 400000 and a.grp = 'BUILDING'", "nodes", "edges"),
    ("graph_match_or", "MATCH (c:Customer)-[p:PLACED]->(o:Purchase) WHERE p.weight > 450000 OR c.grp = \"AUTOMOBILE\" AND o.grp = \"1-URGENT\" RETURN c, o, p.weight AS weight", f"select a.node_id as c, b.node_id as o, e.weight {PAIR} where a.label = 'Customer' and relation = 'PLACED' and b.label = 'Purchase' and (weight > 450000 or (a.grp = 'AUTOMOBILE' and b.grp = '1-URGENT'))", "nodes", "edges"),
    ("graph_match_lte", "MATCH (o:Purchase)-[l:CONTAINS]->(p:Part) WHERE l.weight <= 2 AND p.grp >= \"Brand#5\" RETURN o, p, l.weight AS weight", f"select a.node_id as o, b.node_id as p, e.weight {PAIR} where a.label = 'Purchase' and relation = 'CONTAINS' and b.label = 'Part' and weight <= 2 and b.grp >= 'Brand#5'", "nodes", "edges"),
    ("graph_match_backward", "MATCH (p:Part)<-[l:SUPPLIES]-(s:Supplier) WHERE l.weight > 80000 RETURN p, s, l.weight AS weight", f"select b.node_id as p, a.node_id as s, e.weight {PAIR} where b.label = 'Part' and relation = 'SUPPLIES' and a.label = 'Supplier' and weight > 80000", "nodes", "edges"),
    ("graph_match_undirected", "MATCH (a:Nation)-[r:]-(b) RETURN a, b, r.relation AS relation", f"select a.node_id as a, b.node_id as b, relation {PAIR} where a.label = 'Nation' union all select b.node_id, a.node_id, relation {PAIR} where b.label = 'Nation'", "nodes", "edges"),
    ("graph_match_node_only", "MATCH (n:Nation) RETURN n.node_id AS id, n.name AS name", "select node_id as id, name from nodes where label = 'Nation'", "nodes"),
    ("graph_match_return_props", "MATCH (s:Supplier)-[r:BASED_IN]->(n:Nation) RETURN s.name, n.name AS nation, r", f"select a.name as s_name, b.name as nation, relation as r {PAIR} where a.label = 'Supplier' and relation = 'BASED_IN' and b.label = 'Nation'", "nodes", "edges"),
    ("graph_match_order_limit", "MATCH (c:Customer)-[p:PLACED]->(o:Purchase) WHERE p.weight > 100000 RETURN c, o, p.weight AS weight ORDER BY weight DESC LIMIT 10", f"select a.node_id as c, b.node_id as o, e.weight {PAIR} where a.label = 'Customer' and relation = 'PLACED' and b.label = 'Purchase' and weight > 100000 order by weight desc, c, o limit 10", "nodes", "edges"),
    ("graph_match_star", "MATCH (n:Nation)->(r:Region)", f"select a.node_id as from_id, b.node_id as to_id, e.weight {PAIR} where a.label = 'Nation' and b.label = 'Region'", "nodes", "edges"),
]:
    query(_name, _sql, *_views)(lambda s, d, _text=_text: match(s, d, _text))

query("graph_match_strict_logic", f"select a.node_id as c, b.node_id as o {PAIR} where a.label = 'Customer' and relation = 'PLACED' and b.label = 'Purchase' and (weight > 450000 and (a.grp = 'BUILDING' or b.grp = '5-LOW'))", "nodes", "edges")(
    lambda s, d: match(s, d, "MATCH (c:Customer)-[p:PLACED]->(o:Purchase) WHERE p.weight > 450000 AND c.grp = \"BUILDING\" OR o.grp = \"5-LOW\" RETURN c, o", True)
)


def _engine(s: SparkSession, d: str):
    from .session import Engine

    return Engine(s, CONFIG).attach("nodes", tables.nodes(s, d)).attach("edges", tables.edges(s, d))


@query("graph_insert_then_match", "select max(node_id) + 1 as id, 'Atlantis' as name from nodes", "nodes")
def _insert(s, d):
    engine = _engine(s, d)
    engine.query('INSERT (Nation {name: "Atlantis", grp: "x"})')
    return engine.query('MATCH (n:Nation) WHERE n.name = "Atlantis" RETURN n.node_id AS id, n.name AS name')


@query("graph_delete_cascade", "select from_node, to_node, relation, weight from edges e where from_node not in (select node_id from nodes where label = 'Supplier') and to_node not in (select node_id from nodes where label = 'Supplier')", "nodes", "edges")
def _delete(s, d):
    engine = _engine(s, d)
    engine.query("DELETE (x:Supplier)")
    return engine.tables["edges"].select("from_node", "to_node", "relation", "weight")


query("graph_node_lookup", "select node_id, label, name from nodes where node_id = 10", "nodes")(
    lambda s, d: tables.nodes(s, d).filter("node_id = 10").select("node_id", "label", F.col("properties")["name"].alias("name"))
)


@query("select_over_tables", "select a.label, count(*) as n, max(e.weight) as most from edges e join nodes a on a.node_id = e.from_node, (select min(node_id) as low from nodes) x where a.node_id > x.low and a.name <> 'from nodes' group by a.label", "nodes", "edges")
def _select(s, d):
    text = "SELECT a.label, count(*) AS n, max(e.weight) AS most FROM edges e JOIN nodes a ON a.node_id = e.from_node, (SELECT min(node_id) AS low FROM nodes) x WHERE a.node_id > x.low AND a.properties['name'] <> 'from nodes' GROUP BY a.label"
    return _engine(s, d).query(text)


@query("stats_counts", "select 'nodes' as name, count(*) as n from nodes union all select 'edges', count(*) from edges union all select 'vectors', count(*) from embeddings union all select 'kv_log', count(*) from kv_log", "nodes", "edges", "kv_log")
def _stats(s, d):
    engine = _engine(s, d).attach("kv_log", tables.kv_log(s, d))
    return engine.attach("vectors", tables.read(s, d, "embeddings").withColumn("deleted", F.lit(False))).stats()


# Vectors

Q = "(select cast(embedding as double[]) as q from embeddings order by vec_id limit 1)"
COSINE = "1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)) + 1e-10)"
EUCLID = "list_distance(e, q)"
NEAR = f"(select vec_id, cast(embedding as double[]) as e, q, label from embeddings, {Q})"
query("knn_cosine_top10", f"select vec_id, round(distance, 6) as distance from (select vec_id, {COSINE} as distance from {NEAR} order by distance, vec_id limit 10)")(lambda s, d: vector.knn(tables.read(s, d, "embeddings"), first_vector(s, d), 10))
query("knn_euclidean_top10", f"select vec_id, round(distance, 6) as distance from (select vec_id, {EUCLID} as distance from {NEAR} order by distance, vec_id limit 10)")(lambda s, d: vector.knn(tables.read(s, d, "embeddings"), first_vector(s, d), 10, "euclidean"))
query("knn_filtered", f"select vec_id, round(distance, 6) as distance from (select vec_id, {COSINE} as distance from {NEAR} where label = 3 order by distance, vec_id limit 10)")(lambda s, d: vector.knn(tables.read(s, d, "embeddings"), first_vector(s, d), 10, where=F.col("label") == 3))
query("knn_with_tombstones", f"select vec_id, round(distance, 6) as distance from (select vec_id, {COSINE} as distance from {NEAR} where vec_id % 3 <> 0 order by distance, vec_id limit 10)")(
    lambda s, d: vector.knn(vector.delete(tables.read(s, d, "embeddings"), tables.read(s, d, "embeddings").filter("vec_id % 3 = 0")), first_vector(s, d), 10)
)
query(
    "knn_batch_top5",
    f"select query_id, vec_id, round(distance, 6) as distance, rank from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from (select a.vec_id as query_id, b.vec_id, {COSINE.replace('e, e', 'b.e, b.e').replace('e, q', 'b.e, a.q').replace('q, q', 'a.q, a.q')} as distance from (select vec_id, cast(embedding as double[]) as q from embeddings where vec_id % 100 = 0) a, (select vec_id, cast(embedding as double[]) as e from embeddings) b)) where rank <= 5",
)(lambda s, d: vector.knn_batch(tables.read(s, d, "embeddings"), tables.read(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5))
query("vector_upsert_last_wins", "select vec_id, case when vec_id % 10 = 0 then 99 else label end as label, round(case when vec_id % 10 = 0 then -1 else 1 end * cast(embedding[1] as double), 6) as first from embeddings")(
    lambda s, d: vector.upsert(
        tables.read(s, d, "embeddings"), tables.read(s, d, "embeddings").filter("vec_id % 10 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(99).alias("label")), CONFIG
    ).select("vec_id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))
)
query("vector_normalize", "select vec_id, i - 1 as at, round(e[i] / size, 6) as value from (select vec_id, cast(embedding as double[]) as e, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as size, unnest(range(1, len(embedding) + 1)) as i from embeddings)")(
    lambda s, d: tables.read(s, d, "embeddings").select("vec_id", F.posexplode(V.normalised(F.transform("embedding", lambda x: x * F.lit(4).cast("float")))).alias("at", "value")).select("vec_id", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))
)


@query("vector_upsert_batch", "select vec_id, i - 1 as at, round(case when vec_id % 10 = 0 then 4 else 1 end * cast(embedding[i] as double), 6) as value from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def _upsert(s, d):
    """Three rows of one id in a batch, of which the one created last counts."""
    table = tables.read(s, d, "embeddings").select("vec_id", "embedding")
    some = table.filter("vec_id % 10 = 0").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("times"))
    some = some.select("vec_id", F.transform("embedding", lambda x: (x * F.col("times")).cast("float")).alias("embedding"), F.timestamp_seconds("times").alias("created"))
    out = vector.upsert(table, some, CONFIG).select("vec_id", F.posexplode("embedding").alias("at", "value"))
    return out.select("vec_id", F.col("at").cast("long").alias("at"), F.round(F.col("value").cast("double"), 6).alias("value"))


def _hundredth(s, d):
    return tables.read(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


query("knn_ann_sketch")(lambda s, d: vector.knn_sketched(vector.sketched(tables.read(s, d, "embeddings"), CONFIG.dimension), _hundredth(s, d), 10))

# Text

TERMS = r"(select doc_id, regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') as term from (select doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) as w from documents))"
COUNTS = f"c as (select doc_id, term, count(*) as freq from {TERMS} where strlen(term) >= 2 group by all), p as (select term, doc_id, freq, freq / max(freq) over (partition by doc_id) as tf from c)"
IDF = "i as (select term, count(*) as df, ln((select count(*) from documents) / (count(*) + 1)) + 1 as idf from p group by term)"
query("tokenize_terms", f"with {COUNTS} select doc_id, term, freq from c")(lambda s, d: text_index.term_counts(tables.read(s, d, "documents")))
query("inverted_index_postings", f"with {COUNTS} select term, doc_id, freq, round(tf, 6) as tf from p")(lambda s, d: text_index.postings(tables.read(s, d, "documents")).withColumn("tf", F.round("tf", 6)))
query("term_idf", f"with {COUNTS}, {IDF} select term, df, round(idf, 6) as idf from i")(
    lambda s, d: text_index.idf(text_index.postings(tables.read(s, d, "documents")), tables.read(s, d, "documents").count()).withColumn("idf", F.round("idf", 6))
)
query("tfidf_search_top10", f"with {COUNTS}, {IDF} select doc_id, round(sum(tf * idf), 6) as score from p join i using (term) join (select unnest(['the', 'data', 'of', 'information']) as term) using (term) group by doc_id order by score desc, doc_id limit 10")(
    lambda s, d: text_index.search(text_index.postings_of(tables.read(s, d, "documents"), text_index.query_terms(s, SEARCH)), tables.read(s, d, "documents").count(), SEARCH, 10)
)
query("vocabulary_size", f"with {COUNTS} select count(distinct term) as terms from c")(lambda s, d: text_index.distinct_terms(text_index.postings(tables.read(s, d, "documents"))))

VERSIONS = f"(select doc_id, case when doc_id % 3 = 0 then 'again ' || text else text end as text from documents where doc_id % 7 <> 1)"


def _versions(s, d):
    """An index that saw every document, then a third of them anew, and lost a seventh."""
    index = IndexManager(s, scratch(s)).postings
    docs = tables.read(s, d, "documents").select("doc_id", "text")
    index.index(docs)
    index.index(docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("again "), "text")))
    index.delete(docs.filter("doc_id % 7 = 1"))
    return index


query("index_reindexed_postings", f"with {COUNTS.replace('from documents)', 'from ' + VERSIONS + ')')} select term, doc_id, freq, round(tf, 6) as tf from p")(lambda s, d: _versions(s, d).current().withColumn("tf", F.round("tf", 6)))


@query(
    "index_stored_search",
    f"with {COUNTS.replace('from documents)', 'from ' + VERSIONS + ')')}, {IDF.replace('from documents)', 'from ' + VERSIONS + ')')} select doc_id, round(sum(tf * idf), 6) as score from p join i using (term) join (select unnest(['the', 'data', 'of', 'again']) as term) using (term) group by doc_id order by score desc, doc_id limit 10",
)
def _stored_search(s, d):
    index = _versions(s, d)
    index.rebuild()
    return index.search("the data of again", 10)


WORDS = r"(select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([\p{L}\p{N}'']+|[^\s])') as ws from documents)"
query("embed_tokens", f"select doc_id, i - 1 as pos, ws[i] as token from (select *, unnest(range(1, len(ws) + 1)) as i from {WORDS})")(
    lambda s, d: tables.read(s, d, "documents").select("doc_id", F.posexplode(T.embedding_tokens(F.col("text"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
)
query("bpe_tokens", f"select doc_id, sum(case when strlen(w) <= 2 or length(w) - 1 <= 2 then 1 else ceil(length(w) / 2) end)::bigint as n from (select doc_id, unnest(ws) as w from {WORDS}) group by doc_id")(
    # A document without a token, or without a text, has no row.
    lambda s, d: tables.read(s, d, "documents").select("doc_id", F.size(T.bpe_tokens(T.embedding_tokens(F.col("text")), 4)).cast("long").alias("n")).filter("n > 0")
)
PIECES = "case when strlen(w) <= 2 or length(w) - 1 <= 2 then [w] else list_transform(range(1, length(w) + 1, 2), lambda j: w[j:j+1]) end"
query("bpe_pieces", f"select doc_id, i - 1 as pos, ps[i] as token from (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from (select doc_id, flatten(list_transform(ws, lambda w: {PIECES})) as ps from {WORDS}))")(
    lambda s, d: tables.read(s, d, "documents").select("doc_id", F.posexplode(T.bpe_tokens(T.embedding_tokens(F.col("text")), 4)).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
)
query("token_estimate", "select doc_id, strlen(text) // 4 + 1 as tokens from documents")(lambda s, d: tables.read(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens")))
query("text_shortened", "select doc_id, case when length(text) <= 50 then text else text[:50] || '...' end as short from documents")(lambda s, d: tables.read(s, d, "documents").select("doc_id", T.shortened(F.col("text")).alias("short")))
query("embed_local_384")(lambda s, d: tables.read(s, d, "documents").select("doc_id", T.embed_text(F.col("text")).alias("embedding")))
BYTES = "select doc_id, (i - 1) % 128 as slot, sum(('0x' || substr(h, 2 * i - 1, 2))::int) as v from (select doc_id, hex(encode(text)) as h, unnest(range(1, strlen(text) + 1)) as i from documents) group by all"
query("embed_bytes_128", f"select doc_id, slot, round(cast(cast(v / size as float) as double), 6) as value from (select *, sqrt(sum(v * v) over (partition by doc_id)) as size from ({BYTES}))")(
    lambda s, d: tables.read(s, d, "documents").select("doc_id", F.posexplode(T.embed_bytes(F.col("text"))).alias("slot", "value")).filter("value <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("value").cast("double"), 6).alias("value"))
)
SEEN = f"(select doc_id, ws[i] as token, i from (select *, unnest(range(1, len(ws) + 1)) as i from {WORDS}))"
query("vocab_ids", f"select doc_id, token, row_number() over (partition by doc_id order by i) as token_id from (select doc_id, token, min(i) as i from {SEEN} group by all)")(lambda s, d: text_index.document_vocabulary(tables.read(s, d, "documents")))
query("vocab_ids_corpus", f"select token, row_number() over (order by spot) as token_id from (select token, min((doc_id, i)) as spot from {SEEN} group by token)")(lambda s, d: text_index.corpus_vocabulary(tables.read(s, d, "documents")))

# Ordered index


def _index(s, d):
    return tables.read(s, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("value_id"))


KEYS = "(select c_mktsegment as key, c_custkey as value_id from customer)"
query("index_point_lookup", f"select key, unnest(list_sort(list(value_id))) as value_id from {KEYS} where key = 'BUILDING' group by key")(lambda s, d: ordered_index.lookup(_index(s, d), "BUILDING").select("key", F.explode("value_ids").alias("value_id")))
query("index_range_scan", f"select key, value_id from {KEYS} where key between 'BUILDING' and 'HOUSEHOLD'")(lambda s, d: ordered_index.range_scan(_index(s, d), "BUILDING", "HOUSEHOLD").select("key", F.explode("value_ids").alias("value_id")))
query("index_delete", f"select key, value_id from {KEYS} where value_id % 4 <> 1")(lambda s, d: ordered_index.delete(_index(s, d), _index(s, d).filter("value_id % 4 = 1")))


@query("index_rebuild", f"select key, value_id from {KEYS}")
def _rebuild(s, d):
    path = scratch(s)
    ordered_index.rebuild(_index(s, d), path)
    return s.read.parquet(path)


@query("index_stored_range", f"select key, value_id from {KEYS} where value_id % 5 <> 2 and key between 'BUILDING' and 'HOUSEHOLD' union all select 'FURNITURE', 7")
def _stored_range(s, d):
    """A stored index after inserts, deletes and a rebuild."""
    index = IndexManager(s, scratch(s)).ordered("segment")
    index.insert(_index(s, d))
    index.delete(_index(s, d).filter("value_id % 5 = 2"))
    index.insert(s.createDataFrame([("FURNITURE", 7), ("ZZZ", 7)], "key string, value_id long"))
    index.rebuild()
    return index.range_scan("BUILDING", "HOUSEHOLD")


# Key-value

LAST = f"last as (select * from (select *, row_number() over (partition by k order by ts desc, seq desc) as rn from kv_log) where rn = 1 and op <> 'delete')"
LIVE = f"(ttl = 0 or floor(epoch(timestamp '{AS_OF}')) - floor(epoch(ts)) < ttl)"
query("kv_current_state", f", {LAST} select k, v, ttl, seq from last where {LIVE}", "kv_log")(lambda s, d: kv.current(tables.kv_log(s, d), as_of()).select("k", "v", "ttl", "seq"))
query("kv_get", f", {LAST} select k, v from last where k = 'u6:view' and {LIVE}", "kv_log")(lambda s, d: kv.get(tables.kv_log(s, d), "u6:view", as_of()).select("k", "v"))
query("kv_ttl_expired", f", {LAST} select k, seq from last where not {LIVE}", "kv_log")(lambda s, d: kv.expired(tables.kv_log(s, d), as_of()).select("k", "seq"))
query("kv_tiers", f", {LAST} select k, rank, case when rank <= 100 then 'hot' when rank <= 300 then 'warm' else 'cold' end as tier from (select k, row_number() over (order by ts desc, k) as rank from last where {LIVE})", "kv_log")(
    lambda s, d: kv.tiers(tables.kv_log(s, d), as_of(), CONFIG).select("k", "rank", "tier")
)
query("kv_count", f", {LAST} select count(*) as n from last where {LIVE}", "kv_log")(lambda s, d: kv.current(tables.kv_log(s, d), as_of()).agg(F.count("*").alias("n")))
query("kv_purge", f", w as (select k as wk, max((ts, seq)) as m from kv_log group by k) select seq, k, op from kv_log join w on k = wk where floor(epoch(timestamp '{AS_OF}')) - floor(epoch(ts)) <= 7 * 86400 or (ts, seq) = m", "kv_log")(
    lambda s, d: kv.purge(tables.kv_log(s, d), as_of(), 7).select("seq", "k", "op")
)


@query("kv_cold_store", f", {LAST}, ranked as (select k, v, ttl, ts, row_number() over (order by greatest(ts, coalesce(t, ts)) desc, k) as rank from last left join (select 'u6:view' as tk, timestamp '2030-01-01 00:00:00' as t) on k = tk where {LIVE}) select k, v, replace(k, '/', '_') as name, case when rank <= 100 then 'hot' when rank <= 300 then 'warm' else 'cold' end as tier from ranked where rank > 100 or k = 'u6:view'", "kv_log")
def _cold(s, d):
    """Tiers after one key was promoted, stored and read again: the warm and cold ones, and that key."""
    path = scratch(s)
    touches = s.createDataFrame([("u6:view", "2030-01-01 00:00:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    log_ = tables.kv_log(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    kv.store_tiers(kv.tiers(log_, as_of(), CONFIG, touches), path)
    return s.read.parquet(path).filter("tier <> 'hot' or k = 'u6:view'").select("k", "v", "name", "tier")



# Log

WLAST = "select layer, entity_key, lsn, op, payload from (select *, row_number() over (partition by layer, entity_key order by lsn desc) as rn from wal) where rn = 1 and op <> 'delete'"
query("wal_compaction", WLAST, "wal")(lambda s, d: log.compacted(tables.wal(s, d)))


@query("wal_replay_state", WLAST, "wal")
def _replay(s, d):
    path = scratch(s)
    log.append(tables.wal(s, d).select("op", "layer", "entity_key", "payload", F.col("lsn").alias("seq")), path)
    return log.compacted(log.replay(s, path))


@query("wal_retained", "select lsn, op, entity_key from wal where lsn // 1000 > (select max(lsn) // 1000 from wal) - 3", "wal")
def _retained(s, d):
    return log.retained(tables.wal(s, d).withColumn("segment", F.floor(F.col("lsn") / 1000)), 3).select("lsn", "op", "entity_key")


@query("wal_truncated", "select lsn, op, entity_key from wal where lsn // 1000 > (select max(lsn) // 1000 from wal) - 3", "wal")
def _truncated(s, d):
    """Segments that a snapshot holds are removed from the stored log, the newest stay."""
    path = scratch(s)
    last = log.append(tables.wal(s, d).select("op", "layer", "entity_key", "payload", F.col("lsn").alias("seq")), path, segment_entries=1000)
    log.truncate(s, path, 3, last, 1000)
    return log.replay(s, path).select("lsn", "op", "entity_key")


@query("wal_all_entries", "select lsn, op, layer, entity_key, payload from wal", "wal")
def _entries(s, d):
    path = scratch(s)
    log.append(tables.wal(s, d).select("op", "layer", "entity_key", "payload", F.col("lsn").alias("seq")), path)
    return log.replay(s, path).drop("crc", "segment")


@query("wal_stream_tail", "select layer, count(*) as n, max(lsn) as last from wal group by layer", "wal")
def _tail(s, d):
    path = scratch(s)
    log.append(tables.wal(s, d).select("op", "layer", "entity_key", "payload", F.col("lsn").alias("seq")), path)
    return _drain(s, log.tail(s, path).groupBy("layer").agg(F.count("*").alias("n"), F.max("lsn").alias("last")))


@query("engine_reopened", "select key as id, value_id as seq, 'node' as kind from (select max(node_id) + 1 as key, 1 as value_id from nodes) union all select key, 1, 'edge' from (select max(node_id) + 1 as key from nodes)", "nodes")
def _reopened(s, d):
    """Changes after a snapshot come back from the log alone."""
    from .session import Engine

    root = scratch(s)
    engine = Engine(s, CONFIG, root).attach("nodes", tables.nodes(s, d))
    engine.save()
    node, gone = engine.add_node("New", {"name": "x"}), engine.add_node("New", {"name": "y"})
    engine.add_edge(node, gone, "LOST")
    engine.add_edge(node, node, "SELF")
    engine.remove_node(gone)
    engine.kv_set("k", b"v")
    again = Engine.open(s, root, CONFIG)
    assert again.kv_get("k") == b"v" and again.node_count() == engine.node_count()
    one = F.lit(1).cast("long").alias("seq")
    return again.find_nodes("New").select(F.col("node_id").alias("id"), one, F.lit("node").alias("kind")).union(again.tables["edges"].select("from_node", one, F.lit("edge")))


query("wal_crc")(lambda s, d: tables.wal(s, d).select("lsn", log.checksum().alias("crc")))

# Retrieval

query("memory_access_stats", "select vec_id, count(*) as accesses, max(ts) as last_access from access_log group by vec_id", "access_log")(lambda s, d: retrieval.access_stats(tables.access_log(s, d)))
query(
    "memory_rank_top10",
    f""", near as (select vec_id, round(raw, 6) as distance from (select vec_id, {COSINE} as raw from {NEAR} order by raw, vec_id limit 50)),
st as (select vec_id, count(*) as n, max(ts) as t from access_log group by vec_id)
select vec_id, distance, round((1 - distance) * 0.6 + case when t is null then 0 else greatest(0, 1 - (floor(epoch(timestamp '{AS_OF}')) - floor(epoch(t))) / 2592000) end * 0.25 + coalesce(n / (select max(n) from st), 0) * 0.15, 6) as score
from near left join st using (vec_id) order by score desc, vec_id limit 10""",
    "access_log",
)(lambda s, d: retrieval.memory_rank(tables.read(s, d, "embeddings"), tables.access_log(s, d), first_vector(s, d), as_of(), CONFIG).select("vec_id", "distance", "score").limit(10))


def _lists(s, d, k=50):
    e = tables.read(s, d, "embeddings")
    q = first_vector(s, d)
    return [vector.knn(e, x, k).select("vec_id", F.col("distance").alias("score")) for x in (q, [-x if i % 2 else x for i, x in enumerate(q)])]


def _two(k):
    other = NEAR.replace(Q, Q2)
    lists = [f"select vec_id, round(raw, 6) as score from (select vec_id, {COSINE} as raw from {n} order by raw, vec_id limit {k})" for n in (NEAR, other)]
    return f"with l1 as ({lists[0]}), l2 as ({lists[1]})"


Q2 = "(select list_transform(range(1, 65), lambda i: case when i % 2 = 0 then -1 else 1 end * cast(embedding[i] as double)) as q from embeddings order by vec_id limit 1)"
query("merge_union", f"{_two(50)} select * from l1 union all select * from l2")(lambda s, d: retrieval.merge_union(_lists(s, d)))
query("merge_intersection", f"{_two(300)} select * from l1 where vec_id in (select vec_id from l2)")(lambda s, d: retrieval.merge_intersection(_lists(s, d, 300)))
query("merge_weighted", f"{_two(50)} select vec_id, round(avg(score), 6) as score from (select * from l1 union all select * from l2) group by vec_id")(lambda s, d: retrieval.merge_weighted(_lists(s, d)))
query("merge_weighted_strict", f"{_two(50)} select vec_id, round(case when l1.score is null then l2.score when l2.score is null then l1.score else (l1.score + l2.score) / 2 end, 6) as score from l1 full join l2 using (vec_id)")(
    lambda s, d: retrieval.merge_weighted_strict(retrieval.merge_union([x.withColumn("seq", F.lit(i)) for i, x in enumerate(_lists(s, d))]))
)

TOKENS = "m as (select *, strlen(text) // 4 + 1 as tokens from conversations)"
query(
    "context_window",
    f"with {TOKENS} select conv_id, turn, tokens from (select *, sum(tokens) over (partition by conv_id order by turn desc) as used, row_number() over (partition by conv_id order by turn desc) as back from m) where used <= {BUDGET} or back = 1",
)(lambda s, d: retrieval.context_window(tables.read(s, d, "conversations"), BUDGET).select("conv_id", "turn", "tokens"))
query(
    "context_window_strict",
    f"""with recursive {TOKENS}, o as (select *, row_number() over (partition by conv_id order by turn) as i from m),
f as (select conv_id, i, tokens as total, i as start from o where i = 1 union all
 select o.conv_id, o.i, case when f.total + o.tokens > {BUDGET} then o.tokens else f.total + o.tokens end, case when f.total + o.tokens > {BUDGET} then o.i else f.start end from f join o on o.conv_id = f.conv_id and o.i = f.i + 1),
z as (select conv_id, arg_max(start, i) as start from f group by conv_id)
select o.conv_id, turn, tokens from o join z on o.conv_id = z.conv_id where o.i >= z.start""",
)(lambda s, d: retrieval.context_window_strict(tables.read(s, d, "conversations"), BUDGET).select("conv_id", "turn", "tokens"))
query("context_text", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as context from conversations group by conv_id")(lambda s, d: retrieval.context_text(tables.read(s, d, "conversations")))
SHORT = "case when length({0}) <= 50 then {0} else {0}[:50] || '...' end"
_SUMMARY = f"'[Summarized: ' || {SHORT.format('f.text')} || ' + ' || {SHORT.format('o.text')} || ']'"
query(
    "context_summarised",
    f"""with recursive {TOKENS}, o as (select *, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n, sum(tokens) over (partition by conv_id) as used from m),
f as (select conv_id, turn, role, text, tokens, i, n as left_, used from o where i = 1 union all
 select conv_id, case when left_ > 2 then turn else ot end, case when left_ > 2 then 'system' else orole end, case when left_ > 2 then s else otext end, case when left_ > 2 then strlen(s) // 4 + 1 else otok end, i, left_ - 1,
  used - tokens - case when left_ > 2 then otok - (strlen(s) // 4 + 1) else 0 end
 from (select f.conv_id, f.turn, o.turn as ot, o.role as orole, o.text as otext, o.tokens as otok, o.i, f.left_, f.used, f.tokens, {_SUMMARY} as s from f join o on o.conv_id = f.conv_id and o.i = f.i + 1 where f.used > {BUDGET} and f.left_ > 1)),
z as (select conv_id, max(i) as i from f group by conv_id)
select f.conv_id, f.turn, f.role, f.text, f.tokens from f join z using (conv_id, i) union all select o.conv_id, o.turn, o.role, o.text, o.tokens from o join z on o.conv_id = z.conv_id and o.i > z.i""",
)(lambda s, d: retrieval.context_summarised(tables.read(s, d, "conversations"), BUDGET))
query("context_lines", "select conv_id, turn, role || ': ' || text as line from conversations")(lambda s, d: retrieval.context_lines(tables.read(s, d, "conversations")))

# Snapshots


@query("snapshot_roundtrip", "select node_id as a, cast(-1 as bigint) as b, label as what, name as more from nodes union all select from_node, to_node, relation, cast(weight as varchar) from (select from_node, to_node, relation, cast(weight * 100 as bigint) as weight from edges)", "nodes", "edges")
def _roundtrip(s, d):
    root = scratch(s)
    name = snapshot.create(s, root, {"nodes": tables.nodes(s, d), "edges": tables.edges(s, d)}, AS_OF)
    back = snapshot.restore(s, root, name)
    nodes = back["nodes"].select(F.col("node_id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("label").alias("what"), F.col("properties")["name"].alias("more"))
    return nodes.union(back["edges"].select("from_node", "to_node", "relation", F.round(F.col("weight") * 100).cast("long").cast("string")))


@query("snapshot_prune", "select 's' || i as snapshot_id from (select unnest([5, 4, 3]) as i)")
def _prune(s, d):
    root = scratch(s)
    for i in range(1, 6):
        snapshot.create(s, root, {"region": tables.read(s, d, "region")}, f"2024-01-0{i}", 3, f"s{i}")
    return snapshot.listing(s, root).select("snapshot_id")


# Streams


def _stream(s: SparkSession, d: str, sql: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    # The file source reads folders; a glob also fits a table that is one file.
    source = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return s.sql(tables._placeholders(sql, ["events"]), events=source)


def _drain(s, out: DataFrame, mode: str = "complete") -> DataFrame:
    return jobs.drain(out, scratch(s), mode)


query("stream_kv_state", f", {LAST} select k, v, ttl, seq from last where {LIVE}", "kv_log")(
    lambda s, d: _drain(s, jobs.kv_updates(_stream(s, d, tables.KV_SQL))).filter((F.col("op") != "delete") & kv.live(as_of())).select("k", "v", "ttl", "seq")
)
query("stream_access_counts", "select vec_id, count(*) as accesses, max(ts) as last_access from access_log group by vec_id", "access_log")(lambda s, d: _drain(s, jobs.access_counts(_stream(s, d, tables.ACCESS_SQL))))
query("stream_windows", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by all")(
    lambda s, d: _drain(s, jobs.windowed_counts(_stream(s, d, "select cast(ts as timestamp) as ts, event_type from events"), "1 day", "1 hour")).withColumn("start", F.col("start").cast("timestamp_ntz"))
)
