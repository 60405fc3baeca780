"""The engine: named methods over versioned DataFrames.

Every change replaces a table by a new plan; nothing is mutated in place.  Rows that are
added one by one are held together, so that a table is its base and one union however many
they are; many rows come through the methods that take DataFrames.  Where a root folder is
given, each change is also appended to the log there, ``save`` writes a snapshot, and
``open`` restores the latest one and replays what was logged after it.
"""

from __future__ import annotations

import base64
import datetime
import json
import re
import shlex
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .config import EDGES, KV_LOG, NODES, VECTORS, Config
from .errors import DimensionError, LimitError, NotFoundError, QuerySyntaxError
from .functions import text as T
from .functions import vectors as V
from .operators import graph, kv, retrieval, vector
from .plans.parser import Delete, Insert, Match, parse
from .plans.resolver import resolve
from .sources import files, log, snapshot
from .sources.index_store import IndexManager
from .sources.shared import scratch

MESSAGES = "conv_id long, turn long, role string, text string"
ACCESSES = "vec_id long, ts timestamp"
TOUCHES = "k string, ts timestamp"
TABLES = {"nodes": NODES, "edges": EDGES, "vectors": VECTORS, "kv_log": KV_LOG, "messages": MESSAGES, "accesses": ACCESSES, "touches": TOUCHES}
STORES = ["nodes", "edges", "vectors", "kv_log"]
#: Tables whose rows have an identity of their own, and its column.
KEYS = {"nodes": "node_id", "edges": "edge_id", "vectors": "vec_id"}
#: Files below this many are not worth rewriting the log for.
LOG_BATCHES = 64


#: Quoted parts, braces, words, blanks and single marks of a statement, and the words that end a FROM clause.
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\{\w+\}|\w+|\s+|.", re.S)
_CLAUSES = {"select", "where", "group", "having", "order", "sort", "cluster", "distribute", "limit", "offset", "window", "union", "intersect", "except", "lateral"}


def _now():
    """The time as a constant of this call, not of whenever a plan runs."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


def _iso(stamp: int) -> str:
    """Microseconds since the epoch as a UTC time."""
    return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(stamp // 1_000_000)) + f".{stamp % 1_000_000:06d}Z"


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, root: str | None = None, strict: bool = False, embedder=None):
        """``embedder`` maps a column of texts to vectors of the configured dimension; hash embeddings by default."""
        self.spark, self.config, self.root, self.strict = spark, config or Config(), root.rstrip("/") if root else None, strict
        self.embedder = embedder or (lambda text: T.embed_text(text, self.config.dimension))
        self.tables: dict[str, DataFrame] = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
        self._added: dict[str, tuple] = {}
        self._last: dict[str, int] = {}
        self._indexes: IndexManager | None = None
        self.started = time.time()

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config | None = None, **more) -> Engine:
        """The engine over the latest snapshot in root, or an empty one, with the log replayed."""
        out = cls(spark, config, root, **more)
        newest = snapshot.listing(spark, root).first()
        if newest is not None:
            out.restore(newest["snapshot_id"])
        out.replay(newest["lsn"] or 0 if newest is not None else 0)
        return out

    def attach(self, name: str, df: DataFrame) -> Engine:
        """Use an existing DataFrame as a table.  It is not logged; ``save`` writes it."""
        self.tables[name] = df
        return self

    # changes

    def _wal(self) -> str:
        return f"{self._root()}/wal"

    def _record(self, entries: list[tuple]) -> None:
        """Appends (operation, table, key, row or None) to the log, where there is a root."""
        if self.root:
            rows = [(op, table, str(key), None if row is None else json.dumps(row)) for op, table, key, row in entries]
            log.append_entries(self.spark, self._wal(), rows, self.config.wal_segment_entries)

    def _record_rows(self, op: str, table: str, rows: DataFrame, key: str, payload: bool) -> None:
        if self.root:
            body = F.to_json(F.struct(*rows.columns)) if payload else F.lit(None).cast("string")
            d = rows.select(F.lit(op).alias("op"), F.lit(table).alias("layer"), F.col(key).cast("string").alias("entity_key"), body.alias("payload"), F.col(key).alias("seq"))
            log.append(d, self._wal(), segment_entries=self.config.wal_segment_entries)

    def _next(self, name: str, column: str) -> int:
        """A number that the table has never had; only the first call looks."""
        if self._last.get(name) is None:
            self._last[name] = self.tables[name].agg(F.max(column)).first()[0] or 0
        self._last[name] += 1
        return self._last[name]

    def add(self, name: str, rows: list[dict], schema: str | None = None, logged: bool = True) -> None:
        """Adds rows; in tables with an identity, rows of the same one are replaced."""
        fields = StructType.fromDDL(schema or TABLES[name])
        base, fresh, shown = self._added.get(name, (None, {}, None))
        if shown is not self.tables[name]:
            base, fresh = self.tables[name], {}
        key = KEYS.get(name)
        fresh = fresh | {(r[key] if key else len(fresh) + i): tuple(r.get(f.name) for f in fields) for i, r in enumerate(rows)}
        new = self.spark.createDataFrame(list(fresh.values()), fields)
        if name == "vectors":
            base_left = base.join(F.broadcast(new.select(key)), key, "left_anti")
        else:
            base_left = base
        self.tables[name] = base_left.unionByName(new, allowMissingColumns=True)
        self._added[name] = (base, fresh, self.tables[name])
        if logged:
            plain = lambda v: base64.b64encode(v).decode() if isinstance(v, bytes) else v
            self._record([("insert", name, r[key] if key else r.get("k", r.get("conv_id", r.get("vec_id"))), {c: plain(v) for c, v in r.items()}) for r in rows])

    def add_rows(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Adds the rows of a DataFrame, which carry their own ids; vectors are upserted."""
        if name == "vectors":
            self.tables[name] = vector.upsert(self.tables[name], rows, self.config)
        else:
            self.tables[name] = self.tables[name].unionByName(rows, allowMissingColumns=True)
        self._last.pop(name, None)
        self._record_rows("insert", name, rows, key or KEYS.get(name) or rows.columns[0], True)

    def replay(self, after: int = 0) -> int:
        """Applies the log's entries beyond ``after``; how many there are."""
        entries = log.replay(self.spark, self._wal(), after)
        counts = {r["layer"]: (r["n"], r["top"]) for r in entries.groupBy("layer").agg(F.count("*").alias("n"), F.max(F.expr("try_cast(entity_key as long)")).alias("top")).collect()}
        for name in [n for n in TABLES if n in counts]:
            own = entries.filter(F.col("layer") == name)
            row = lambda d, n=name: d.select(F.from_json("payload", TABLES[n]).alias("r")).select("r.*")
            if name not in KEYS:
                self.tables[name] = self.tables[name].unionByName(row(own), allowMissingColumns=True)
                continue
            key = KEYS[name]
            last = log.last_entries(own)
            touched = last.select(F.col("entity_key").cast("long").alias(key))
            kept = self.tables[name].join(touched, key, "left_anti")
            self.tables[name] = kept.unionByName(row(last.filter("op <> 'delete'")), allowMissingColumns=True)
            # An id that was once given is not given again.
            top = max(self.tables[name].agg(F.max(key)).first()[0] or 0, counts[name][1] or 0)
            self._last[name] = top
            if name == "nodes":
                self._dead = last.filter("op = 'delete'").select(F.col("entity_key").cast("long").alias("node_id"))
        if "nodes" in counts:
            _, self.tables["edges"] = graph.remove_nodes(self.tables["nodes"], self.tables["edges"], self._dead)
        return sum(n for n, _ in counts.values())

    # queries

    def query(self, text: str) -> DataFrame:
        """A pattern statement, SELECT over the tables, a vector literal, or free text that is embedded."""
        words = text.split(None, 1)
        head = words[0].upper() if words else ""
        if head.startswith("SELECT"):
            return self.select(text)
        if head.startswith(("MATCH", "INSERT", "DELETE")):
            return self.run(parse(text, self.strict))
        values = V.parse_literal(text)
        if values is None:
            if not text.strip():
                raise QuerySyntaxError("empty query")
            values = self.embed(text)
        return self.vector_search(values, 10)

    def select(self, text: str) -> DataFrame:
        """A SELECT statement; tables are named as they are, or in braces."""
        out, inside, wanted = [], [False], False
        for token in _TOKEN.findall(text):
            word = token.lower()
            if wanted and word in self.tables:
                token = "{" + word + "}"
            if token.strip():
                wanted = word in ("from", "join") or (word == "," and inside[-1])
            if word == "(":
                inside.append(False)
            elif word == ")" and len(inside) > 1:
                inside.pop()
            elif word == "from":
                inside[-1] = True
            elif word in _CLAUSES:
                inside[-1] = False
            out.append(token)
        text = "".join(out)
        return self.spark.sql(text, **{n: df for n, df in self.tables.items() if "{" + n + "}" in text})

    def embed(self, text: str) -> list[float]:
        return list(self.spark.createDataFrame([(text,)], "t string").select(self.embedder(F.col("t"))).first()[0])

    def embed_texts(self, texts: DataFrame, column: str = "text") -> DataFrame:
        """The rows with ``embedding``."""
        return texts.withColumn("embedding", self.embedder(F.col(column)))

    def process_query(self, text: str, conv_id: int | None = None, k: int = 10, as_of=None) -> DataFrame:
        """The best memories for a text together with its conversation's context, as ranked rows; they count as accessed."""
        parts = [text] if conv_id is None else [*(r["line"] for r in retrieval.context_lines(self.context(conv_id)).orderBy("turn").collect()), text]
        ranked = retrieval.memory_rank(self.tables["vectors"], self.tables["accesses"], self.embed("\n".join(parts)), as_of if as_of is not None else _now(), self.config, self.config.space)
        found = ranked.limit(k).collect()
        self.record_accesses([r["vec_id"] for r in found])
        return self.spark.createDataFrame(found, ranked.schema)

    def run(self, statement) -> DataFrame:
        if isinstance(statement, Match):
            return resolve(statement, self.tables["nodes"], self.tables["edges"])
        if isinstance(statement, Insert):
            node = self.add_node(statement.label, {k: str(v) for k, v in statement.properties.items()})
            return self.message("inserted", node)
        assert isinstance(statement, Delete)
        label = statement.label
        doomed = graph.nodes_by_label(self.tables["nodes"], label).select("node_id") if label is not None else self.tables["nodes"].limit(0).select("node_id")
        n = doomed.count()
        self._remove(doomed)
        return self.message("deleted", n)

    def message(self, what: str, value: int) -> DataFrame:
        return self.spark.createDataFrame([(what, value)], "message string, value long")

    # graph

    def add_node(self, label: str, properties: dict[str, str] | None = None) -> int:
        new = self._next("nodes", "node_id")
        self.add("nodes", [{"node_id": new, "label": label, "properties": properties or {}}])
        return new

    def add_edge(self, from_node: int, to_node: int, relation: str, weight: float = 1.0) -> int:
        found = {r[0] for r in self.tables["nodes"].filter(F.col("node_id").isin(from_node, to_node)).select("node_id").collect()}
        for end in (from_node, to_node):
            if end not in found:
                raise NotFoundError(f"no node {end}")
        new = self._next("edges", "edge_id")
        self.add("edges", [{"edge_id": new, "from_node": from_node, "to_node": to_node, "relation": relation, "weight": float(weight)}])
        return new

    def get_node(self, node_id: int):
        row = self.tables["nodes"].filter(F.col("node_id") == node_id).first()
        if row is None:
            raise NotFoundError(f"no node {node_id}")
        return row

    def find_nodes(self, label: str) -> DataFrame:
        return graph.nodes_by_label(self.tables["nodes"], label)

    def neighbors(self, node_id: int, relation: str | None = None) -> DataFrame:
        return graph.neighbors(self.tables["edges"], node_id, relation)

    def traverse(self, from_label: str, relation: str | None, to_label: str) -> DataFrame:
        return graph.traverse(self.tables["nodes"], self.tables["edges"], from_label, relation, to_label)

    def remove_node(self, node_id: int) -> None:
        self.get_node(node_id)
        self._remove(self.tables["nodes"].filter(F.col("node_id") == node_id).select("node_id"))

    def _remove(self, doomed: DataFrame) -> None:
        if self.root:
            # Named before the tables change, so that the log and the tables mean the same nodes.
            doomed = self.spark.read.parquet(self._put_aside(doomed))
        self._next("nodes", "node_id")  # a removed id is not given again
        self._last["nodes"] -= 1
        self.tables["nodes"], self.tables["edges"] = graph.remove_nodes(self.tables["nodes"], self.tables["edges"], doomed)
        self._record_rows("delete", "nodes", doomed, "node_id", False)

    def _put_aside(self, rows: DataFrame) -> str:
        path = scratch(self.spark)
        rows.write.parquet(path)
        return path

    def node_count(self) -> int:
        return self.tables["nodes"].count()

    def edge_count(self) -> int:
        return self.tables["edges"].count()

    # vectors

    def vector_insert(self, vec_id: int, values, metadata: bytes | None = None) -> None:
        if len(values) != self.config.dimension:
            raise DimensionError(f"vector has {len(values)} components, not {self.config.dimension}")
        self.add("vectors", [{"vec_id": vec_id, "embedding": [float(v) for v in values], "metadata": metadata, "deleted": False}])

    def vector_search(self, query, k: int = 10, where=None) -> DataFrame:
        return vector.knn(self.tables["vectors"], query, k, self.config.space, where, self.config.dimension)

    def vector_delete(self, vec_id: int) -> None:
        if self.tables["vectors"].filter((F.col("vec_id") == vec_id) & F.col("deleted").isNotNull()).isEmpty():
            raise NotFoundError(f"no vector {vec_id}")
        self.tables["vectors"] = vector.delete(self.tables["vectors"], self.spark.createDataFrame([(vec_id,)], "vec_id long"))
        self._record([("delete", "vectors", vec_id, None)])

    def vector_index(self) -> DataFrame:
        """The live vectors with sketches, for ``vector_search_near``; write it to keep it."""
        return vector.sketched(self.tables["vectors"].filter("deleted is not true"), self.config.dimension)

    def vector_search_near(self, index: DataFrame, query, k: int = 10) -> DataFrame:
        """Approximate search over a ``vector_index``."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<double>")
        return vector.knn_sketched(index, one, k).orderBy("rank").select("vec_id", "distance")

    def vector_count(self) -> int:
        return self.tables["vectors"].filter("deleted is not true").count()

    def dimension(self) -> int:
        return self.config.dimension

    # key-value

    def _change(self, key: str, value: bytes | None, ttl: int, op: str) -> None:
        if len(key.encode()) > self.config.max_key_bytes or len(value or b"") > self.config.max_value_bytes:
            raise LimitError(f"key or value too large at key {key[:80]!r}")
        stamp = time.time_ns() // 1000
        row = {"seq": self._next("kv_log", "seq"), "k": key, "v": value, "ttl": ttl, "op": op}
        at = datetime.datetime.fromtimestamp(stamp / 1e6)
        self.add("kv_log", [row | {"ts": at}], logged=False)
        self._record([(op if op == "delete" else "insert", "kv_log", key, row | {"v": None if value is None else base64.b64encode(value).decode(), "ts": _iso(stamp)})])

    def kv_set(self, key: str, value: bytes, ttl: int = 0) -> None:
        self._change(key, value, ttl, "set")

    def kv_get(self, key: str, as_of=None) -> bytes | None:
        row = kv.get(self.tables["kv_log"], key, _now() if as_of is None else as_of).first()
        return None if row is None else bytes(row["v"])

    def kv_delete(self, key: str) -> None:
        self._change(key, None, 0, "delete")

    def kv_count(self, as_of=None) -> int:
        return kv.current(self.tables["kv_log"], _now() if as_of is None else as_of).count()

    def kv_tiers(self, as_of=None) -> DataFrame:
        return kv.tiers(self.tables["kv_log"], _now() if as_of is None else as_of, self.config, self.tables["touches"])

    def hot_keys(self, as_of=None) -> DataFrame:
        return self.kv_tiers(as_of).filter("tier = 'hot'").select("k")

    def warm_keys(self, as_of=None) -> DataFrame:
        return self.kv_tiers(as_of).filter("tier = 'warm'").select("k")

    def promote(self, key: str) -> None:
        """Makes a key the most recent one, which brings it to the hot tier."""
        if self.kv_get(key) is None:
            raise NotFoundError(f"no key {key!r}")
        self._touch("touches", [{"k": key}])

    # memory and contexts

    def _touch(self, name: str, rows: list[dict]) -> None:
        stamp = time.time_ns() // 1000
        self.add(name, [r | {"ts": datetime.datetime.fromtimestamp(stamp / 1e6)} for r in rows], logged=False)
        self._record([("insert", name, next(iter(r.values())), r | {"ts": _iso(stamp)}) for r in rows])

    def record_access(self, vec_id: int) -> None:
        self.record_accesses([vec_id])

    def record_accesses(self, vec_ids: list[int]) -> None:
        if vec_ids:
            self._touch("accesses", [{"vec_id": int(i)} for i in vec_ids])

    def add_message(self, conv_id: int, role: str, text: str) -> int:
        """Adds a message to a conversation; its turn."""
        turn = self._next("messages", "turn")
        self.add("messages", [{"conv_id": conv_id, "turn": turn, "role": role, "text": text}])
        return turn

    def context(self, conv_id: int, summarise: bool = False) -> DataFrame:
        """The messages of a conversation that fit the budget; older ones are dropped, or merged into a summary."""
        own = self.tables["messages"].filter(F.col("conv_id") == conv_id)
        cleared = own.filter("role is null").agg(F.max("turn")).first()[0]
        own = own.filter("role is not null" + (f" and turn > {cleared}" if cleared is not None else ""))
        return (retrieval.context_summarised if summarise else retrieval.context_window)(own, self.config.max_context_tokens)

    def context_text(self, conv_id: int) -> str:
        row = retrieval.context_text(self.context(conv_id)).first()
        return "" if row is None else row["context"]

    def context_count(self, conv_id: int) -> int:
        return self.context(conv_id).count()

    def clear_context(self, conv_id: int) -> None:
        """A row without a role ends what came before it."""
        self.add("messages", [{"conv_id": conv_id, "turn": self._next("messages", "turn"), "role": None, "text": None}])

    def merge(self, lists: list[DataFrame], **columns) -> DataFrame:
        """Result lists merged as the configuration says: union, intersection or weighted."""
        ways = {"union": lambda: retrieval.merge_union(lists), "intersection": lambda: retrieval.merge_intersection(lists, **columns), "weighted": lambda: retrieval.merge_weighted(lists, **columns)}
        return ways[self.config.merge_strategy]()

    # indexes

    @property
    def indexes(self) -> IndexManager:
        if self._indexes is None:
            self._indexes = IndexManager(self.spark, f"{self._root()}/indexes")
        return self._indexes

    def index_documents(self, docs: DataFrame, version: str | None = None) -> None:
        self.indexes.postings.index(docs, version)

    def search_documents(self, query: str, k: int = 10) -> DataFrame:
        return self.indexes.postings.search(query, k)

    def rebuild_indexes(self) -> None:
        self.indexes.rebuild()

    # administration

    def stats(self) -> DataFrame:
        """Rows of the stores; deleted vectors do not count."""
        out = None
        for name in STORES:
            df = self.tables[name]
            if name == "vectors":
                df = df.filter("deleted is not true")
            row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = row if out is None else out.union(row)
        return out

    def health(self) -> dict:
        return {"status": "ok", "uptime_seconds": int(time.time() - self.started)}

    def save(self, at: str | None = None) -> str:
        when = at or time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
        lsn = log.last_lsn(self.spark, self._wal())
        return snapshot.create(self.spark, f"{self._root()}", self.tables, when, self.config.max_snapshots, lsn=lsn)

    def snapshots(self) -> DataFrame:
        return snapshot.listing(self.spark, self._root())

    def restore(self, snapshot_id: str) -> None:
        """The tables of a snapshot in place of the present ones."""
        self.tables |= snapshot.restore(self.spark, self._root(), snapshot_id)
        self._last.clear()

    def _root(self) -> str:
        if self.root is None:
            raise NotFoundError("the engine has no root folder")
        return self.root

    def compact(self, source: str, target: str) -> int:
        """Rewrites a stored table with small files; the number of files written."""
        return files.compact(self.spark, source, target, self.config.small_file_bytes)

    def collect_garbage(self, as_of=None) -> dict[str, int]:
        """Rows or parts that each step of a cycle removed.

        Dead rows of the change log and deleted vectors go from the tables.  With a root, log
        segments that the newest snapshot contains go too, a log of many batches is rewritten,
        and fragmented indexes are rebuilt.
        """
        before = {n: self.tables[n].count() for n in ("kv_log", "vectors")}
        self.tables["kv_log"] = kv.purge(self.tables["kv_log"], _now() if as_of is None else as_of, self.config.kv_retention_days).select(*self.tables["kv_log"].columns)
        self.tables["vectors"] = self.tables["vectors"].filter("deleted is not true")
        out = {n: before[n] - self.tables[n].count() for n in before}
        if self.root:
            newest = snapshot.listing(self.spark, self.root).first()
            out["wal_segments"] = log.truncate(self.spark, self._wal(), self.config.wal_segments_kept, newest["lsn"] or 0 if newest is not None else 0, self.config.wal_segment_entries)
            out["wal_entries"] = log.rewrite(self.spark, self._wal(), self.config.wal_segment_entries, layers=list(KEYS)) if len(log.batches(self.spark, self._wal())) > LOG_BATCHES else 0
            rebuilt = self.indexes.fragmentation(self.config.index_file_rows) > self.config.index_fragmentation_threshold
            if rebuilt:
                self.indexes.rebuild()
            out["indexes"] = int(rebuilt)
        return out

    def command(self, line: str) -> list[tuple] | str:
        """PING, QUERY, VINSERT, VSEARCH, GADD, KVGET, KVSET and STATS as text commands."""
        name, _, rest = line.strip().partition(" ")
        name = name.upper()
        if name == "PING":
            return "PONG"
        if name == "QUERY":
            return [tuple(r) for r in self.query(rest).collect()]
        if name == "STATS":
            return [tuple(r) for r in self.stats().collect()]
        args = shlex.split(rest)
        if name == "VINSERT":
            self.vector_insert(int(args[0]), V.parse_literal(args[1]))
            return "OK"
        if name == "VSEARCH":
            return [tuple(r) for r in self.vector_search(V.parse_literal(args[0]), int(args[1]) if len(args) > 1 else 10).collect()]
        if name == "GADD":
            return str(self.add_node(args[0], dict(a.partition("=")[::2] for a in args[1:])))
        if name == "KVSET":
            self.kv_set(args[0], args[1].encode(), int(args[2]) if len(args) > 2 else 0)
            return "OK"
        if name == "KVGET":
            value = self.kv_get(args[0])
            return "NOT_FOUND" if value is None else value.decode()
        raise QuerySyntaxError(f"unknown command {name}")
