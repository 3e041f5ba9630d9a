"""Catalog of databases, tables, shards, quorums and servers as small DataFrames.

Every change checks its rules, then returns a new catalog whose version is one
higher. Catalog frames hold schema objects, not data: checks read single rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkv.operators import shards as shard_ops

SCHEMAS = {
    "databases": "database_id long, name string",
    "tables": "table_id long, database_id long, name string, is_frozen boolean",
    "shards": "shard_id long, table_id long, quorum_id long, first_key string, last_key string",
    "quorums": "quorum_id long, name string, active_nodes array<long>, inactive_nodes array<long>",
    "servers": "node_id long, endpoint string, alive boolean",
}
MAX_NAME = 1024


class CatalogError(ValueError):
    pass


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise CatalogError(why)


@dataclass(frozen=True)
class Catalog:
    frames: dict[str, DataFrame]
    version: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> Catalog:
        return Catalog({k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def having(self, name: str, /, **equal):
        df = self[name]
        for k, v in equal.items():
            df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
        return df

    def one(self, name: str, /, **equal):
        row = self.having(name, **equal).first()
        _need(row is not None, f"no such row in {name}: {equal}")
        return row

    def has(self, name: str, /, **equal) -> bool:
        return not self.having(name, **equal).isEmpty()

    def next_id(self, name: str) -> int:
        return (self[name].agg(F.max(SCHEMAS[name].split()[0])).first()[0] or 0) + 1

    def put(self, **frames: DataFrame) -> Catalog:
        return replace(self, frames=self.frames | frames, version=self.version + 1)

    def add(self, name: str, /, **row) -> DataFrame:
        spark = self[name].sparkSession
        names = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        return self[name].unionByName(spark.createDataFrame([tuple(row[c] for c in names)], SCHEMAS[name]))

    def drop(self, name: str, /, **equal) -> DataFrame:
        return self[name].join(self.having(name, **equal).select(SCHEMAS[name].split()[0]), SCHEMAS[name].split()[0], "left_anti")

    def set(self, name: str, key: dict, /, **values) -> DataFrame:
        (k, v), df = next(iter(key.items())), self[name]
        for c, x in values.items():
            new = F.array(*[F.lit(y).cast("long") for y in x]).cast("array<long>") if isinstance(x, list) else F.lit(x)
            df = df.withColumn(c, F.when(F.col(k) == v, new).otherwise(F.col(c)))
        return df

    # names
    def _name(self, name: str, kind: str, own: str | None = None, /, **within) -> None:
        _need(0 < len(name.encode()) <= MAX_NAME, "a name has 1 to 1024 bytes")
        _need(re.fullmatch(r"[\x20-\x7e]+", name) is not None, "a name is printable ASCII")
        _need(name == own or not self.has(kind, name=name, **within), f"{name} exists")

    # databases
    def create_database(self, name: str) -> Catalog:
        self._name(name, "databases")
        return self.put(databases=self.add("databases", database_id=self.next_id("databases"), name=name))

    def rename_database(self, database_id: int, name: str) -> Catalog:
        self._name(name, "databases", self.one("databases", database_id=database_id).name)
        return self.put(databases=self.set("databases", {"database_id": database_id}, name=name))

    def delete_database(self, database_id: int) -> Catalog:
        self.one("databases", database_id=database_id)
        gone = self.having("tables", database_id=database_id)
        return self.put(databases=self.drop("databases", database_id=database_id), tables=self.drop("tables", database_id=database_id), shards=self["shards"].join(gone, "table_id", "left_anti"))

    # tables
    def create_table(self, database_id: int, quorum_id: int, name: str) -> Catalog:
        self.one("databases", database_id=database_id)
        self.one("quorums", quorum_id=quorum_id)
        self._name(name, "tables", database_id=database_id)
        t = self.next_id("tables")
        return self.put(tables=self.add("tables", table_id=t, database_id=database_id, name=name, is_frozen=False),
                        shards=self.add("shards", shard_id=self.next_id("shards"), table_id=t, quorum_id=quorum_id, first_key="", last_key=""))

    def rename_table(self, table_id: int, name: str) -> Catalog:
        t = self.one("tables", table_id=table_id)
        self._name(name, "tables", t.name, database_id=t.database_id)
        return self.put(tables=self.set("tables", {"table_id": table_id}, name=name))

    def delete_table(self, table_id: int) -> Catalog:
        self.one("tables", table_id=table_id)
        return self.put(tables=self.drop("tables", table_id=table_id), shards=self.drop("shards", table_id=table_id))

    def truncate_table(self, table_id: int) -> Catalog:
        """The table keeps its id; its shards are replaced by one new unbounded shard."""
        self.one("tables", table_id=table_id)
        q = self.having("shards", table_id=table_id).join(self["quorums"], "quorum_id")
        _need(q.filter(F.size("inactive_nodes") > 0).isEmpty(), "a quorum has inactive nodes")
        quorum, new = self.one("shards", table_id=table_id).quorum_id, self.next_id("shards")
        rest = Catalog(self.frames | {"shards": self.drop("shards", table_id=table_id)}, self.version)
        return rest.put(shards=rest.add("shards", shard_id=new, table_id=table_id, quorum_id=quorum, first_key="", last_key=""))

    def freeze_table(self, table_id: int, frozen: bool = True) -> Catalog:
        self.one("tables", table_id=table_id)
        return self.put(tables=self.set("tables", {"table_id": table_id}, is_frozen=frozen))

    def freeze_database(self, database_id: int, frozen: bool = True) -> Catalog:
        self.one("databases", database_id=database_id)
        return self.put(tables=self.set("tables", {"database_id": database_id}, is_frozen=frozen))

    # servers and quorums
    def register_server(self, endpoint: str) -> Catalog:
        return self.put(servers=self.add("servers", node_id=self.next_id("servers"), endpoint=endpoint, alive=True))

    def unregister_server(self, node_id: int) -> Catalog:
        self.one("servers", node_id=node_id)
        member = F.array_contains("active_nodes", F.lit(node_id).cast("long")) | F.array_contains("inactive_nodes", F.lit(node_id).cast("long"))
        _need(self["quorums"].filter(member).isEmpty(), "the server is a member of a quorum")
        return self.put(servers=self.drop("servers", node_id=node_id))

    def create_quorum(self, name: str, nodes: list[int]) -> Catalog:
        self._name(name, "quorums")
        _need(bool(nodes) and all(self.has("servers", node_id=n, alive=True) for n in nodes), "all nodes must be registered and alive")
        return self.put(quorums=self.add("quorums", quorum_id=self.next_id("quorums"), name=name, active_nodes=list(nodes), inactive_nodes=[]))

    def rename_quorum(self, quorum_id: int, name: str) -> Catalog:
        self._name(name, "quorums", self.one("quorums", quorum_id=quorum_id).name)
        return self.put(quorums=self.set("quorums", {"quorum_id": quorum_id}, name=name))

    def delete_quorum(self, quorum_id: int) -> Catalog:
        self.one("quorums", quorum_id=quorum_id)
        _need(not self.has("shards", quorum_id=quorum_id), "the quorum holds shards")
        return self.put(quorums=self.drop("quorums", quorum_id=quorum_id))

    def _nodes(self, quorum_id: int, active: list[int], inactive: list[int]) -> Catalog:
        _need(bool(active), "the last active node stays")
        return self.put(quorums=self.set("quorums", {"quorum_id": quorum_id}, active_nodes=active, inactive_nodes=inactive))

    def add_node(self, quorum_id: int, node_id: int) -> Catalog:
        q = self.one("quorums", quorum_id=quorum_id)
        self.one("servers", node_id=node_id)
        _need(node_id not in [*q.active_nodes, *q.inactive_nodes], "the node is a member")
        return self._nodes(quorum_id, q.active_nodes, [*q.inactive_nodes, node_id])

    def activate_node(self, quorum_id: int, node_id: int) -> Catalog:
        q = self.one("quorums", quorum_id=quorum_id)
        _need(node_id in q.inactive_nodes, "the node is not inactive")
        return self._nodes(quorum_id, [*q.active_nodes, node_id], [n for n in q.inactive_nodes if n != node_id])

    def deactivate_node(self, quorum_id: int, node_id: int) -> Catalog:
        q = self.one("quorums", quorum_id=quorum_id)
        _need(node_id in q.active_nodes, "the node is not active")
        return self._nodes(quorum_id, [n for n in q.active_nodes if n != node_id], [*q.inactive_nodes, node_id])

    def remove_node(self, quorum_id: int, node_id: int) -> Catalog:
        q = self.one("quorums", quorum_id=quorum_id)
        _need(node_id in [*q.active_nodes, *q.inactive_nodes], "the node is no member")
        return self._nodes(quorum_id, [n for n in q.active_nodes if n != node_id], [n for n in q.inactive_nodes if n != node_id])

    # shards
    def split_shard(self, shard_id: int, key: str) -> Catalog:
        try:
            return self.put(shards=shard_ops.split(self["shards"], shard_id, key, self.next_id("shards")))
        except ValueError as e:
            raise CatalogError(str(e)) from e

    def migrate_shard(self, shard_id: int, quorum_id: int) -> Catalog:
        self.one("shards", shard_id=shard_id)
        self.one("quorums", quorum_id=quorum_id)
        new = self.next_id("shards")
        return self.put(shards=self.set("shards", {"shard_id": shard_id}, quorum_id=quorum_id).withColumn("shard_id", F.when(F.col("shard_id") == shard_id, F.lit(new).cast("long")).otherwise(F.col("shard_id"))))

    # lookups
    def listed(self, name: str) -> DataFrame:
        return self[name].orderBy(SCHEMAS[name].split()[0])

    def statistics(self) -> DataFrame:
        """Tables and shards of each database."""
        s = self["shards"].groupBy("table_id").agg(F.count("*").alias("shards"))
        t = self["tables"].join(s, "table_id", "left").groupBy("database_id").agg(F.count("*").alias("n_tables"), F.sum("shards").alias("n_shards"))
        return self["databases"].join(t, "database_id", "left").na.fill(0, ["n_tables", "n_shards"])

    def to_json(self) -> DataFrame:
        """One row: version and the whole catalog as JSON."""
        out = self["servers"].sparkSession.range(1).select(F.lit(self.version).alias("version"))
        for name in SCHEMAS:
            rows = self[name].agg(F.sort_array(F.collect_list(F.struct(*self[name].columns))).alias(name))
            out = out.join(F.broadcast(rows))  # schema objects of one catalog
        return out.select("version", F.to_json(F.struct(*SCHEMAS)).alias("json"))

    @staticmethod
    def from_json(json: DataFrame) -> Catalog:
        schema = ", ".join(f"{k}: array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in s.split(', '))}>>" for k, s in SCHEMAS.items())
        parsed = json.select("version", F.from_json("json", f"struct<{schema}>").alias("x"))
        return Catalog({k: parsed.select(F.explode(f"x.{k}").alias("r")).select("r.*") for k in SCHEMAS}, json.first().version)
