"""Registered queries of what is written and watched: drivers, stores, collections, transactions, sync, live queries.

Each one takes the sample's nations and regions (25 and 5 records) through the calls it is named for, and gives
what is stored, read or told at the end as rows that SQL can tell as well. Those of tables of mutations take
every event.
"""

from __future__ import annotations

import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tessera.catalog import Def, FieldDef
from tessera.errors import TesseraError
from tessera.functions import expr as e
from tessera.functions.callback import in_python
from tessera.operators.collection import Collection, Transaction, diff, local_only, optimistic_action, remote
from tessera.operators.mutations import TABLE, fold_mutations, fold_versions
from tessera.operators.query import Query, query
from tessera.operators.store import Database, Event, Store
from tessera.plans.patterns import Engine
from tessera.queries import _STEPS, Tables, _event_mutations, register
from tessera.record import attributes, get_in, item, put_in
from tessera.session import shared_dir
from tessera.sources.drivers import Driver, MemoryDriver, Mutation, ParquetDriver
from tessera.sources.jsonfile import JsonFileCollection
from tessera.sources.tables import table
from tessera.streaming.feed import ChangeLog, latest
from tessera.streaming.live import LiveHandle, LiveQuery
from tessera.streaming.sync import Puller, calls, watch_mutations

NATION = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"


def _nations(t: Tables) -> list[dict[str, Any]]:
    rows = t.nation.df.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    return [{"id": str(r.n_nationkey), "k": r.n_nationkey, "name": r.n_name, "r": r.n_regionkey} for r in rows]


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}"


def _values(x: dict[str, Any]) -> dict[str, Any]:
    return {"name": x["name"], "r": x["r"]}


def _creates(t: Tables, path: str = "app/nations") -> list[Mutation]:
    return [Mutation(f"{path}/{x['id']}", "create", _values(x)) for x in _nations(t)]


def _filled(t: Tables, driver: Driver | None = None) -> Store:
    store = Store(driver or MemoryDriver(t.spark))
    store.apply(_creates(t))
    return store


def _frame(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def _code(action: Any) -> str:
    try:
        action()
    except TesseraError as error:
        return error.code
    return "ok"


# --- drivers ---------------------------------------------------------------------------------------

_OPERATIONS = """
SELECT concat('app/nations/', CAST(n_nationkey AS VARCHAR)) AS path, 'name' AS attr, n_name AS text FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey % 5 <> 0
UNION ALL SELECT concat('app/nations/', CAST(n_nationkey AS VARCHAR)), 'r', CAST(n_regionkey + CASE WHEN n_nationkey % 3 = 0 THEN 10 ELSE 0 END AS VARCHAR)
FROM nation WHERE n_nationkey % 7 <> 0"""


def _operated(t: Tables, driver: Driver) -> DataFrame:
    batch = _creates(t)
    for x in _nations(t):
        path = f"app/nations/{x['id']}"
        batch += [Mutation(path, "patch", {"r": x["r"] + 10})] * (x["k"] % 3 == 0)
        batch += [Mutation(path, "delete", attrs=("name",))] * (x["k"] % 5 == 0)
        batch += [Mutation(path, "delete")] * (x["k"] % 7 == 0)
    driver.apply(*batch)
    return driver.tuples("app/nations").select("path", "attr", "text")


@register(_OPERATIONS)
def driver_memory(t: Tables) -> DataFrame:
    return _operated(t, MemoryDriver(t.spark))


@register(_OPERATIONS)
def driver_parquet(t: Tables) -> DataFrame:
    return _operated(t, ParquetDriver(t.spark, _folder(t)))


@register("SELECT concat('app/nations/', CAST(n_nationkey AS VARCHAR)) AS path, n_name AS value FROM nation")
def driver_get_tuples(t: Tables) -> DataFrame:
    driver = ParquetDriver(t.spark, _folder(t))
    driver.apply(*_creates(t))
    found = driver.get_tuples([f"app/nations/{k}#{a}" for k in range(40) for a in ("name", "none")])
    return _frame(t, [(x.path, x.value) for x in found], "path string, value string")


@register("SELECT concat('app/regions/', CAST(r_regionkey AS VARCHAR)) AS path, r_name AS value FROM region")
def driver_drop_records(t: Tables) -> DataFrame:
    driver = ParquetDriver(t.spark, _folder(t))
    driver.apply(*_creates(t))
    driver.apply(*[Mutation(f"app/regions/{r.r_regionkey}", "create", {"name": r.r_name}) for r in t.region.df.collect()])
    driver.drop_records("app/nations")
    return _frame(t, [(x.path, x.value) for x in driver.scan_tuples("app")], "path string, value string")


@register("SELECT concat('app/r', CAST(r_regionkey AS VARCHAR)) AS path, CASE WHEN r_regionkey = 1 THEN 'strict' ELSE 'flexible' END AS mode, CASE WHEN r_regionkey = 1 THEN 0 ELSE 1 END AS fields, 'ALREADY_EXISTS' AS again FROM region WHERE r_regionkey <> 2")
def driver_schemas(t: Tables) -> DataFrame:
    driver = ParquetDriver(t.spark, _folder(t))
    defs = [Def("app", f"r{r.r_regionkey}", "flexible", {"x": FieldDef("string")}) for r in t.region.df.collect()]
    for d in defs:
        driver.create_schema(d)
    again = _code(lambda: driver.create_schema(defs[0]))
    driver.put_schema(Def("app", "r1", "strict"))
    driver.delete_schema("app/r2")
    return _frame(t, [(d.path, d.mode, len(d.fields), again) for d in driver.scan_schemas("app")], "path string, mode string, fields int, again string")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey + 1 AS r FROM nation WHERE n_regionkey % 2 = 0")
def driver_tx(t: Tables) -> DataFrame:
    """Transactions of odd regions are given up."""
    driver = ParquetDriver(t.spark, _folder(t))
    for region in range(5):
        try:
            with driver.tx():
                driver.apply(*[Mutation(f"app/nations/{x['id']}", "create", {"r": region}) for x in _nations(t) if x["r"] == region])
                driver.apply(*[Mutation(f"app/nations/{x['id']}", "patch", {"r": region + 1}) for x in _nations(t) if x["r"] == region])
                if region % 2:
                    raise RuntimeError
        except RuntimeError:
            continue
    return driver.record_table("app/nations").df.select("id", F.col("r").cast("int").alias("r"))


# --- stores ----------------------------------------------------------------------------------------


@register(NATION + " WHERE n_regionkey >= 2")
def store_hydrate(t: Tables) -> DataFrame:
    store = _filled(t, ParquetDriver(t.spark, _folder(t)))
    store.hydrate("app/nations")
    rows = query().from_(n=store.source("app/nations")).where(lambda r: e.gte(r.n.r, 2)).select(lambda r: {"k": r.n.id, "name": r.n.name, "r": r.n.r}).run()
    return rows.select(F.col("k").cast("int").alias("k"), "name", F.col("r").cast("int").alias("r"))


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'ALREADY_EXISTS' ELSE 'ok' END AS code FROM nation")
def store_create(t: Tables) -> DataFrame:
    store = Store(ParquetDriver(t.spark, _folder(t)))
    first = [m for m in _creates(t) if int(m.path.split("/")[2]) % 4 == 0]
    store.apply(first)
    codes = {m.path: _code(lambda m=m: store.apply(m)) for m in first}
    store.apply([m for m in _creates(t) if m.path not in codes])
    kept = {p: r["name"] for p, r in store.driver.load([m.path for m in _creates(t)]).items()}
    return _frame(t, [(p.split("/")[2], name, codes.get(p, "ok")) for p, name in kept.items()], "id string, name string, code string")


@register("SELECT * FROM (VALUES ('title', 'SCHEMA_VIOLATION'), ('type', 'SCHEMA_VIOLATION'), ('extra', 'SCHEMA_VIOLATION'), ('removed', 'SCHEMA_VIOLATION'), ('grown', 'SCHEMA_VIOLATION'), ('good', 'ok'), ('flexible', 'ok'), ('text', 'ok'), ('scope', 'INVALID_URI')) AS v(what, code)")
def store_enforcement(t: Tables) -> DataFrame:
    store = Store(MemoryDriver(t.spark), [Def("app", "posts", "strict", {"title": FieldDef("string", None, True), "views": FieldDef("integer")}), Def("app", "grow"), Def("app", "flex", "flexible")])
    tries = {
        "good": Mutation("app/posts/1", "create", {"title": "a"}),
        "title": Mutation("app/posts/2", "create", {"views": 1}),
        "type": Mutation("app/posts/2", "create", {"title": 1}),
        "extra": Mutation("app/posts/2", "create", {"title": "a", "other": 1}),
        "removed": Mutation("app/posts/1", "delete", attrs=("title",)),
        "text": Mutation("app/posts/1", "patch", {"views": "12"}),
        "grown": [Mutation("app/grow/1", "create", {"x": "a"}), Mutation("app/grow/2", "create", {"x": 1})],
        "flexible": [Mutation("app/flex/1", "create", {"x": "a"}), Mutation("app/flex/2", "create", {"x": 1})],
        "scope": Mutation("app/posts", "create", {"title": "a"}),
    }
    return _frame(t, [(k, _code(lambda m=m: store.apply(m))) for k, m in tries.items()], "what string, code string")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey <> 3")
def store_batches(t: Tables) -> DataFrame:
    """One batch per region; that of region 3 fails at its end, and leaves nothing."""
    store = Store(ParquetDriver(t.spark, _folder(t)), [Def("app", "nations", "strict", {"name": FieldDef("string"), "r": FieldDef("integer")})])
    for region in range(5):
        batch = [m for m in _creates(t) if m.values["r"] == region]
        _code(lambda batch=batch, region=region: store.apply(batch + [Mutation("app/nations/x", "create", {"r": "none"})] * (region == 3)))
    return store.table("app/nations").records().select("id")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, 4 AS writes, 4 AS version FROM nation WHERE n_nationkey < 3")
def store_write_queue(t: Tables) -> DataFrame:
    """Four threads patch the same records, each through a store of its own over one folder: nothing is lost."""
    folder = _folder(t)

    def write(k: int) -> None:
        store = Store(ParquetDriver(t.spark, folder))
        store.apply([Mutation(f"app/nations/{i}", "patch", {f"w{k}": k}) for i in range(3)])

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    found = ParquetDriver(t.spark, folder).load([f"app/nations/{i}" for i in range(3)])
    return _frame(t, [(r["_id"], sum(a.startswith("w") for a in r), r["_version"]) for r in found.values()], "id string, writes int, version int")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'CONFLICT' ELSE 'ok' END AS code, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 2 END AS version FROM nation")
def store_conflict(t: Tables) -> DataFrame:
    """Even records are patched by another store first; a patch that expects version 1 then conflicts."""
    folder = _folder(t)
    one, other = Store(ParquetDriver(t.spark, folder)), Store(ParquetDriver(t.spark, folder))
    one.apply(_creates(t))
    paths = [m.path for m in _creates(t)]
    other.apply([Mutation(p, "patch", {"by": "other"}, version=1) for p in paths if int(p.split("/")[2]) % 2 == 0])
    codes = {p: "ok" for p in paths if int(p.split("/")[2]) % 2}
    one.apply([Mutation(p, "patch", {"by": "one"}, version=1) for p in codes])
    for p in paths[::2]:
        codes[p] = codes.get(p) or _code(lambda p=p: one.apply(Mutation(p, "patch", {"by": "one"}, version=1)))
    found = one.driver.load(paths)
    return _frame(t, [(p.split("/")[2], codes[p], found[p]["_version"]) for p in paths], "id string, code string, version int")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey * 2 AS r FROM nation WHERE n_regionkey < 4")
def store_tx(t: Tables) -> DataFrame:
    """Within a transaction writes read back at once; one that raises leaves nothing."""
    store = Store(ParquetDriver(t.spark, _folder(t)))
    for region in range(5):
        try:
            with store.tx():
                store.apply([m for m in _creates(t) if m.values["r"] == region])
                own = store.driver.load([m.path for m in _creates(t) if m.values["r"] == region])  # what was just written
                store.apply([Mutation(p, "patch", {"r": x["r"] * 2}) for p, x in own.items()])
                if region == 4:
                    raise RuntimeError
        except RuntimeError:
            continue
    return store.table("app/nations").records().select("id", F.col("r").cast("int").alias("r"))


@register("SELECT concat('app/nations/', CAST(n_nationkey AS VARCHAR)) AS path, CASE WHEN n_regionkey = 2 THEN 'delete' ELSE 'put' END AS type, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS version, CASE WHEN n_regionkey IN (1, 2) THEN 2 ELSE 1 END AS events FROM nation")
def store_watch(t: Tables) -> DataFrame:
    store, seen = Store(MemoryDriver(t.spark)), {}

    def see(event: Event) -> None:
        seen[event.path] = (event.type, event.version, seen.get(event.path, (0, 0, 0))[2] + 1)

    store.watch("app/nations", see)
    store.apply(_creates(t) + _creates(t, "app/unwatched"))
    store.apply([Mutation(m.path, "patch", {"x": 1}) if m.values["r"] == 1 else Mutation(m.path, "delete") for m in _creates(t) if m.values["r"] in (1, 2)])
    return _frame(t, [(p, *x) for p, x in seen.items()], "path string, type string, version int, events int")


@register("SELECT concat('app/nations/', CAST(n_nationkey AS VARCHAR)) AS path, CASE WHEN n_regionkey = 2 THEN 'delete' ELSE 'put' END AS type, CAST(1 AS BIGINT) AS version, CAST(CASE WHEN n_regionkey = 2 THEN 2 ELSE 1 END AS BIGINT) AS changes FROM nation")
def change_log(t: Tables) -> DataFrame:
    """A log written by two processes' worth of logs, one after the other."""
    store, folder = Store(MemoryDriver(t.spark)), _folder(t)
    stop = ChangeLog(t.spark, folder).attach(store, "app/nations")
    store.apply(_creates(t))
    stop()
    ChangeLog(t.spark, folder).attach(store, "app/nations")
    store.apply([Mutation(m.path, "delete") for m in _creates(t) if m.values["r"] == 2])
    return latest(ChangeLog(t.spark, folder).replay())


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey AS stored, CASE WHEN n_regionkey = 0 THEN 100 ELSE n_regionkey END AS shown, n_regionkey AS after FROM nation")
def store_apply_local(t: Tables) -> DataFrame:
    storage = MemoryDriver(t.spark)
    store = _filled(t, storage)
    paths = [m.path for m in _creates(t)]
    undo = store.apply_local([Mutation(m.path, "patch", {"r": 100}) for m in _creates(t) if m.values["r"] == 0])
    shown, stored = {p: store.get(p + "#r") for p in paths}, storage.load(paths)
    undo()
    return _frame(t, [(p.split("/")[2], stored[p]["r"], shown[p], store.get(p + "#r")) for p in paths], "id string, stored int, shown int, after int")


@register("SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 10")
def store_query(t: Tables) -> DataFrame:
    store = _filled(t)
    store.apply([Mutation(f"app/regions/{r.r_regionkey}", "create", {"key": r.r_regionkey, "label": r.r_name}) for r in t.region.df.collect()])
    store.apply([Mutation(f"app/nations/{x['id']}", "patch", {"k": x["k"]}) for x in _nations(t)])
    return store.query(["?a", "?b"], [("app/nations/?n", "r", "?r"), ("app/nations/?n", "name", "?a"), ("app/nations/?n", "k", "?k"), ("app/regions/?x", "key", "?r"), ("app/regions/?x", "label", "?b"), "?k > 10"])


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 3 <> 1 THEN n_name END AS name, CASE WHEN n_nationkey % 3 = 1 THEN 2 ELSE 1 END AS version FROM nation WHERE n_nationkey % 3 <> 0")
def database_tuples(t: Tables) -> DataFrame:
    """Tuples put, read and deleted one by one: of a third of the records all, of a third the name."""
    db = Database(ParquetDriver(t.spark, _folder(t)))
    paths = [m.path for m in _creates(t)]
    store = db.store
    db.put(*[(m.path, a, v) for m in _creates(t) for a, v in m.values.items()])
    db.delete(*[p if int(p.split("/")[2]) % 3 == 0 else p + "#name" for p in paths if int(p.split("/")[2]) % 3 < 2])
    first, known = next(p for p in paths if int(p.split("/")[2]) % 3 == 2), store.driver.load(paths)
    assert db.get(first + "#name") == known[first]["name"] and db.record(first)["id"] == known[first]["_id"]
    rows = [(x["_id"], x.get("name"), x["_version"]) for x in known.values()]
    return _frame(t, rows, "id string, name string, version int")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey = 1 ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 3 OFFSET 1")
def database_list(t: Tables) -> DataFrame:
    db = Database(MemoryDriver(t.spark))
    db.put(*[(m.path, a, v) for m in _creates(t) for a, v in m.values.items()])
    return db.list("app/nations", test=lambda row: row.r == 1, limit=3, offset=1).frame.select("id", "name")


@register("SELECT CAST(k AS VARCHAR) AS id FROM (VALUES (1), (3)) AS v(k)")
def values_of_mixed_types(t: Tables) -> DataFrame:
    """Of records that hold 1, '1', 1.0, true and '1.0', those equal to the number 1."""
    store = Store(MemoryDriver(t.spark))
    store.apply([Mutation(f"app/mixed/{i}", "create", {"x": x}) for i, x in enumerate([1, "1", 1.0, True, "1.0"], 1)])
    return query().from_(m=store.source("app/mixed")).where(lambda r: e.eq(r.m.x, 1)).select(lambda r: {"id": r.m.id}).run()


# --- tables of mutations ---------------------------------------------------------------------------

_BULK = """
WITH before AS (SELECT DISTINCT concat('app/users/', CAST(user_id AS VARCHAR)) AS path FROM events WHERE user_id % 2 = 0),
m AS (
  SELECT concat('app/users/', CAST(user_id AS VARCHAR)) AS path, event_id AS seq, event_type AS attr,
         CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 11 = 0 THEN 'drop' WHEN event_id % 5 = 0 THEN 'put' ELSE 'patch' END AS op FROM events
)"""


def _bulk(t: Tables) -> DataFrame:
    """Events as mutations: every 97th deletes its user, every 11th an attribute, every 5th puts, the others patch."""
    v = t.events.df
    whole, drop = F.col("event_id") % 97 == 0, F.col("event_id") % 11 == 0
    op = F.when(whole | drop, "delete").when(F.col("event_id") % 5 == 0, "put").otherwise("patch")
    attr = F.when(~whole, F.col("event_type"))
    value = F.when(~whole & ~drop, F.col("event_id").cast("string"))
    path = F.concat(F.lit("app/users/"), F.col("user_id").cast("string"))
    return v.select(path.alias("path"), F.col("event_id").alias("seq"), op.alias("op"), attr.alias("attr"), F.when(value.isNotNull(), F.lit("integer")).alias("kind"), value.alias("text"), F.lit(None).cast("long").alias("version"))


def _before(t: Tables) -> DataFrame:
    users = t.events.df.where("user_id % 2 = 0").select(F.concat(F.lit("app/users/"), F.col("user_id").cast("string")).alias("path")).distinct()
    return users


_FOLDED = """, b AS (SELECT path, max(seq) AS barrier FROM m WHERE op IN ('put', 'delete') GROUP BY path),
w AS (
  SELECT path, attr, seq, op FROM m WHERE op <> 'delete'
  UNION ALL SELECT path, unnest(['click', 'kept']), -1, 'old' FROM before
),
k AS (
  SELECT w.path AS path, w.attr AS attr, max(w.seq) AS seq, arg_max(w.op, w.seq) AS op FROM w LEFT JOIN b ON w.path = b.path
  WHERE b.barrier IS NULL OR w.seq >= b.barrier GROUP BY w.path, w.attr
)
SELECT path, attr, CASE WHEN op = 'old' THEN '-7' ELSE CAST(seq AS VARCHAR) END AS text FROM k WHERE op <> 'drop'"""


@register(_BULK + _FOLDED)
def bulk_fold(t: Tables) -> DataFrame:
    """Mutations folded over records that are there, with deletes of attributes."""
    old = _before(t).select("path", F.explode(F.array(F.lit("click"), F.lit("kept"))).alias("attr"), F.lit("-7").alias("text"))
    return fold_mutations(old, _bulk(t).select("path", "seq", "op", "attr", "text"))


_VERSIONED = """, c AS (SELECT path, max(seq) AS cut FROM m WHERE op = 'delete' GROUP BY path),
a AS (SELECT m.path AS path, m.seq AS seq, m.op AS op, c.cut AS cut FROM m LEFT JOIN c ON m.path = c.path WHERE c.cut IS NULL OR m.seq > c.cut),
g AS (SELECT path, min(CASE WHEN op <> 'drop' THEN seq END) AS birth, max(cut) AS cut FROM a GROUP BY path),
v AS (
  SELECT a.path AS path, count(*) FILTER (WHERE o.path IS NOT NULL OR a.seq >= g.birth) + coalesce(max(o.version), 0) AS version
  FROM a JOIN g ON a.path = g.path LEFT JOIN (SELECT path, 4 AS version FROM before) o ON o.path = a.path AND g.cut IS NULL
  WHERE o.path IS NOT NULL OR g.birth IS NOT NULL GROUP BY a.path
)
SELECT path, CAST(version AS BIGINT) AS version FROM v
UNION ALL SELECT path, 4 FROM before WHERE path NOT IN (SELECT path FROM m)"""


@register(_BULK + _VERSIONED)
def bulk_versions(t: Tables) -> DataFrame:
    return fold_versions(_before(t).withColumn("version", F.lit(4).cast("long")), _bulk(t).select("path", "seq", "op", "attr", "text"))


@register(_BULK + _FOLDED.replace("['click', 'kept']", "['kept']"))
def bulk_apply(t: Tables) -> DataFrame:
    """The same through a store over a folder: two tables, the second over what the first has made."""
    store = Store(ParquetDriver(t.spark, _folder(t)))
    first = _before(t).select("path", F.monotonically_increasing_id().alias("seq"), F.lit("create").alias("op"), F.lit("kept").alias("attr"), F.lit("integer").alias("kind"), F.lit("-7").alias("text"), F.lit(None).cast("long").alias("version"))
    store.apply_table(first)
    store.apply_table(_bulk(t))
    return store.driver.tuples("app/users").where(~F.startswith("attr", F.lit("_"))).select("path", "attr", "text")


@register("SELECT * FROM (VALUES ('ALREADY_EXISTS', 25), ('CONFLICT', 25), ('SCHEMA_VIOLATION', 25), ('UNSUPPORTED', 25), ('ok', 25)) AS v(code, records)")
def bulk_errors(t: Tables) -> DataFrame:
    """Tables that are refused leave all records as they were."""
    store = Store(ParquetDriver(t.spark, _folder(t)), [Def("app", "nations", "strict", {"name": FieldDef("string", None, True), "r": FieldDef("integer")})])
    store.apply(_creates(t))
    tables = [
        [("app/nations/30", 1, "create", "name", "string", "a", None), ("app/nations/1", 2, "create", "name", "string", "a", None)],
        [("app/nations/1", 1, "patch", "name", "string", "a", 9)],
        [("app/nations/1", 1, "patch", "r", "string", "many", None), ("app/nations/30", 1, "create", "name", "string", "a", None)],
        [("app/nations/1", 1, "patch", "r", "integer", "1", None), ("app/nations/1", 2, "create", "name", "string", "a", None)],
        [("app/nations/1", 1, "patch", "r", "string", "12", 1)],
    ]
    rows = [(_code(lambda m=m: store.apply_table(_frame(t, m, TABLE))), store.table("app/nations").records().count()) for m in tables]
    return _frame(t, rows, "code string, records int")


@register(
    _STEPS
    + """, o AS (SELECT concat('app/users/', CAST(c_custkey AS VARCHAR)) AS path FROM customer WHERE c_custkey % 3 = 0),
b AS (SELECT path, max(seq) AS barrier FROM m WHERE op IN ('put', 'delete') GROUP BY path),
w AS (SELECT path, attr, seq FROM m WHERE op <> 'delete' UNION ALL SELECT path, 'first', -1 FROM o),
k AS (SELECT w.path, w.attr, max(w.seq) AS seq FROM w LEFT JOIN b ON w.path = b.path WHERE b.barrier IS NULL OR w.seq >= b.barrier GROUP BY w.path, w.attr)
SELECT path, attr, CAST(seq AS VARCHAR) AS text FROM k""",
)
def store_fold_over_records(t: Tables) -> DataFrame:
    old = t.customer.df.where("c_custkey % 3 = 0").select(F.concat(F.lit("app/users/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("first").alias("attr"), F.lit("-1").alias("text"))
    return fold_mutations(old, _event_mutations(t))


# --- collections and transactions ------------------------------------------------------------------


def _collection(t: Tables, **options: Any) -> Collection:
    own = Collection("app/nations", **options)
    own.bind(Store(MemoryDriver(t.spark)))
    return own


@register("SELECT n_name AS name, n_regionkey AS r FROM nation WHERE n_regionkey = 4")
def collection_source(t: Tables) -> DataFrame:
    own = _collection(t)
    own.insert(*[{"id": x["id"], **_values(x)} for x in _nations(t)])
    rows = query().from_(n=own).where(lambda r: e.eq(r.n.r, 4)).select(lambda r: {"name": r.n.name, "r": r.n.r}).run()
    return rows.select("name", F.col("r").cast("int").alias("r"))


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey < 5 THEN 'kept' ELSE n_name END AS name FROM nation")
def collection_initial_data(t: Tables) -> DataFrame:
    """Seed items whose key is taken are left out."""
    store = Store(MemoryDriver(t.spark))
    store.apply([Mutation(f"app/nations/{i}", "create", {"name": "kept"}) for i in range(5)])
    own = Collection("app/nations", initial=[{"id": x["id"], "name": x["name"]} for x in _nations(t)])
    own.bind(store)
    return _frame(t, [(x["id"], x["name"]) for x in own.items()], "id string, name string")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, n_regionkey AS r FROM nation WHERE n_nationkey % 5 <> 0")
def collection_writes(t: Tables) -> DataFrame:
    own = _collection(t)
    items = _nations(t)
    own.insert(*[{"id": x["id"], **_values(x)} for x in items])
    own.update([x["id"] for x in items if x["k"] % 2 == 0], lambda draft: draft.update(name=draft["name"].lower()))
    own.delete(*[x["id"] for x in items if x["k"] % 5 == 0])
    return _frame(t, [(x["id"], x["name"], x["r"]) for x in own.items()], "id string, name string, r int")


@register("SELECT * FROM (VALUES ('a', 'changed'), ('b.x', 'changed'), ('e', 'changed'), ('c', 'gone'), ('b.y', 'gone')) AS v(attr, what)")
def collection_diff(t: Tables) -> DataFrame:
    changed, gone = diff({"id": "1", "a": 1, "b": {"x": 1, "y": 2}, "c": 1, "d": 1.0}, {"id": "1", "a": 2, "b": {"x": 2}, "d": 1, "e": None})
    return _frame(t, [(a, "changed") for a in changed] + [(a, "gone") for a in gone], "attr string, what string")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey AS r FROM nation WHERE n_regionkey <> 2")
def transactions(t: Tables) -> DataFrame:
    """One transaction per region: that of region 2 is rolled back, those of others are committed, by hand or at once."""
    own = _collection(t)
    for region in range(5):
        tx = Transaction(own.store, auto_commit=region % 2 == 1)
        tx.mutate(lambda region=region: own.insert(*[{"id": x["id"], "r": x["r"]} for x in _nations(t) if x["r"] == region]))
        if region == 2:
            tx.rollback()
        elif region % 2 == 0:
            tx.commit()
    return _frame(t, [(x["id"], x["r"]) for x in own.items()], "id string, r int")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey AS r, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS state FROM nation WHERE n_regionkey < 3")
def optimistic_actions(t: Tables) -> DataFrame:
    """Writes appear at once; where persisting them fails, they are taken back."""
    own = _collection(t)
    own.insert(*[{"id": x["id"], "r": x["r"], "state": 1} for x in _nations(t) if x["r"] < 3])

    def persist(region: int, tx: Transaction) -> None:
        if region == 1:
            raise TesseraError("UNAVAILABLE", "no remote end")

    act = optimistic_action(own.store, lambda region: own.update([x["id"] for x in _nations(t) if x["r"] == region], {"state": 2}), persist)
    for region in range(3):
        _code(lambda region=region: act(region))
    return _frame(t, [(x["id"], x["r"], x["state"]) for x in own.items()], "id string, r int, state int")


@register("SELECT * FROM (VALUES ('insert', 25), ('update', 5), ('delete', 5)) AS v(type, n)")
def collection_changes(t: Tables) -> DataFrame:
    own, told = _collection(t), {}

    def see(changes: list) -> None:
        for c in changes:
            told[c.type] = told.get(c.type, 0) + 1

    own.subscribe_changes(see)
    items = _nations(t)
    own.insert(*[{"id": x["id"], **_values(x)} for x in items])
    own.update([x["id"] for x in items if x["r"] == 1], {"r": 7})
    own.delete(*[x["id"] for x in items if x["r"] == 2])
    return _frame(t, list(told.items()), "type string, n int")


@register("SELECT * FROM (VALUES (0, 0), (1, 25), (2, 20)) AS v(call, items)")
def collection_subscribe(t: Tables) -> DataFrame:
    own, told = _collection(t), []
    own.insert({"id": "x", "r": 0})
    own.delete("x")
    own.subscribe(lambda rows: told.append(len(rows)))
    own.insert(*[{"id": x["id"], **_values(x)} for x in _nations(t)])
    own.delete(*[x["id"] for x in _nations(t) if x["r"] == 2])
    return _frame(t, list(enumerate(told)), "call int, items int")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 0 AS calls FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 1 FROM region WHERE r_regionkey <> 3")
def collection_options(t: Tables) -> DataFrame:
    """A local collection calls nobody; a remote one calls for each write, and takes back what is refused."""
    sent: list[str] = []

    def transport(method: str, params: dict) -> dict:
        sent.append(method)
        uri = params["operations"][0]["params"]["uri"]
        return {"results": [{"status": "failed" if uri.endswith("/3") else "ok"}]}

    near, far = local_only("app/nations", on_insert=lambda tx: sent.append("never")), remote("app/regions", transport)
    store = Store(MemoryDriver(t.spark))
    near.bind(store), far.bind(store)
    near.insert(*[{"id": x["id"], "name": x["name"]} for x in _nations(t)])
    rows = [(x["id"], x["name"], len(sent)) for x in near.items()]
    for r in t.region.df.collect():
        _code(lambda r=r: far.insert({"id": str(r.r_regionkey), "name": r.r_name}))
    return _frame(t, rows + [(x["id"], x["name"], len(set(sent))) for x in far.items()], "id string, name string, calls int")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey <> 0")
def json_file(t: Tables) -> DataFrame:
    """A collection kept in a JSON file, read again by another one."""
    folder = _folder(t)
    first = JsonFileCollection("app/nations", f"{folder}/nations.json")
    first.bind(Store(MemoryDriver(t.spark)))
    first.insert(*[{"id": x["id"], "name": x["name"]} for x in _nations(t)])
    first.delete(*[x["id"] for x in _nations(t) if x["r"] == 0])
    again = JsonFileCollection("app/nations", f"{folder}/nations.json")
    again.bind(Store(MemoryDriver(t.spark)))
    return _frame(t, [(x["id"], x["name"]) for x in again.items()], "id string, name string")


@register("SELECT 'meta.deep' AS attr, n_name AS value, n_name AS read FROM nation UNION ALL SELECT 'list', concat('[', CAST(n_regionkey AS VARCHAR), ']'), CAST(n_regionkey AS VARCHAR) FROM nation")
def record_codec(t: Tables) -> DataFrame:
    """Objects as dotted attributes and back, and one place of them read and set."""
    rows = []
    for x in _nations(t):
        whole = {"id": x["id"], "meta": {"deep": x["name"]}, "list": [x["r"]]}
        flat = attributes(whole)
        back = item({"_id": x["id"], **flat})
        put_in(back, "set.here", 1)
        assert back == {**whole, "set": {"here": 1}}
        rows += [("meta.deep", flat["meta.deep"], get_in(back, "meta.deep")), ("list", str(flat["list"]), str(get_in(back, "list")[0]))]
    return _frame(t, rows, "attr string, value string, read string")


# --- sync ------------------------------------------------------------------------------------------


@register("""
SELECT 'records.create' AS method, concat('app/nations/', CAST(n_nationkey AS VARCHAR)) AS uri FROM nation
UNION ALL SELECT 'records.update', concat('app/nations/', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'records.delete', concat('app/nations/', CAST(n_nationkey AS VARCHAR), a) FROM nation, (VALUES ('#name'), ('#r')) AS v(a) WHERE n_regionkey = 2""")
def sync_push(t: Tables) -> DataFrame:
    batch = _creates(t)
    batch += [Mutation(m.path, "patch", {"r": 0}, version=1) if m.values["r"] == 1 else Mutation(m.path, "delete", attrs=("name", "r")) for m in _creates(t) if m.values["r"] in (1, 2)]
    return _frame(t, [(c["method"], c["params"]["uri"]) for c in calls(batch)], "method string, uri string")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 2")
def sync_poll(t: Tables) -> DataFrame:
    """Two rounds: region 1 has changed in the second, region 2 is gone."""
    store = Store(MemoryDriver(t.spark))
    rounds = [
        [{"id": x["id"], "name": x["name"], "_version": 1} for x in _nations(t)],
        [{"id": x["id"], "name": "new" if x["r"] == 1 else x["name"], "_version": 1 + (x["r"] == 1)} for x in _nations(t) if x["r"] != 2],
    ]
    now: list[dict] = []

    def transport(method: str, params: dict) -> dict:
        after = params["offset"] + 10
        return {"items": now[params["offset"] : after], "next_offset": after if after < len(now) else 0}

    puller = Puller(transport, "app/nations", store.apply)
    for rows in rounds:
        now[:] = rows
        puller.poll()
    return store.table("app/nations").records().select("id", "name")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey <> 3 THEN n_name END AS name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS r FROM nation WHERE n_regionkey <> 2")
def sync_stream(t: Tables) -> DataFrame:
    store = Store(MemoryDriver(t.spark))
    frames = [{"event": "ready"}] + [{"event": "record.create", "uri": m.path, "data": m.values} for m in _creates(t)]
    for m in _creates(t):
        frames += [{"event": "record.update", "uri": m.path, "data": {"r": 9}}] * (m.values["r"] == 1)
        frames += [{"event": "record.delete", "uri": m.path}] * (m.values["r"] == 2)
        frames += [{"event": "record.delete", "uri": m.path + "#name"}] * (m.values["r"] == 3)
    store.apply(watch_mutations(frames))
    return store.table("app/nations").records().select("id", "name", F.col("r").cast("int").alias("r"))


# --- live queries ----------------------------------------------------------------------------------


@register("SELECT * FROM (VALUES (0, 0), (1, 25), (2, 20)) AS v(delivery, n)")
def live_coalescing(t: Tables) -> DataFrame:
    """Five commits within a block cost one run; commits that touch nothing read cost none."""
    store, told = Store(MemoryDriver(t.spark)), []
    store.live(lambda q: q.from_(n=store.source("app/nations")).select(lambda r: {"id": r.n.id, "name": r.n.name})).subscribe(lambda rows: told.append(len(rows)))
    with store.coalesce():
        for region in range(5):
            store.apply([m for m in _creates(t) if m.values["r"] == region])
    store.apply([Mutation(m.path, "patch", {"unread": 1}) for m in _creates(t)])
    store.apply(Mutation("app/others/1", "create", {"name": "x"}))
    store.apply([Mutation(m.path, "delete") for m in _creates(t) if m.values["r"] == 0])
    return _frame(t, list(enumerate(told)), "delivery int, n int")


@register("SELECT * FROM (VALUES ('data/nation', '_id'), ('data/nation', 'n_name'), ('data/nation', 'n_regionkey'), ('data/region', '_id'), ('data/region', 'r_regionkey'), ('data/region', 'r_name')) AS v(path, attr)")
def live_footprint(t: Tables) -> DataFrame:
    q = query().from_(n=t.nation).inner_join(lambda r: e.eq(r.n.n_regionkey, r.g.r_regionkey), g=t.region).select(lambda r: {"a": r.n.n_name, "b": r.g.r_name})
    return _frame(t, sorted(q.footprint()), "path string, attr string")


@register("SELECT 'ready' AS status, n_name AS name FROM nation WHERE n_regionkey = 3")
def live_handle(t: Tables) -> DataFrame:
    store = _filled(t)
    handle = LiveHandle(LiveQuery(lambda: query().from_(n=store.source("app/nations")).where(lambda r: e.eq(r.n.r, 3)).select(lambda r: {"name": r.n.name})))
    rows = [(handle.status, x["name"]) for x in handle.rows]
    handle.close()
    return _frame(t, rows, "status string, name string")


# --- what patterns and the builder still lacked -----------------------------------------------------


@register("""
SELECT CAST(a.n_nationkey AS VARCHAR) AS a, r.r_name AS name FROM nation a LEFT JOIN region r ON a.n_regionkey = r.r_regionkey AND r.r_regionkey < 2 WHERE r.r_name IS NOT NULL
UNION ALL SELECT CAST(a.n_nationkey AS VARCHAR), r.r_name FROM nation a, region r WHERE a.n_regionkey >= 2""")
def pattern_unbound_join(t: Tables) -> DataFrame:
    """A variable that an optional part left unbound is compatible with every value."""
    low = table("data/low", t.region.df.where("r_regionkey < 2").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label")), "key")
    return Engine([t.nation, t.region, low]).query(["?a", "?name"], [("data/nation/?a", "n_regionkey", "?r"), {"opt_all": [("data/low/?l", "key", "?r"), ("data/low/?l", "label", "?name")]}, ("data/region/?g", "r_name", "?name")])


@register("""
SELECT CAST(n_nationkey AS VARCHAR) AS n, r_name AS label, CASE WHEN r_regionkey = 0 THEN 'zero' END AS note
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def pattern_nested_opt(t: Tables) -> DataFrame:
    low = table("data/low", t.region.df.where("r_regionkey < 3").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label")), "key")
    notes = table("data/notes", t.region.df.where("r_regionkey = 0").select(F.col("r_regionkey").alias("about"), F.lit("zero").alias("note")), "about")
    inner = [("data/low/?l", "key", "?r"), ("data/low/?l", "label", "?label"), {"opt_all": [("data/notes/?x", "about", "?r"), ("data/notes/?x", "note", "?note")]}]
    return Engine([t.nation, low, notes]).query(["?n", "?label", "?note"], [("data/nation/?n", "n_regionkey", "?r"), {"opt_all": inner}])


@register("SELECT * FROM (VALUES ('unbound', 'INVALID_QUERY'), ('literal', 'INVALID_QUERY'), ('grammar', 'INVALID_QUERY'), ('table', 'INVALID_QUERY'), ('path', 'INVALID_QUERY'), ('clause', 'INVALID_QUERY'), ('good', 'ok')) AS v(what, code)")
def pattern_errors(t: Tables) -> DataFrame:
    first = ("data/region/?r", "r_name", "?name")
    tries = {"unbound": "?other > 1", "literal": "?name == nothing", "grammar": "?name is 1", "table": ("data/none/?x", "a", "?b"), "path": ("data/?x", "a", "?b"), "clause": 7, "good": "?name != 1"}
    return _frame(t, [(k, _code(lambda c=c: Engine([t.region]).query(["?name"], [first, c]))) for k, c in tries.items()], "what string, code string")


@register("SELECT n_nationkey AS k FROM nation WHERE n_nationkey = n_regionkey")
def intra_record_equality(t: Tables) -> Query:
    return query().from_(n=t.nation).where(lambda r: e.eq(r.n.n_nationkey, r.n.n_regionkey)).select(lambda r: {"k": r.n.n_nationkey})


@register("SELECT p_partkey AS k, concat(p_brand, '!') AS loud FROM part WHERE p_size % 7 = 3")
def fn_in_python(t: Tables) -> DataFrame:
    """Ordinary functions as test and projection."""
    made = query().from_(p=t.part).fn_where(in_python(lambda row: row["p"]["p_size"] % 7 == 3)).select(lambda r: {"k": r.p.p_partkey, "b": r.p.p_brand})
    return made.fn_select(in_python(lambda row: {"k": row["k"], "loud": row["b"] + "!"}, "k long, loud string")).run()


@register("SELECT n_name AS name FROM nation ORDER BY n_regionkey, CAST(n_nationkey AS VARCHAR) LIMIT 7")
def order_ties(t: Tables) -> Query:
    return query().from_(n=t.nation).select(lambda r: {"name": r.n.n_name}).order_by(lambda r: r.n.n_regionkey).limit(7)


@register("SELECT o_orderkey AS k, CAST(9007199254740993 // 2 AS VARCHAR) AS half FROM orders WHERE o_orderkey < 10")
def divide_large(t: Tables) -> DataFrame:
    orders = t.orders
    wide = table(orders.path, orders.df.withColumn("big", F.lit("9007199254740993").cast("decimal(38,0)")), "o_orderkey")
    made = query().from_(o=wide).where(lambda r: e.lt(r.o.o_orderkey, 10)).select(lambda r: {"k": r.o.o_orderkey, "half": e.divide(r.o.big, 2)})
    return made.run().withColumn("half", F.col("half").cast("string"))
