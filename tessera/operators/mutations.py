"""Bulk mutations: a whole table of them folded into a table of tuples, without a driver-side loop.

Mutations are rows (path, seq, op, attr, text): one per written attribute of a create, put or patch, one
per deleted attribute, and one without ``attr`` for a whole delete or an empty put. ``seq`` orders them
and is one number per mutation. The last put or whole delete of a path is its barrier: what is before it
does not count.

Hot paths are summed up map-side by path and attribute before anything is joined by path; the few joins of
single mutations by path are salted, so that no path's mutations meet in one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tessera.catalog import Def, FieldDef
from tessera.errors import TesseraError
from tessera.session import stage
from tessera.sources.drivers import Driver
from tessera.values import to_text

MUTATIONS = "path string, seq long, op string, attr string, text string"
#: What a store applies: values with their types, and on a path's first mutation the version it expects (or null).
TABLE = "path string, seq long, op string, attr string, kind string, text string, version long"
SALTS = 16
#: Errors that are named in the message of a refused table.
SHOWN = 20


def fold_mutations(current: DataFrame, mutations: DataFrame, values: tuple[str, ...] = ("text",)) -> DataFrame:
    """Tuples (path, attr, values) after all mutations of tuples before them.

    A path and attribute's last write counts unless the path's barrier is later, so that writes are folded
    first, in one pass over the mutations, and only the folded rows meet the barriers.
    """
    value = F.struct(*values)
    wiping = (F.col("op") == "put") | ((F.col("op") == "delete") & F.col("attr").isNull())
    old = current.select("path", "attr", F.lit(-1).cast("long").alias("seq"), value.alias("x"), F.lit(False).alias("gone"), F.lit(None).cast("long").alias("wipe"))
    new = mutations.select("path", "attr", "seq", value.alias("x"), (F.col("op") == "delete").alias("gone"), F.when(wiping, F.col("seq")).alias("wipe"))
    last = old.unionByName(new).groupBy("path", "attr").agg(F.max_by(F.struct("x", "gone"), "seq").alias("last"), F.max("seq").alias("seq"), F.max("wipe").alias("wipe"))
    barriers = last.groupBy("path").agg(F.max("wipe").alias("barrier"))
    kept = last.where("attr is not null").join(barriers, "path").where("(barrier is null or seq >= barrier) and not last.gone")
    return kept.select("path", "attr", *[F.col(f"last.x.{v}").alias(v) for v in values])


def _salted(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """A join by path of single mutations with one row per path, which is repeated for each salt."""
    repeated = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod("seq", F.lit(SALTS).cast("long"))).join(repeated, ["path", "salt"], how).drop("salt")


def fold_versions(current: DataFrame, mutations: DataFrame) -> DataFrame:
    """Versions (path, version) of the records that are left, from (path, version) before.

    Each mutation of an existing record, and each that makes one, adds one; a record made anew after a
    whole delete starts at 1; deletes of absent records count for nothing.
    """
    steps = mutations.groupBy("path", "seq").agg(F.first("op").alias("op"), F.bool_and(F.col("attr").isNull() & (F.col("op") == "delete")).alias("whole"))
    cuts = steps.where("whole").groupBy("path").agg(F.max("seq").alias("cut"))
    after = _salted(steps, cuts, "left").where("cut is null or seq > cut")
    drop = F.col("op") == "delete"
    sums = after.groupBy("path").agg(F.count("*").alias("n"), F.count_if(drop).alias("drops"), F.min(F.when(~drop, F.col("seq"))).alias("birth"), F.max("cut").alias("cut"))
    known = sums.join(current, "path", "left").withColumn("base", F.when(F.col("cut").isNull(), F.col("version")))
    # a record that was not there: what deletes its attributes before it is made counts for nothing
    births = known.where("base is null and drops > 0").select("path", "birth")
    early = _salted(after.where(drop).select("path", "seq"), births, "inner").where("birth is null or seq < birth").groupBy("path").agg(F.count("*").alias("early"))
    counted = known.where("base is not null or birth is not null").join(early, "path", "left")
    touched = counted.select("path", (F.coalesce("base", F.lit(0)) + F.col("n") - F.coalesce("early", F.lit(0))).cast("long").alias("version"))
    rest = current.join(mutations.select("path").distinct(), "path", "left_anti")
    return touched.unionByName(rest.select("path", "version"))


# --- tables applied to a store ---------------------------------------------------------------------


def _coerced(kind: Column, text: Column, wanted: Column) -> Column:
    """(kind, text) as a declared type takes it; null where it does not."""
    number = kind.isin("integer", "float", "unsigned")
    trimmed = F.trim(text)
    whole = F.when(number, F.when(text.try_cast("double") == F.floor(text.try_cast("double")), text.try_cast("decimal(38,0)"))).when((kind == "string") & trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("decimal(38,0)"))
    real = F.when(number | (kind == "string"), trimmed.try_cast("double"))
    time = F.when(kind == "time", text).when(number, F.date_format(F.timestamp_millis(text.try_cast("double").cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).when(kind == "string", F.when(trimmed.try_cast("timestamp").isNotNull(), F.date_format(trimmed.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    same = wanted.isin("string", "boolean", "bytes", "array") & (kind == wanted)
    out = F.when(kind == "null", text).when(same | (wanted == "json"), text)
    out = out.when(wanted == "integer", whole.cast("string")).when((wanted == "unsigned") & (whole >= 0), whole.cast("string"))
    out = out.when(wanted == "float", real.cast("string")).when(wanted == "time", time)
    fits = (kind == "null") | out.isNotNull()
    own = F.when(kind == "null", F.lit("null")).when(wanted == "json", kind).when(wanted == "unsigned", F.lit("integer")).otherwise(wanted)
    return F.struct(own.alias("kind"), out.alias("text"), fits.alias("fits"))


def _grown(defs: dict[str, Def], writes: DataFrame) -> dict[str, Def]:
    """The definitions with the attributes that a table adds to dynamic ones: of each, the type of its first value."""
    out = dict(defs)
    dynamic = [p for p, d in defs.items() if d.mode == "dynamic"]
    if not dynamic:
        return out
    fresh = writes.where(F.col("schema").isin(dynamic) & (F.col("kind") != "null") & ~F.startswith("attr", F.lit("_")))
    for r in fresh.groupBy("schema", "attr").agg(F.min_by("kind", F.struct("seq", "path")).alias("kind")).collect():
        own = out[r.schema]
        if r.attr not in own.fields:
            out[r.schema] = Def(own.ns, own.schema, own.mode, {**own.fields, r.attr: FieldDef(r.kind, "json" if r.kind == "array" else None)})
    return out


def _declared(defs: dict[str, Def], rows: DataFrame) -> DataFrame:
    """Rows of values with ``declared``, the type of their attribute, and ``strict``, by broadcast of the definitions."""
    spark = rows.sparkSession
    fields = [(p, a, f.type, f.required) for p, d in defs.items() for a, f in d.fields.items()]
    known = spark.createDataFrame(fields, "schema string, attr string, declared string, required boolean")
    strict = [p for p, d in defs.items() if d.mode == "strict"]
    return rows.join(F.broadcast(known), ["schema", "attr"], "left").withColumn("strict", F.col("schema").isin(strict) if strict else F.lit(False))


def apply_table(driver: Driver, mutations: DataFrame, now: datetime) -> tuple[DataFrame, set[str]]:
    """Check, fold and write a table of mutations (TABLE), all or none; its events, and the schemas it touched.

    Creates, and expected versions, belong to a path's first mutation in the table. Values are held against the
    definitions, which grow in dynamic mode; required attributes are looked for in the records as they come out.
    """
    m = stage(mutations.select(*[x.split()[0] for x in TABLE.split(", ")]).withColumn("schema", F.substring_index("path", "/", 2)), "mutations")
    paths = {r[0] for r in m.select("schema").distinct().collect()}
    current = None
    for path in sorted(paths):
        rows = driver.tuples(path)
        current = rows if current is None else current.unionByName(rows)
    if current is None:
        return m.select("path", F.lit("").alias("type"), "version").limit(0), set()
    before = current.where("attr = '_version'").select("path", F.col("text").cast("long").alias("version"))
    there = current.groupBy("path").agg(F.max(F.when(F.col("attr") == "_version", F.col("text").cast("long"))).alias("now"))
    known = driver.defs()
    writes = m.where("op <> 'delete' and attr is not null")
    defs = _grown({p: known[p] for p in paths if p in known}, writes)
    typed = _declared(defs, writes)
    wanted = F.when(F.col("declared").isNotNull() & ~F.startswith("attr", F.lit("_")), F.col("declared"))
    typed = typed.withColumn("c", F.when(wanted.isNotNull(), _coerced(F.col("kind"), F.col("text"), wanted)).otherwise(F.struct(F.col("kind"), F.col("text"), F.lit(True).alias("fits"))))
    firsts = m.groupBy("path").agg(F.min("seq").alias("first"))
    marked = m.where("op = 'create' or version is not null").select("path", "seq", "op", "version").distinct().join(firsts, "path").join(there, "path", "left")
    error = lambda rows, code, message: rows.select("path", F.lit(code).alias("code"), message.alias("message"))
    system = F.startswith("attr", F.lit("_"))
    problems = [
        error(m.where("op is null or op not in ('create', 'put', 'patch', 'delete') or seq is null or path is null or size(split(path, '/')) < 3"), "INVALID_URI", F.lit("no mutation of a record")),
        error(typed.where(F.col("strict") & F.col("declared").isNull() & ~system), "SCHEMA_VIOLATION", F.concat("attr", F.lit(" is not declared"))),
        error(typed.where("not c.fits"), "SCHEMA_VIOLATION", F.concat("attr", F.lit(" is not of type "), "declared")),
        error(_declared(defs, m.where("op = 'delete' and attr is not null")).where("required"), "SCHEMA_VIOLATION", F.concat("attr", F.lit(" is required"))),
        error(marked.where("seq > first and (op = 'create' or version <> 0)"), "UNSUPPORTED", F.lit("a create or an expected version after other mutations of the path")),
        error(marked.where("seq = first and op = 'create' and there is not null".replace("there", "now")), "ALREADY_EXISTS", F.lit("the path is taken")),
        error(marked.where("seq = first and version <> 0 and version <> coalesce(now, 0)"), "CONFLICT", F.concat(F.lit("the version is "), F.coalesce("now", F.lit(0)).cast("string"))),
    ]
    clean = typed.select("path", "seq", "op", "attr", F.col("c.kind").alias("kind"), F.col("c.text").alias("text")).unionByName(m.where("op = 'delete' or attr is null").select("path", "seq", "op", "attr", "kind", "text"))
    versions = fold_versions(before, m)
    touched = m.select("path").distinct()
    made = versions.join(touched, "path", "left_semi")
    plain = current.where(~system).select("path", "attr", "kind", "text").join(touched, "path", "left_semi")
    folded = fold_mutations(plain, clean, ("kind", "text")).where(~system).join(made.select("path"), "path", "left_semi")
    stamp = lambda attr, kind, text: F.struct(F.lit(attr).alias("attr"), F.lit(kind).alias("kind"), text.alias("text"))
    stamps = F.array(stamp("_id", "string", F.regexp_replace("path", "^[^/]*/[^/]*/", "")), stamp("_version", "integer", F.col("version").cast("string")), stamp("_updated", "time", F.lit(to_text(now)[1])))
    fresh = stage(folded.unionByName(made.select("path", F.explode(stamps).alias("s")).select("path", "s.*")), "folded")
    required = [(p, a) for p, d in defs.items() for a, f in d.fields.items() if f.required]
    if required:
        needs = driver.spark.createDataFrame(required, "schema string, attr string")
        owed = made.withColumn("schema", F.substring_index("path", "/", 2)).join(F.broadcast(needs), "schema").join(fresh.select("path", "attr"), ["path", "attr"], "left_anti")
        problems.append(error(owed, "SCHEMA_VIOLATION", F.concat("attr", F.lit(" is required"))))
    found = problems[0]
    for p in problems[1:]:
        found = found.unionByName(p)
    shown = found.orderBy("code", "path").limit(SHOWN).collect()
    if shown:
        issues = [{"path": r.path or "", "message": f"{r.code}: {r.message}"} for r in shown]
        raise TesseraError(shown[0].code, f"{shown[0].path}: {shown[0].message}", uri=shown[0].path, issues=issues)
    events = m.groupBy("path").agg(F.array_sort(F.collect_set("attr")).alias("attrs")).join(versions, "path", "left").join(there, "path", "left")
    events = events.where("version is not null or now is not null")
    events = stage(events.select("path", F.when(F.col("version").isNotNull(), "put").otherwise("delete").alias("type"), F.coalesce("version", "now").alias("version"), "attrs"), "events")
    parts = F.split("path", "/", 3)
    whole = fresh.select("path", parts[0].alias("ns"), parts[1].alias("schema"), parts[2].alias("id"), "attr", "kind", "text")
    for path in sorted(paths):
        rest = driver.tuples(path).join(touched, "path", "left_anti")
        own = whole.where((F.col("ns") == path.split("/")[0]) & (F.col("schema") == path.split("/")[1]))
        driver.write_base(path, stage(rest.unionByName(own), "base"))
    if defs != {p: known[p] for p in defs}:
        driver.save_defs({**known, **defs})
    return events, paths
