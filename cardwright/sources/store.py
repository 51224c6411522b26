"""A store of tables as Parquet versions with a manifest, and table edits as plans: append, publish, upsert, cascade, seed, import.

A version is a folder that holds all tables written together, published by a manifest of the next number, which is renamed
into place and never changed: readers take the last one, so they see all of a version or none. There is one writer at a time.
"""

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import CHILDREN, REFERENCES, TABLES


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _last(self) -> int:
        """The number of the last manifest, 0 for none."""
        fs, p = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)

    def _manifest_path(self, n: int) -> str:
        return f"{self.path}/manifest-{n:09d}.json"

    def manifest(self) -> dict[str, list[str]]:
        """Table -> folders that make it up."""
        n = self._last()
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self._manifest_path(n)).collect())) if n else {}

    def read(self, table: str) -> DataFrame:
        folders = self.manifest().get(table, [])
        reader = self.spark.read.schema(TABLES[table])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[table])

    def lookup(self, table: str, value: int | str, key: str = "id") -> DataFrame:
        """Rows with a key; the filter reaches the Parquet scan."""
        return self.read(table).where(F.col(key) == value)

    def write(self, tables: Mapping[str, DataFrame], append: bool = False) -> None:
        """Write several tables, all or nothing: a failed write leaves the manifest, and so what readers see, as it was."""
        version = f"{self.path}/{uuid.uuid4().hex}"
        after = self.manifest()
        for name, df in tables.items():
            if unknown := set(df.columns) - set(self.spark.createDataFrame([], TABLES[name]).columns):
                raise ValueError(f"{name} has no column {sorted(unknown)}")
            folder = f"{version}/{name}"
            conform(df, name).write.parquet(folder)
            after[name] = [*(after.get(name, []) if append else []), folder]
        fs, target = self._fs(self._manifest_path(self._last() + 1))
        _, fresh = self._fs(f"{version}/manifest.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if not fs.rename(fresh, target):
            raise RuntimeError(f"another writer published {target.getName()}")


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with all columns of the table in order; absent ones are null."""
    fields = df.sparkSession.createDataFrame([], TABLES[table]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new, allowMissingColumns=True)


def update(rows: DataFrame, patches: DataFrame, key: str, clear: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the non-null values of ``patches`` in rows of equal key; of columns in ``clear`` null values too."""
    given = [c for c in patches.columns if c != key]
    p = patches.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in given))
    out = rows.join(p, rows[key] == p["_key"], "left")
    new = lambda c: F.when(F.col("_hit").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in clear else F.coalesce(f"_{c}", c)
    return out.select(*(new(c).alias(c) if c in given else F.col(c) for c in rows.columns))


def upsert(rows: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """``rows`` and ``new``, of equal keys the new one; of several new ones the first by ``order``."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), *([order] if order is not None else []))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def delete_cascade(tables: Mapping[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without rows ``ids`` (id) of ``table`` and what hangs on them, down the tree; references marked so become null."""
    out, gone = dict(tables), {table: ids.select("id").distinct()}
    out[table] = out[table].join(gone[table], "id", "left_anti").select(out[table].columns)
    for child in ("source_documents", "extractions", *CHILDREN):
        if child not in out:
            continue
        rows, dropped = out[child], None
        for parent, column, action in REFERENCES[child]:
            if parent not in gone:
                continue
            lost = gone[parent].select(F.col("id").alias(column))
            if action == "cascade":
                mine = rows.join(lost, column, "left_semi").select("id")
                dropped = mine if dropped is None else dropped.union(mine)
                rows = rows.join(lost, column, "left_anti")
            else:
                marked = rows.join(lost.withColumn("_lost", F.lit(True)), column, "left")
                rows = marked.withColumn(column, F.when(F.col("_lost").isNull(), F.col(column)))
        out[child] = rows.select(tables[child].columns)
        if dropped is not None:
            gone[child] = dropped.distinct()
    return out


def seed(rows: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``defaults`` whose key is not there yet."""
    return rows.unionByName(defaults.join(rows.select(key), key, "left_anti").select(rows.columns))


def backfill(rows: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """``rows`` with values of ``defaults`` where theirs are null or empty texts."""
    given = [c for c in defaults.columns if c != key]
    d = defaults.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in given))
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    out = rows.join(d, rows[key] == d["_key"], "left")
    return out.select(*(F.when(empty(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in rows.columns))


def valid_sessions(sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, expired): a session is valid to its expiry."""
    return sessions.where(F.col("expire") >= now), sessions.where(F.col("expire") < now)


#: What an exported document of version 1 holds, as far as an import reads it.
EXPORT = """
version string, data array<struct<
  project: struct<name: string, description: string, createdAt: string>,
  sourceDocuments: array<struct<id: long, kind: string, filename: string, content: string>>,
  modelCards: array<struct<
    extraction: struct<providerUsed: string, status: string, modelCardTitle: string, domain: string, systemDescription: string, problemStatement: string, odeTemplate: string>,
    equations: array<struct<ordinal: int, latex: string, description: string, sourceQuote: string>>,
    variables: array<struct<ordinal: int, symbol: string, name: string, unit: string, role: string, sourceQuote: string>>,
    parameters: array<struct<ordinal: int, symbol: string, name: string, value: double, unit: string, confidence: string, sourceQuote: string>>,
    assumptions: array<struct<ordinal: int, kind: string, text: string, sourceQuote: string>>>>>>
"""


def import_rows(documents: DataFrame, existing: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """Rows of projects, sources, extractions and children from exported documents (column ``json``).

    Only version 1 is read. Nothing is imported into a store with projects unless ``force``; then projects whose name is
    there already are skipped. Providers but openai and gemini become mock, absent status, role and confidence get their
    defaults, absent values 0. Rows are numbered by project name and place, so a rerun gives the same ids.
    """
    doc = documents.select(F.from_json("json", EXPORT).alias("d")).where("d.version = '1'").select(F.posexplode("d.data").alias("at", "p"))
    doc = doc.where(F.col("p.project.name").isNotNull())
    if not force and existing.limit(1).count():
        doc = doc.limit(0)
    doc = doc.join(existing.select(F.col("name").alias("_name")), F.col("p.project.name") == F.col("_name"), "left_anti")
    doc = doc.withColumn("project_id", F.xxhash64("p.project.name", "at"))
    projects = doc.select(F.col("project_id").alias("id"), F.col("p.project.name").alias("name"), F.coalesce("p.project.description", F.lit("")).alias("description"), F.lit("public").alias("visibility"), F.to_timestamp("p.project.createdAt").alias("created_at"))
    sources = doc.select("project_id", F.posexplode("p.sourceDocuments").alias("n", "s")).select(F.xxhash64("project_id", F.lit("s"), "n").alias("id"), "project_id", "s.kind", "s.filename", "s.content")
    card = doc.select("project_id", F.posexplode("p.modelCards").alias("n", "c")).withColumn("extraction_id", F.xxhash64("project_id", F.lit("c"), "n"))
    e = F.col("c.extraction")
    provider = F.when(e["providerUsed"].isin("openai", "gemini"), e["providerUsed"]).otherwise("mock")
    text = lambda f, name: F.coalesce(e[f], F.lit("")).alias(name)
    extractions = card.select(F.col("extraction_id").alias("id"), "project_id", provider.alias("provider_used"), F.coalesce(e["status"], F.lit("ready")).alias("status"), text("modelCardTitle", "model_card_title"), text("domain", "domain"), text("systemDescription", "system_description"), text("problemStatement", "problem_statement"), text("odeTemplate", "ode_template"))

    def children(name: str, *columns: Column) -> DataFrame:
        rows = card.select("extraction_id", F.posexplode(f"c.{name}").alias("n", "x"))
        return rows.select(F.xxhash64("extraction_id", F.lit(name), "n").alias("id"), "extraction_id", F.coalesce("x.ordinal", "n").alias("ordinal"), *columns, F.coalesce("x.sourceQuote", F.lit("")).alias("source_quote"))

    x = lambda f, default="": F.coalesce(f"x.{f}", F.lit(default)).alias(f)
    return {
        "projects": projects, "source_documents": sources, "extractions": extractions,
        "equations": children("equations", x("latex"), x("description")),
        "variables": children("variables", x("symbol"), x("name"), F.col("x.unit").alias("unit"), x("role", "state")),
        "parameters": children("parameters", x("symbol"), x("name"), F.coalesce("x.value", F.lit(0.0)).alias("value"), F.col("x.unit").alias("unit"), x("confidence", "medium")),
        "assumptions": children("assumptions", x("kind", "assumption"), x("text")),
    }
