"""Projects, their sources and extractions: visibility, summaries, nested cards, search and shares."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import trim_all
from cardwright.sources.tables import CHILDREN, TABLES


def can_view(user: str | None) -> Column:
    """Public, without owner, or the user's own."""
    open_to_all = (F.col("visibility") == "public") | F.col("owner_id").isNull()
    return open_to_all if user is None else open_to_all | (F.col("owner_id") == user)


def can_change(user: str | None) -> Column:
    """Without owner, or the user's own."""
    free = F.col("owner_id").isNull()
    return free if user is None else free | (F.col("owner_id") == user)


def visible(projects: DataFrame, user: str | None) -> DataFrame:
    return projects.where(can_view(user))


def last_updated_first(rows: DataFrame) -> DataFrame:
    """The order in which projects are listed. A whole table is sorted only where a caller asks for it, best after a limit or filter."""
    return rows.orderBy(F.desc("updated_at"), F.desc("id"))


def counted(projects: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``projects`` with the number of ``rows`` of each (project_id), 0 for none; rows are counted before the join."""
    n = rows.groupBy("project_id").agg(F.count("*").alias(name))
    return projects.join(n, projects["id"] == n["project_id"], "left").drop("project_id").withColumn(name, F.coalesce(name, F.lit(0)))


def latest(extractions: DataFrame, *columns: str) -> DataFrame:
    """(project_id, columns) of each project's latest extraction; of equal times the greatest id."""
    value = F.struct(*columns)
    return extractions.groupBy("project_id").agg(F.max_by(value, F.struct("created_at", "id")).alias("v")).select("project_id", "v.*")


def summaries(projects: DataFrame, sources: DataFrame, extractions: DataFrame, user: str | None = None) -> DataFrame:
    """One row a visible project: its columns, both counts and the latest extraction's title."""
    shown = counted(counted(projects.where(can_view(user)), sources, "source_document_count"), extractions, "extraction_count")
    last = latest(extractions, "model_card_title").withColumnRenamed("model_card_title", "latest_extraction_title")
    return shown.join(last, shown["id"] == last["project_id"], "left").drop("project_id")


def totals(projects: DataFrame, sources: DataFrame, extractions: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(projects, "projects").crossJoin(n(extractions, "extractions")).crossJoin(n(sources, "sources"))


def cards(extractions: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Extractions with their equations, variables, parameters and assumptions nested, each in the order of (ordinal, id); without any, empty arrays.

    Extractions and children are dealt by card together, as rows of one table that tell what they are, so there is one exchange however many kinds of children there are.
    """
    kinds = {}
    for name, rows in children.items():
        columns = [c for c in rows.columns if c != "extraction_id"]
        kinds[name] = rows.where(F.col("extraction_id").isNotNull()).select(F.col("extraction_id").alias("card"), F.struct("ordinal", "id", *(c for c in columns if c not in ("ordinal", "id"))).alias("row"))
    parts = [extractions.select(F.col("id").alias("card"), F.struct(*extractions.columns).alias("row")), *kinds.values()]
    types = [part.schema["row"].dataType for part in parts]
    part = lambda k: F.struct(F.lit(k).alias("kind"), *((F.col("row") if i == k else F.lit(None).cast(t)).alias(f"of_{i}") for i, t in enumerate(types)))
    union = reduce(DataFrame.union, (df.select("card", part(k).alias("x")) for k, df in enumerate(parts)))
    own = lambda k: F.transform(F.filter("all", lambda x: x["kind"] == k), lambda x: x[f"of_{k}"])
    dealt = union.groupBy("card").agg(F.collect_list("x").alias("all"))
    nested_rows = dealt.select(F.explode(own(0)).alias("card"), *(F.array_sort(own(k)).alias(name) for k, name in enumerate(kinds, 1)))
    return nested_rows.select("card.*", *kinds)


def latest_card(extractions: DataFrame, children: dict[str, DataFrame], project_id: int) -> DataFrame:
    own = extractions.where(F.col("project_id") == project_id)
    return cards(own.orderBy(F.desc("created_at"), F.desc("id")).limit(1), children)


def owned(extractions: DataFrame, projects: DataFrame, user: str | None) -> DataFrame:
    """Extractions of projects that the user may see, with their project."""
    p = projects.where(can_view(user)).select(F.col("id").alias("project_id"), "owner_id", "visibility", F.col("name").alias("project_name"))
    return extractions.join(p, "project_id")


def with_source(extractions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, rejected): extractions with their source's kind and content; those whose source is another project's or absent are rejected with 400."""
    s = sources.select(F.col("id").alias("source_document_id"), F.col("project_id").alias("source_project_id"), "kind", "content")
    all_rows = extractions.join(s, "source_document_id", "left")
    good = F.coalesce(F.col("source_project_id") == F.col("project_id"), F.lit(False))
    return all_rows.where(good).drop("source_project_id"), all_rows.where(~good).select("id", "source_document_id", F.lit(400).alias("status_code"))


def shared(extractions: DataFrame, projects: DataFrame, children: dict[str, DataFrame], extraction_id: int) -> DataFrame:
    """The card of an extraction anyone may see, without its prompts and the provider's raw answer."""
    one = owned(extractions.where(F.col("id") == extraction_id), projects, None).drop("owner_id", "visibility", "project_name")
    blank = {c: F.lit("") for c in ("system_prompt", "prompt_template_summary", "raw_provider_response")}
    return cards(one.withColumns(blank), children)


def search(summary: DataFrame, term: str) -> DataFrame:
    """Summaries whose name or latest title contains the term; a blank term keeps all."""
    t = (term or "").strip().lower()
    if not t:
        return summary
    found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)) for c in ("name", "latest_extraction_title")]
    return summary.where(found[0] | found[1])


def of_kind(assumptions: DataFrame, kind: str) -> DataFrame:
    return assumptions.where(F.col("kind") == kind)


def edited_count(children: dict[str, DataFrame]) -> DataFrame:
    """(extraction_id, edited): user-edited rows over all child tables."""
    rows = [df.select("extraction_id", "edited_by_user") for df in children.values()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("extraction_id").agg(F.count_if("edited_by_user").alias("edited"))


def created(new: DataFrame, user: str | None, now: Column) -> DataFrame:
    """Rows of new projects (id, name, description): the user's own and private, or public without owner."""
    return new.select(
        "id", "name", F.coalesce("description", F.lit("")).alias("description"), F.lit(user).cast("string").alias("owner_id"), F.lit("public" if user is None else "private").alias("visibility"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def effective_type(override: str = "model_type_override", detected: str = "model_type") -> Column:
    from cardwright.sources.tables import MODEL_TYPES

    chosen = F.coalesce(override, detected)
    return F.when(chosen.isin(*MODEL_TYPES), chosen).otherwise(F.lit("generic_ode"))


def export_project(projects: DataFrame, sources: DataFrame, extractions: DataFrame, children: dict[str, DataFrame], now: str) -> DataFrame:
    """One JSON document a project: (project_id, json) with the project, its sources and its cards, nulls kept."""
    src = sources.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "kind", "filename", "content"))).alias("sourceDocuments"))
    card = cards(extractions, children)
    body = F.struct("created_at", F.col("id"), F.struct(*(c for c in TABLES_COLUMNS if c in card.columns)).alias("extraction"), *CHILDREN)
    nested_cards = card.groupBy("project_id").agg(F.array_sort(F.collect_list(body), lambda a, b: F.when(a["created_at"] < b["created_at"], -1).when(a["created_at"] > b["created_at"], 1).otherwise(F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))).alias("modelCards"))
    nested_cards = nested_cards.withColumn("modelCards", F.transform("modelCards", lambda c: F.struct(c["extraction"].alias("extraction"), *(c[k].alias(k) for k in CHILDREN))))
    out = projects.join(src, projects["id"] == src["project_id"], "left").drop("project_id")
    out = out.join(nested_cards, out["id"] == nested_cards["project_id"], "left").drop("project_id")
    project = F.struct(*(c for c in projects.columns))
    doc = F.struct(project.alias("project"), F.coalesce("sourceDocuments", F.array().cast(src.schema["sourceDocuments"].dataType)).alias("sourceDocuments"), F.coalesce("modelCards", F.array().cast(nested_cards.schema["modelCards"].dataType)).alias("modelCards"), F.lit(now).alias("exportedAt"))
    return out.select(F.col("id").alias("project_id"), "created_at", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def export_all(projects: DataFrame, sources: DataFrame, extractions: DataFrame, children: dict[str, DataFrame], now: str) -> DataFrame:
    """(part, project_count, json): the whole store as documents of version 1, which ``store.import_rows`` reads; no document holds more than one
    project, as one document of a large store would have to pass through one task. Names of fields are those of the format; nulls are kept."""
    camel = lambda c: "".join(x.title() if k else x for k, x in enumerate(c.split("_")))
    fields = lambda df, *skip: F.struct(*(F.col(c).alias(camel(c)) for c in df.columns if c not in skip))
    in_order = lambda df, key, name, *by: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, fields(df).alias("x")))), lambda s: s["x"]).alias(name))
    cards_ = extractions
    for name in CHILDREN:
        inner = in_order(children[name], "extraction_id", name, "ordinal", "id")
        cards_ = cards_.join(inner, cards_["id"] == inner["extraction_id"], "left").drop("extraction_id").withColumn(name, F.coalesce(name, F.array().cast(inner.schema[name].dataType)))
    card = F.struct(*(F.col(c) for c in ("created_at", "id") if c in extractions.columns), F.struct(fields(extractions).alias("extraction"), *CHILDREN).alias("x"))
    nested_cards = cards_.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", F.to_json(card["x"], {"ignoreNullFields": "false"}).alias("x")))), lambda s: s["x"]).alias("cards"))
    src = in_order(sources, "project_id", "docs", "created_at", "id")
    out = projects.withColumn("project", F.to_json(fields(projects), {"ignoreNullFields": "false"}))
    out = out.join(src, out["id"] == src["project_id"], "left").drop("project_id")
    out = out.join(nested_cards, out["id"] == nested_cards["project_id"], "left").drop("project_id")
    docs = F.coalesce(F.to_json("docs", {"ignoreNullFields": "false"}), F.lit("[]"))
    cards_json = F.concat(F.lit("["), F.array_join(F.coalesce("cards", F.array().cast("array<string>")), ","), F.lit("]"))
    entry = F.concat(F.lit('{"project":'), F.col("project"), F.lit(',"sourceDocuments":'), docs, F.lit(',"modelCards":'), cards_json, F.lit("}"))
    head = F.concat(F.lit('{"exportedAt":'), F.to_json(F.array(F.lit(now))).substr(2, len(now) + 2), F.lit(',"version":"1","projectCount":1,"data":['))
    return out.select(F.col("id").alias("part"), F.lit(1).alias("project_count"), F.concat(head, entry, F.lit("]}")).alias("json"))


#: Fewest characters of texts, and closed values, of requests by kind. Fixed values.
REQUESTS = {
    "project": {"name": ("text", 1)}, "source": {"project_id": ("id", 1), "content": ("text", 30)},
    "extraction": {"project_id": ("id", 1), "provider": ("value", ("auto", "mock", "openai", "gemini", "ollama")), "source_document_id": ("optional id", 1)},
    "visibility": {"id": ("id", 1), "visibility": ("value", ("private", "public"))},
}


def requested(requests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): requests of a kind; those with ids that are no whole positive numbers, texts too short or unknown values are rejected with 400 and the fields at fault."""
    wrong = []
    for name, (rule, value) in REQUESTS[kind].items():
        c = F.col(name)
        if rule == "value":
            bad = c.isNotNull() & ~c.isin(*value) if name == "provider" else ~F.coalesce(c.isin(*value), F.lit(False))
        elif rule == "text":
            bad = F.length(trim_all(F.coalesce(c, F.lit("")))) < value
        else:
            bad = ~F.coalesce(c.cast("string").rlike("^[0-9]+$") & (c.try_cast("long") >= value), F.lit(False))
            bad = c.isNotNull() & bad if rule == "optional id" else bad
        wrong.append(F.when(bad, F.lit(name)))
    out = requests.withColumn("fields", F.array_compact(F.array(*wrong)))
    bad = out.where(F.size("fields") > 0).withColumn("status_code", F.lit(400))
    return out.where(F.size("fields") == 0).drop("fields"), bad


TABLES_COLUMNS = [c.strip().split(" ")[0] for c in TABLES["extractions"].split(", ")]
