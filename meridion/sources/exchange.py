"""Exchange of models: documents of many tables, scenario parameters, variants of columns, two-way links, splits, text exports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Model

# The parts of a model document.
PARTS = ("geojson", "pd_json", "json")


def write_document(model: Model, path: str, shapes: dict[str, tuple[str, str]] | None = None) -> None:
    """A model as one JSON document: tables named in `shapes` (by their columns of x and y) as GeoJSON points, others as records, parameters as they are.

    Each table is turned to JSON by the executors; the document is meant for models that one file can hold."""
    spark, shapes = SparkSession.active(), shapes or {}
    rows = None
    for name, df in sorted(model.tables.items()):
        if name in shapes:
            x, y = shapes[name]
            rest = [c for c in df.columns if c not in (x, y)]
            value = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"))
        else:
            value = F.struct(*df.columns)
        part = df.select(F.lit("geojson" if name in shapes else "pd_json").alias("part"), F.lit(name).alias("name"), F.to_json(value).alias("row"))
        rows = part if rows is None else rows.unionByName(part)
    text = {p: "" for p in PARTS}
    if rows is not None:
        whole = rows.groupBy("part", "name").agg(F.concat_ws(",", F.sort_array(F.collect_list("row"))).alias("rows"))
        for r in whole.orderBy("part", "name").collect():
            body = f'{{"type":"FeatureCollection","features":[{r["rows"]}]}}' if r["part"] == "geojson" else f'[{r["rows"]}]'
            text[r["part"]] += f'{"," if text[r["part"]] else ""}{json.dumps(r["name"])}:{body}'
    text["json"] = ",".join(f"{json.dumps(k)}:{json.dumps(v)}" for k, v in sorted(model.params.items()))
    document = "{" + ",".join(f'"{p}":{{{text[p]}}}' for p in PARTS) + "}"
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schemas: dict[str, str]) -> Model:
    """A model from such a document; `schemas` gives the columns of each table that is wanted (a point's are x and y besides its properties)."""
    doc = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    tables = {}
    kinds = json.loads(doc.select(F.to_json(F.from_json("value", "geojson map<string,string>, pd_json map<string,string>, json map<string,string>"))).first()[0])
    for name, schema in schemas.items():
        if name in kinds.get("geojson", {}):
            shape = f"struct<features:array<struct<properties:struct<{_fields(schema)}>,geometry:struct<coordinates:array<double>>>>>"
            f = doc.select(F.explode(F.from_json(F.get_json_object("value", f"$.geojson.{name}"), shape)["features"]).alias("f"))
            tables[name] = f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))
        else:
            tables[name] = doc.select(F.explode(F.from_json(F.get_json_object("value", f"$.pd_json.{name}"), f"array<struct<{_fields(schema)}>>")).alias("r")).select("r.*")
    return Model(tables, {k: json.loads(v) if v[:1] in '[{"0123456789-tfn' else v for k, v in kinds.get("json", {}).items()})


def _fields(schema: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in schema.split(","))


def ancestry(parents: dict[str, str], scenario: str) -> list[str]:
    """A scenario, its parent, and so on to the one that is its own parent."""
    out = [scenario]
    while (up := parents.get(out[-1], out[-1])) != out[-1]:
        if up in out:
            raise ValueError(f"scenarios are each other's parents: {out}")
        out.append(up)
    return out


def inherited(sheet: DataFrame, scenario: str, period: str | None = None, category: str = "general", parameter: str = "parent") -> DataFrame:
    """(category, parameter, value): a scenario's column of a parameter sheet, with its ancestors' values where it has none.

    Parents stand in the sheet itself. With `period`, rows of that period go before those without one, and others are left out."""
    names = [c for c in sheet.columns if c not in ("category", "parameter", "type", "unit", "desc", "description", "period")]
    row = sheet.filter((F.col("category") == category) & (F.col("parameter") == parameter)).select(names).first()
    order = ancestry({k: v for k, v in row.asDict().items() if v}, scenario)
    if "period" in sheet.columns:
        sheet = sheet.filter(F.col("period").isNull() | (F.lower("period") == (period or "").lower()))
        best = sheet.groupBy("category", "parameter").agg(*[F.max_by(n, F.col("period").isNotNull().cast("int")).alias(n) for n in order])
    else:
        best = sheet
    return best.select("category", "parameter", F.coalesce(*order).alias("value"))


def typed(value: str | None, kind: str | None) -> Any:
    """A parameter's value by the type that its sheet names."""
    if value is None or kind in (None, "", "str"):
        return value
    return {"float": float, "int": lambda v: int(float(v)), "bool": lambda v: str(v).strip().lower() in ("true", "1", "1.0"), "json": json.loads}[kind](value)


def variant(df: DataFrame, name: str, mark: str = "#") -> DataFrame:
    """Columns col#name become col, in place of a plain one; columns of other variants go."""
    own = {c.split(mark)[0]: c for c in df.columns if c.endswith(f"{mark}{name}")}
    plain = [c for c in df.columns if mark not in c and c not in own]
    return df.select(*plain, *[F.col(f"`{c}`").alias(k) for k, c in own.items()])


def folded(links: DataFrame, key: str, columns: list[str], mark: str = "_r") -> DataFrame:
    """Two-way links: rows whose key ends with the mark become columns `x_r` of the row that they reverse."""
    back = F.col(key).endswith(mark)
    other = links.filter(back).select(F.expr(f"left({key}, length({key}) - {len(mark)})").alias(key), *[F.col(c).alias(f"{c}{mark}") for c in columns])
    ahead = links.filter(~back)
    return ahead.drop(*[f"{c}{mark}" for c in columns]).join(other, key, "left")


def split(model: Model, name: str, by: str) -> Model:
    """A table as one for each value of a column, name_value. The values are few and known on the driver."""
    df = model.tables[name]
    values = [r[0] for r in df.select(by).distinct().orderBy(by).limit(10_000).collect()]
    return model.without(name).with_tables(**{f"{name}_{v}": df.filter(F.col(by).eqNullSafe(F.lit(v))).drop(by) for v in values})


def chunks(df: DataFrame, n: int, keys: list[str]) -> list[DataFrame]:
    """n parts of a table, by a hash of keys: a key's rows stay together, and each part can be read alone."""
    part = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [df.filter(part == k) for k in range(n)]


def unsplit(model: Model, name: str, values: list | None = None) -> Model:
    """The tables name_value as one."""
    parts = [f"{name}_{v}" for v in values] if values else sorted(k for k in model.tables if k.startswith(f"{name}_"))
    whole = model.tables[parts[0]]
    for p in parts[1:]:
        whole = whole.unionByName(model.tables[p], allowMissingColumns=True)
    return model.without(*parts).with_tables(**{name: whole})


def networks_merged(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], node: str, marks: tuple[str, str] = ("_left", "_right")) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of two networks, over the columns that both have; ids have a mark of their network."""

    def marked(c: str, mark: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.lit(mark)).alias(c)

    def both(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        parts = [df.select(*[marked(c, m) if c in ids else F.col(c) for c in shared]) for df, m in ((a, marks[0]), (b, marks[1]))]
        return parts[0].unionByName(parts[1])

    return both(left[0], right[0], ["a", "b"]), both(left[1], right[1], [node])


def stacked(scenarios: dict[str, DataFrame]) -> DataFrame:
    """Tables of many scenarios as one, with a column scenario."""
    out = None
    for name, df in scenarios.items():
        part = df.withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def line_text(links: DataFrame, headway: str = "headway") -> DataFrame:
    """(trip, value): each trip as a LINE statement with its headway in minutes and its stops in order."""
    stops = F.array_sort(F.collect_list(F.struct("link_sequence", "a", "b")))
    one = links.groupBy("trip").agg(stops.alias("s"), F.first(headway).alias("h"))
    nodes = F.concat(F.transform("s", lambda x: x["a"].cast("string")), F.array(F.element_at("s", -1)["b"].cast("string")))
    return one.select("trip", F.concat(F.lit('LINE NAME="'), F.col("trip").cast("string"), F.lit('", HEADWAY='), F.format_string("%.2f", F.col("h") / 60), F.lit(", N="), F.array_join(nodes, ",")).alias("value"))


def od_matrix_text(od: DataFrame, value: str, path: str) -> None:
    """An OD matrix as lines `origin,destination,value`, sorted within files that are ranges of origins."""
    od.select("origin", "destination", value).repartitionByRange("origin").sortWithinPartitions("origin", "destination").write.mode("overwrite").csv(path)
