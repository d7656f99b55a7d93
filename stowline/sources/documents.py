"""JSON and CSV sources under the blocks' schemas, mappings and move lists."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import normalise, slotting
from ..schema import BLOCKS, DISTANCE_BASES, ENUMS, REQUIRED, SEQUENCE_BASES, Bundle, Meta


class SourceError(ValueError):
    """A file that is missing or does not hold what it should."""


def read_json(path: str | Path) -> object:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise SourceError(f"no file {path}") from e
    except json.JSONDecodeError as e:
        raise SourceError(f"{path} is no JSON: {e}") from e


def _strict(block: str, name: str, kind: str) -> Column:
    """A canonical value from its JSON text; what is not exactly of its type stops the query."""
    c = F.nullif(F.col(name), F.lit(""))
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{block}.{name}: {what}: "), F.coalesce(F.col(name), F.lit("null"))))
    if kind in ("double", "int"):
        whole = c.try_cast("double") if kind == "double" else F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("int"))
        out = F.when(c.isNotNull(), F.coalesce(whole, fail("not a number").cast(kind)))
    elif kind == "boolean":
        low = F.lower(F.trim(c))
        default = F.lit(False) if name in ("fixed", "fixed_location") else F.lit(None).cast("boolean")
        out = F.when(c.isNull(), default).when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False).otherwise(fail("not a boolean").cast("boolean"))
    elif kind == "array<string>":
        listed = F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"\|"))
        out = F.coalesce(F.filter(F.transform(listed, F.trim), lambda x: x != ""), F.expr("cast(array() as array<string>)"))
    else:
        out = c if name != "description" else F.coalesce(F.col(name), F.lit(""))
        if allowed := ENUMS.get((block, name)):
            out = F.when(F.trim(c).isin(*allowed), F.trim(c)).when(c.isNotNull(), fail("not in the enumeration"))
    if name in REQUIRED[block]:
        out = F.when(c.isNull(), fail("missing").cast(kind)).otherwise(out)
    return out.alias(name)


def _blocks(raw: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for block, schema in BLOCKS.items():
        rows = raw.select(F.posexplode(block).alias("ordinal", "row")).select("ordinal", "row.*")
        typed = rows.select(*[_strict(block, f.name, f.dataType.simpleString()) for f in schema.fields], F.col("ordinal").cast("long").alias("ordinal"))
        out[block] = typed if block in ("assignments", "picks") else typed.drop("ordinal")
    return out


def _meta(document: dict) -> Meta:
    own = {k: v for k, v in (document.get("meta") or {}).items() if k in Meta.__dataclass_fields__ and v not in (None, "")}
    if "dataset_id" not in own:
        raise SourceError("meta.dataset_id is missing")
    return Meta(**own)


#: These two blocks may stand under the document's `layout`.
LAYOUT = ("nodes", "edges")


def _rows(document: dict, block: str) -> list:
    layout = document.get("layout") or {}
    if not isinstance(layout, dict):
        raise SourceError("layout is a JSON object")
    return (layout.get(block) if block in LAYOUT else None) or document.get(block) or []


def _head(spark: SparkSession, path: str) -> dict:
    """The document for its meta and config, from any store that Spark reads."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise SourceError(f"no file {path}") from e
    try:
        document = json.loads(text[0] if text else "")
    except json.JSONDecodeError as e:
        raise SourceError(f"{path} is no JSON: {e}") from e
    if not isinstance(document, dict) or not isinstance(document.get("config") or {}, dict):
        raise SourceError("a dataset is a JSON object, and so is its config")
    return document


def load(spark: SparkSession, path: str) -> Bundle:
    """A canonical dataset: one JSON document with the six blocks, meta and config, or a folder that save() wrote."""
    if not str(path).endswith(".json"):
        return _load_folder(spark, str(path).rstrip("/"))
    head = _head(spark, path)
    _rows(head, LAYOUT[0])
    listed = {b: T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in s.fields])) for b, s in BLOCKS.items()}
    layout = T.StructType([T.StructField(b, listed[b]) for b in LAYOUT])
    every = T.StructType([*(T.StructField(b, t) for b, t in listed.items()), T.StructField("layout", layout)])
    raw = spark.read.schema(every).option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    raw = raw.withColumns({b: F.coalesce(F.col("layout")[b], F.col(b)) for b in LAYOUT})
    return Bundle(**_blocks(raw), meta=_meta(head), config=head.get("config") or {})


def save(bundle: Bundle, folder: str) -> None:
    """The blocks as Parquet, written by the executors, with meta and config beside them; load() reads it."""
    folder = folder.rstrip("/")
    for block in BLOCKS:
        getattr(bundle, block).write.mode("overwrite").parquet(f"{folder}/{block}")
    text = json.dumps({"meta": vars(bundle.meta), "config": bundle.config}, ensure_ascii=False)
    bundle.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/dataset")


def _load_folder(spark: SparkSession, folder: str) -> Bundle:
    head = _head(spark, f"{folder}/dataset")
    return Bundle(**{b: spark.read.parquet(f"{folder}/{b}") for b in BLOCKS}, meta=_meta(head), config=head.get("config") or {})


def from_object(spark: SparkSession, document: dict) -> Bundle:
    """A dataset from a parsed document of unit-test size."""
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    out = {}
    for block, schema in BLOCKS.items():
        names = schema.fieldNames()
        rows = [(k, *(text(r.get(n)) for n in names)) for k, r in enumerate(_rows(document, block))]
        raw = spark.createDataFrame(rows, T.StructType([T.StructField("ordinal", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]))
        typed = raw.select(*[_strict(block, f.name, f.dataType.simpleString()) for f in schema.fields], "ordinal")
        out[block] = typed if block in ("assignments", "picks") else typed.drop("ordinal")
    return Bundle(**out, meta=_meta(document), config=document.get("config") or {})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as stripped strings, '' where missing; the delimiter is ';' if that is more frequent at the file's start."""
    start = spark.read.text(path).limit(50).agg(F.concat_ws("\n", F.collect_list("value"))).first()[0][:4096]
    df = spark.read.option("header", True).option("sep", ";" if start.count(";") > start.count(",") else ",").option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    return df.toDF(*names).select(*[F.coalesce(normalise.strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names])


def csv_headers(spark: SparkSession, path: str) -> list[str]:
    return read_csv(spark, path).columns


def load_mapping(path: str | Path) -> dict:
    mapping = read_json(path)
    if not isinstance(mapping, dict):
        raise SourceError("a mapping is a JSON object")
    return mapping


def load_moves(path: str | Path) -> list[tuple[str, str]]:
    return slotting.parse_moves(read_json(path))


def normalise_folder(spark: SparkSession, folder: str, mapping: dict) -> tuple[Bundle, list[tuple[str, str, str]]]:
    """Blocks from CSV files by a mapping of {meta, config, blocks: {block: {file, columns}}}; also the notes."""
    notes: list[tuple[str, str, str]] = []
    own = dict(mapping.get("meta") or {})
    for key, allowed, default in (("sequence_basis", SEQUENCE_BASES, "unknown"), ("distance_basis", DISTANCE_BASES, DISTANCE_BASES[0])):
        if key not in own:
            own[key] = default
            notes.append((f"{key.upper()}_DEFAULTED", "info", f"meta.{key}"))
        elif own[key] not in allowed:
            raise normalise.MappingQuestion(f"meta.{key}: one of {', '.join(allowed)}")
    if own.setdefault("distance_unit", "m") != "m":
        raise normalise.MappingQuestion("meta.distance_unit: distances are in metres")
    config = mapping.get("config") or {}
    if not config.get("route_start_node") or not config.get("route_end_node"):
        raise normalise.MappingQuestion("config: at which nodes do routes start and end?")
    specs = mapping.get("blocks") or {k: mapping[k] for k in BLOCKS if k in mapping}
    out = {}
    for block in BLOCKS:
        if block not in specs:
            raise normalise.MappingQuestion(f"{block}: which file holds it?")
        raw = read_csv(spark, f"{folder.rstrip('/')}/{specs[block]['file']}")
        df, said = normalise.block(block, raw, specs[block].get("columns") or {})
        notes += said.issues
        out[block] = df.withColumn("ordinal", F.monotonically_increasing_id()) if block in ("assignments", "picks") else df
    return Bundle(**out, meta=_meta({"meta": own}), config=config), notes


class Catalog:
    """Datasets of one folder by id; any other id is refused."""

    def __init__(self, folder: str | Path):
        self.paths = {}
        for p in sorted(Path(folder).glob("*.json")):
            doc = read_json(p)
            if isinstance(doc, dict) and (name := (doc.get("meta") or {}).get("dataset_id")):
                self.paths[name] = str(p)

    def load(self, spark: SparkSession, dataset_id: str) -> Bundle:
        if dataset_id not in self.paths:
            raise SourceError(f"unknown dataset {dataset_id!r}")
        return load(spark, self.paths[dataset_id])
