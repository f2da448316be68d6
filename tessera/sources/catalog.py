"""Sources and sinks: catalogs, logs, source trees, small documents, and append-once tables.

Schemas are explicit; a source that does not have the shape it should is an error or goes to a reject side, never
silently empty.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = """file string, name string, qualified_name string, line bigint, end_line bigint, language string, export_type string, signature string,
return_type string, docstring string, decorators array<string>, params array<struct<name:string,type:string,default:string,optional:boolean>>,
body_lines bigint, cyclomatic_complexity bigint, ast_fingerprint string, token_sequence array<struct<type:string,value:string>>, context string"""

#: The event store's tables.
STORE = {
    "events": "event_id string, event_type string, workstream_id string, bead_id string, agent_id string, timestamp string, payload string, processing_level string, idempotency_key string",
    "state_ledger": "workstream_id string, repo string, branch string, mission_id string, scope_region string, bead_lineage string, active_beads string, latest_commit string, diff_summary string, changed_files string, hotspots string, linked_artifacts string, linked_findings string, decision_anchors string, unresolved string, vector_refs string, provenance string, last_enriched_at string, schema_version int, created_at string, updated_at string",
    "findings": "finding_id string, workstream_id string, source_bead_id string, source_agent_id string, finding_type string, evidence string, confidence double, affected_scope string, suspected_domain string, related_findings string, suggested_actions string, promotion_state string, suppression_reason string, salience double, created_at string, updated_at string, resolved_at string, schema_version int",
    "conductor_journal": "entry_id string, workstream_id string, session_type string, timestamp string, structured string, narrative string, schema_version int",
    "remediation_patterns": "pattern_id string, pattern_type string, description string, confidence double, usage_count int, created_at string, updated_at string",
}
#: Language by file extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "sh": "shell"}
_TESTS = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|[._-](test|spec)\.[a-z]+$"


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """A JSON array of records; anything but an array of objects is an error.  Adds ``item_key`` = file:line."""
    first = spark.read.text(path, wholetext=True).select(F.ltrim("value").startswith("[").alias("ok")).where("NOT ok")
    if not first.isEmpty():
        raise ValueError(f"{path}: not a JSON array")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("item_key", F.concat_ws(":", "file", "line"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines); blank lines are neither."""
    parsed = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = rows.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("r.*").drop("_bad")
    return good, rows.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).select("value")


def classified(files: DataFrame, with_tests: bool = False) -> DataFrame:
    """(path, language, content) of files (path, content): those of a known extension, test files aside."""
    extension = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension]
    out = files.select("path", language.alias("language"), F.decode("content", "UTF-8").alias("content")).where("language IS NOT NULL")
    return out if with_tests else out.where(~F.col("path").rlike(_TESTS))


def read_tree(spark: SparkSession, path: str, with_tests: bool = False) -> DataFrame:
    """The files of a source tree, ``classified``."""
    return classified(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), with_tests)


def read_documents(spark: SparkSession, text: str) -> DataFrame:
    """One small control document (JSON, or YAML where its library is there) as a one-row frame (key, value as JSON)."""
    try:
        import yaml
    except ImportError:
        yaml = None
    value = yaml.safe_load(text) if yaml else json.loads(text)
    return spark.createDataFrame([(str(k), json.dumps(v, sort_keys=True, default=str)) for k, v in value.items()], "key string, value string")


def keyed_documents(texts: DataFrame) -> DataFrame:
    """(id, key, value as JSON) of control documents (id, text), one JSON object each; a text that is none gives nothing."""
    keys = texts.select("id", "text", F.explode(F.json_object_keys("text")).alias("key"))
    return keys.select("id", "key", F.expr("get_json_object(text, concat('$.', key))").alias("value"))


def write_json_array(frame: DataFrame, path: str) -> None:
    """JSON arrays, a record a line: each task writes its rows as one array, as they come, so that no task holds all of them.

    A frame of one partition gives one file, and no rows give an empty array.
    """
    records = frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))

    def lines(batches):
        held, begun = None, False
        for batch in batches:
            out = []
            for record in batch.column(0).to_pylist():
                out += ["["] if not begun else [f"  {held},"]
                begun, held = True, record
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([f"  {held}", "]"] if begun else ["[", "]"], pa.string())], ["value"])

    records.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def create_store(spark: SparkSession, path: str) -> None:
    """The event store's tables as Parquet folders, each made empty unless it holds something."""
    for name, columns in STORE.items():
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{path}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_once(frame: DataFrame, path: str, key: str, status: str | None = None) -> None:
    """Appends the rows whose key the ledger at ``path`` does not hold, final ones only where ``status`` is named.

    One writer at a time: two that append at once do not see each other's rows.
    """
    spark = frame.sparkSession
    rows = frame.where(F.col(key).isNotNull()).dropDuplicates([key])
    if status:
        rows = rows.where(F.col(status) == "final")
    if exists(spark, path):
        rows = rows.join(spark.read.schema(frame.schema).parquet(path).select(key), key, "left_anti").select(*frame.columns)
    rows.write.mode("append").parquet(path)
