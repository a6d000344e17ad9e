"""JSON files of the pipeline and its stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schemas


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A file that holds one JSON array; ``strict`` fails on anything that is not a list of such records."""
    reader = spark.read.schema(schema).option("multiLine", True)
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_wrapped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file that is either an array or an object with the array under 'data'."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    rows = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<struct<{_typed(schema)}>>")).otherwise(
        F.from_json("v", f"struct<data:array<struct<{_typed(schema)}>>>").getField("data")
    )
    checked = F.when(rows.isNull(), F.raise_error(F.lit("neither a list nor an object with a list under 'data'"))).otherwise(rows)
    return raw.select(F.explode(checked).alias("r")).select("r.*")


def _typed(ddl: str) -> str:
    depth, out = 0, []
    for part in ddl.replace(", ", ",").split(","):
        if depth == 0:
            name, kind = part.split(" ", 1)
            out.append(f"{name}:{kind}")
        else:
            out[-1] += f",{part}"
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object from ids to records, as rows with ``key``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{_typed(schema)}>>")).alias("key", "r")).select("key", "r.*")


def normalized_chunks(raw: DataFrame) -> DataFrame:
    """Chunks whose id may stand in chunk_id, id or metadata.chunk_id; a run fails on one without id or text."""
    names = set(raw.columns)
    meta = raw.schema["metadata"].dataType.fieldNames() if "metadata" in names else []
    options = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("chunk_id", "id") if c in names]
    if "chunk_id" in meta:
        options.append(F.nullif(F.col("metadata.chunk_id").cast("string"), F.lit("")))
    chunk_id = F.coalesce(*options)
    text = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("text"))
    fields = []
    for c in ("doc_id", "title", "url", "source_category", "chunk_index", "token_count"):
        have = [F.col(f"metadata.{c}")] if c in meta else []
        have += [F.col(c)] if c in names else []
        fields.append((F.coalesce(*have) if have else F.lit(None).cast("string")).alias(c))
    return raw.select(
        F.coalesce(chunk_id, F.raise_error(F.lit("chunk without id"))).alias("chunk_id"),
        F.coalesce(text, F.raise_error(F.lit("chunk without text"))).alias("text"),
        F.struct(*fields).alias("metadata"),
    )


def id_to_text(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "text")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, for exchange with other tools."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with a JSON array of all rows, as other tools read it. Rows stream through one task; use ``write_json`` for large tables."""

    def lines(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            rows = [f"{'[' if first and not i else ','}{r}" for i, r in enumerate(r for r in batch.column(0).to_pylist() if r is not None)]
            first = first and not rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
    one = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("r"))  # so that an empty table is written too
    one.unionByName(rows).coalesce(1).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_wrapped(df: DataFrame, path: str) -> None:
    """One file with an object that holds the rows under 'data'; gathers the rows in one task, for small tables."""
    one = df.agg(F.collect_list(F.struct("*")).alias("data"))
    one.select(F.to_json(F.struct("data"))).write.mode("overwrite").text(path)


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """One file with an object from ids to records; gathers the rows in one task, for small tables."""
    one = df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.struct("*")))).alias("m"))
    one.select(F.to_json("m")).write.mode("overwrite").text(path)


def write_embedding_run(chunks: DataFrame, path: str, input_path: str, model: str, batch_size: int, pause: float, requested: int | None = None) -> None:
    """Embedded chunks beside a table of one row about the run. All vectors must have one length."""
    spark = chunks.sparkSession
    write_table(chunks, f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    about = data.agg(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at_utc"),
        F.lit(input_path).alias("input_path"),
        F.lit(model).alias("embedding_model"),
        F.lit(requested).cast("int").alias("embedding_dimensions_requested"),
        F.when(F.countDistinct(F.size("embedding")) <= 1, F.max(F.size("embedding")))
        .otherwise(F.raise_error(F.lit("vectors differ in length")).cast("int"))
        .alias("embedding_dimensions_actual"),
        F.lit(batch_size).alias("batch_size"),
        F.lit(float(pause)).alias("sleep_between_batches_sec"),
        F.count(F.lit(1)).cast("int").alias("total_chunks"),
    )
    write_table(about.to(_schema(spark, schemas.RUN_METADATA)), f"{path}/run")


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def write_collection(chunks: DataFrame, path: str) -> None:
    """The vector collection: id, embedding, document and metadata; section headings stay, as a nullable field."""
    meta = ["doc_id", "title", "url", "source_category"]
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in meta]
    fields += [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("chunk_index", "token_count")]
    fields.append((F.col("section_heading") if "section_heading" in chunks.columns else F.lit(None).cast("string")).alias("section_heading"))
    out = chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("text").alias("document"), F.struct(*fields).alias("metadata"))
    write_table(out, path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the stored table lacks, so that a stopped run can be repeated."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    (rows if done is None else rows.join(done, key, "left_anti")).write.mode("append").parquet(path)
