"""Reading and writing files: detection over a listing, scans with null tokens, and tables kept between jobs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a loader reads as missing, and the delimiters it tries (fixed values).
NULL_TOKENS = ("", "NULL", "null", "N/A", "n/a", "NaN", "nan", "-", "None")
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "feather": "feather", "arrow": "feather", "xlsx": "excel", "xls": "excel", "orc": "orc"}


def detect_format(path: Column) -> Column:
    """Format by extension; csv where it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:\.gz)?$", 1))), F.lit("csv"))


def inventory(spark: SparkSession, path: str, *, checksum: bool = False) -> DataFrame:
    """``path, size, modified, format`` of the files below a path, and a sha-256 where asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), detect_format(F.col("path")).alias("format"), *([F.sha2("content", 256).alias("checksum")] if checksum else []))
    return out


def detect_delimiter(lines: DataFrame, *, file: str = "file", line: str = "value", position: str = "position", first: int = 10) -> DataFrame:
    """``file, delimiter``: the most frequent of comma, semicolon, tab and pipe in each file's first lines."""
    some = lines.where(F.col(position) < first).groupBy(file)
    counts = some.agg(*[F.sum(F.regexp_count(line, F.lit("\\" + d if d == "|" else d))).alias(n) for n, d in DELIMITERS.items()])
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("k"), F.lit(-i).alias("o"), F.lit(n).alias("d")) for i, n in enumerate(DELIMITERS)]))
    return counts.select(file, best["d"].alias("delimiter"))


#: Encodings that are told apart, in the order of preference where nothing speaks for one (UTF-8 by its rules).
ENCODINGS = ("utf-8", "utf-16le", "utf-16be", "latin1", "cp1252", "cp1251", "koi8-r")
_ONE_BYTE = ("cp1252", "cp1251", "koi8-r")
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def _script(c: str) -> str:
    """``l`` for Latin letters, ``c`` for Cyrillic ones, ``o`` for other characters."""
    if c.isalpha():
        return "l" if c <= "\u024f" else "c" if "\u0400" <= c <= "\u04ff" else "o"
    return "o"


def encoding_scores(head: bytes) -> dict[str, float]:
    """How well each encoding reads the beginning of a file, from its pairs of neighbouring bytes; 1 is best.

    Valid UTF-8 beats the rest. In two-byte encodings zeros of plain characters lie on one side. In one-byte encodings a pair
    with a byte beyond ASCII counts for an encoding if both are letters of one script, no capital follows a small letter,
    and not both are accented Latin letters, as these seldom stand together. Latin-1 is as good as its Windows relative where
    no byte from 80 to 9F occurs, and no choice where one does.
    """
    for mark, name in _MARKS:
        if head.startswith(mark):
            return {e: float(e == name) for e in ENCODINGS}
    if not head or head.isascii() and 0 not in head:
        return {e: float(e == "utf-8") for e in ENCODINGS}
    zeros = [head[i::2].count(0) / max(1, len(head) // 2) for i in (0, 1)]
    wide = {"utf-16le": zeros[1] - zeros[0], "utf-16be": zeros[0] - zeros[1]}
    try:
        head.decode("utf-8")
        valid = True
    except UnicodeDecodeError as e:
        valid = e.start >= len(head) - 3 and e.reason == "unexpected end of data"  # the end may cut a character
    out = {"utf-8": 0.9 if valid and 0 not in head else 0.0, **{k: max(0.0, v) for k, v in wide.items()}}
    pairs: dict[bytes, int] = {}
    for i in range(len(head) - 1):
        if head[i] > 127 or head[i + 1] > 127:
            pairs[head[i : i + 2]] = pairs.get(head[i : i + 2], 0) + 1
    extended = any(128 <= b < 160 for b in head)
    for e in ENCODINGS[4:]:
        good = total = 0
        for pair, n in pairs.items():
            a, b = pair.decode(e, "replace")
            total += n
            sides = _script(a), _script(b)
            if a == "\ufffd" or b == "\ufffd":
                good -= n
            elif not a.isalpha() or not b.isalpha():
                good += n / 2
            elif sides[0] == sides[1] and not (a.islower() and b.isupper()) and not (sides[0] == "l" and a > "\x7f" and b > "\x7f"):
                good += n
        out[e] = 0.0 if not total or 0 in head else max(0.0, 0.8 * good / total)
    out["latin1"] = 0.0 if extended else out["cp1252"]
    return {e: out[e] for e in ENCODINGS}


def detect_encoding(spark: SparkSession, path: str, head: int = 100_000) -> DataFrame:
    """``path, encoding, confidence`` of each file below ``path`` by :func:`encoding_scores` of its beginning.

    Files are read whole by Spark's reader for binary files, one row each (empty ones have none); for the parts of a large table see
    :func:`table_encoding`.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.expr(f"substring(content, 1, {head})").alias("head"))

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [encoding_scores(h or b"") for h in batch.column(1).to_pylist()]
            best = [max(ENCODINGS, key=lambda e, s=s: (s[e], -ENCODINGS.index(e))) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array([s[b] for s, b in zip(scores, best, strict=True)])], names=["path", "encoding", "confidence"])

    return files.mapInArrow(judge, "path string, encoding string, confidence double")


def table_encoding(spark: SparkSession, path: str, lines: int = 2000) -> list[str]:
    """The encodings worth trying for the files of one table, best first, from its first lines alone."""
    raw = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").option("header", False).schema("line string").csv(path).limit(lines)
    head = b"\n".join((r["line"] or "").encode("latin-1") for r in raw.collect())
    scores = encoding_scores(head)
    return sorted((e for e in ENCODINGS if scores[e] > 0), key=lambda e: (-scores[e], ENCODINGS.index(e))) or ["utf-8"]


def read_csv_in_any_encoding(spark: SparkSession, path: str, *, sep: str = ",", schema: str | None = None, sample: int = 1000) -> tuple[DataFrame, str]:
    """:func:`read_csv` in the encoding that the file's beginning speaks for, and its name; if the first rows then hold
    characters that could not be read, the next one is tried."""
    tried = [*table_encoding(spark, path), "cp1252"]
    for encoding in dict.fromkeys(tried):
        df = read_csv(spark, path, sep=sep, encoding=encoding, schema=schema)
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        broken = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in texts]), lambda v: v.contains("\ufffd")) if texts else F.lit(False)
        if not any("\ufffd" in c for c in df.columns) and df.limit(sample).where(broken).isEmpty():
            return df, encoding
    return df, encoding


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """``df`` with null for missing-value tokens in text columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.trim(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in texts}) if texts else df


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "utf-8", schema: str | None = None) -> DataFrame:
    """A CSV scan with a header, null tokens applied; splittable, so large files need no special way.

    One-byte encodings that Spark's reader lacks are read byte by byte as Latin-1, and the upper half is then put right.
    """
    plain = encoding.lower() in _ONE_BYTE
    name = "ISO-8859-1" if plain or encoding.lower() == "latin1" else encoding
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", name).option("mode", "PERMISSIVE")
    if encoding.lower().startswith("utf-16"):
        reader = reader.option("lineSep", "\n")  # its bytes depend on the encoding
    df = (reader.schema(schema) if schema else reader).csv(path)
    if plain:
        upper = bytes(range(128, 256))
        read, meant = upper.decode("latin-1"), upper.decode(encoding, "replace")
        texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
        fixed = [F.translate(F.col(f"`{c}`"), read, meant) if c in texts else F.col(f"`{c}`") for c in df.columns]
        df = df.select(*[e.alias(c.translate(str.maketrans(read, meant))) for c, e in zip(df.columns, fixed, strict=True)])
    return null_tokens(df)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """``df`` with struct columns as top-level ones named by their dotted path."""

    def leaves(schema: T.StructType, prefix: str, name: str):
        for f in schema:
            path, label = f"{prefix}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path + ".", label + sep)
            else:
                yield F.col(path).alias(label)

    return df.select(*leaves(df.schema, "", ""))


def read_json(spark: SparkSession, path: str, *, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """A JSON scan (lines, or an array or object with ``multi_line``) with nested objects flattened."""
    reader = spark.read.option("multiLine", multi_line)
    return flatten((reader.schema(schema) if schema else reader).json(path))


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feather (Arrow IPC) files, one task for each file, in Arrow batches."""

    def decode(batches):
        import io

        import pyarrow.feather as feather

        for batch in batches:
            for content in batch.column(0):
                yield from feather.read_table(io.BytesIO(content.as_py())).to_batches(max_chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)


def read_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """First sheets of Excel files, one task for each file; needs the ``openpyxl`` package."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading Excel files needs the openpyxl package") from e

    def decode(frames):
        import io

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                yield pd.read_excel(io.BytesIO(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, schema)


def read_any(spark: SparkSession, path: str, *, schema: str | None = None) -> DataFrame:
    """A table by its extension, with clean column names and without empty rows."""
    from tabulon.operators.clean import clean_names, drop_empty_rows

    kind = FORMATS.get(os.path.splitext(path.removesuffix(".gz"))[1][1:].lower(), "csv")
    if kind in ("feather", "excel") and not schema:
        raise ValueError(f"{kind} files need a schema")
    df = {"csv": lambda: read_csv(spark, path, sep="\t" if path.endswith(".tsv") else ",", schema=schema), "json": lambda: read_json(spark, path, schema=schema), "parquet": lambda: spark.read.parquet(path), "orc": lambda: spark.read.orc(path), "feather": lambda: read_feather(spark, path, schema), "excel": lambda: read_excel(spark, path, schema)}[kind]()
    return drop_empty_rows(df.toDF(*clean_names(df.columns)))


def write(df: DataFrame, path: str, kind: str = "parquet", *, compression: str | None = None, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """``df`` as parquet, csv (with header) or json."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


# --- feature tables ----------------------------------------------------------------------------------------------


def register_features(df: DataFrame, path: str, registry: str, *, name: str, entity: str, ts: str, ttl_seconds: int = 86_400) -> None:
    """Features written by day, and a row of their definition appended to the registry table."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
    row = [(name, path, entity, ts, ttl_seconds, ",".join(c for c in df.columns if c not in (entity, ts)))]
    df.sparkSession.createDataFrame(row, "name string, path string, entity string, ts string, ttl_seconds int, features string").write.mode("append").parquet(registry)


def materialise(features: DataFrame, entity: str, ts: str, start, end) -> DataFrame:
    """The latest row of each entity with a time in [start, end)."""
    inside = features.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    rest = [c for c in features.columns if c not in (entity, ts)]
    latest = inside.groupBy(entity).agg(F.max(F.struct(ts, *rest)).alias("f"))
    return latest.select(entity, "f.*")


def online(entities: DataFrame, table: DataFrame, entity: str) -> DataFrame:
    """Entity rows with their latest features."""
    return entities.join(table, entity, "left")


def append_catalog(spark: SparkSession, path: str, record: DataFrame) -> None:
    """Rows about a job appended to a catalog table, with the time."""
    record.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def first_lines(spark: SparkSession, path: str, first: int = 10) -> DataFrame:
    """``file, position, value`` of the first lines of each text file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    w = Window.partitionBy("file").orderBy("i")
    return lines.where("block = 0").withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < first).select("file", "position", "value")
