"""Raw extracts as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_SCHEMA = "file string, block_start long, line_no long, line string"
FILE_FORMATS = ("parquet", "orc", "csv", "json")


def _children(spark: SparkSession, location: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.listStatus(path))


USER_TABLES = ("select table_schema, table_name from information_schema.tables where table_type = 'BASE TABLE' "
               "and lower(table_schema) not in ('information_schema', 'pg_catalog', 'mysql', 'performance_schema', 'sys')")


def scan_catalog(spark: SparkSession, location: str, format: str = "parquet",
                 **options: str) -> dict[str, DataFrame]:
    """Every non-empty table of a folder, of a metastore database, or of a JDBC source."""
    if format == "jdbc":
        source = spark.read.format("jdbc").options(url=location, **options)
        names = source.option("query", USER_TABLES).load()  # one row per table
        found = {r[1]: spark.read.format("jdbc").options(url=location, dbtable=f"{r[0]}.{r[1]}", **options).load()
                 for r in names.toLocalIterator()}
    elif format == "catalog":
        found = {t.name: spark.read.table(f"{location}.{t.name}") for t in spark.catalog.listTables(location)}
    elif format in FILE_FORMATS:
        found = {}
        for child in _children(spark, location):
            name = child.rstrip("/").rsplit("/", 1)[-1]
            if name.startswith(("_", ".")):
                continue
            found[name.removesuffix(f".{format}")] = (
                spark.read.format(format).options(**options).load(child))
    else:
        raise ValueError(f"unknown format {format}")
    return {name: df for name, df in found.items() if not df.isEmpty()}


def _drop_head(skip: int):
    """Number the lines of every file block and drop the first lines of each file."""
    def run(batches):
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            files = table.column("file").combine_chunks().dictionary_encode()
            starts = table.column("block_start").combine_chunks()
            for code, file in enumerate(files.dictionary.to_pylist()):
                of_file = pc.equal(files.indices, code)
                for start in pc.unique(pc.filter(starts, of_file)).to_pylist():
                    part = table.filter(pc.and_(of_file, pc.equal(starts, start)))
                    done = seen.get((file, start), 0)
                    seen[file, start] = done + part.num_rows
                    numbers = pa.array(range(done, done + part.num_rows), pa.int64())
                    part = pa.table([part.column("file"), part.column("block_start"), numbers,
                                     part.column("line")],
                                    names=["file", "block_start", "line_no", "line"])
                    if start == 0:
                        part = part.filter(pc.greater_equal(part.column("line_no"), skip))
                    yield from part.to_batches()
    return run


def read_lines(spark: SparkSession, path: str | list[str], skip: int = 0,
               encoding: str = "UTF-8") -> DataFrame:
    """Lines in any encoding with their place in the file: order by (block_start, line_no).

    Files are split and read in parallel; only the first block of a file drops its header lines. The
    text source keeps the bytes of a line as they are, so they are decoded here.
    """
    line = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    placed = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        line.alias("line"))
    return placed.mapInArrow(_drop_head(skip), LINES_SCHEMA)


def _used_positions(batches):
    """One row per task for every character position that is not blank in some line."""
    used = np.zeros(0, dtype=bool)
    for batch in batches:
        text = np.array(batch.column("line").to_pylist(), dtype=str)
        if not text.size or not text.dtype.itemsize:
            continue
        codes = text.view(np.uint32).reshape(len(text), -1)
        here = ((codes != 0) & (codes != ord(" "))).any(axis=0)
        longer = np.zeros(max(len(here), len(used)), dtype=bool)
        longer[:len(used)] |= used
        longer[:len(here)] |= here
        used = longer
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used), pa.int64())], names=["pos"])


def blank_edges(lines: DataFrame) -> list[tuple[int, int]]:
    """(start, length) of the text columns: runs of positions that are not blank in all lines.

    Each task looks at its lines as a character grid and hands on positions only; what reaches the
    driver is one number per character position of the layout.
    """
    used = lines.select("line").mapInArrow(_used_positions, "pos long").distinct().orderBy("pos")
    spans: list[tuple[int, int]] = []
    for (pos,) in used.collect():
        if spans and spans[-1][0] + spans[-1][1] == pos + 1:
            spans[-1] = (spans[-1][0], spans[-1][1] + 1)
        else:
            spans.append((pos + 1, 1))
    return spans


def scan_fixed_width(spark: SparkSession, path: str | list[str], names: list[str], skip: int = 0,
                     encoding: str = "UTF-8",
                     spec: list[tuple[int, int]] | None = None) -> DataFrame:
    """Fixed-width text. Without ``spec`` the column edges come from the positions that are blank
    in all lines; the last column runs to the end of the line."""
    lines = read_lines(spark, path, skip, encoding)
    spans = spec or blank_edges(lines)
    if len(spans) != len(names):
        raise ValueError(f"found {len(spans)} columns for {len(names)} names: {spans}")
    columns = []
    for i, (name, (start, length)) in enumerate(zip(names, spans)):
        width = F.length("line") if i == len(names) - 1 else F.lit(length)
        text = F.trim(F.substring(F.col("line"), F.lit(start), width))
        columns.append(F.when(text != "", text).alias(name))
    return lines.select(*columns)


def split_cells(line: Column, sep: str = ",", quote: str = '"') -> Column:
    """The cells of a delimited line; a quoted cell may hold the separator and doubled quotes. The pattern never
    goes back, so long lines take linear time."""
    s, q = (f"\\Q{x}\\E" for x in (sep, quote))
    plain = f"[^{s}]*+" if len(sep) == 1 else f"(?s:(?!{s}).)*+"
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"{s}({q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}(?={s}|\\z)|{plain})"), F.lit(1))
    quoted = lambda c: (F.length(c) >= 2) & F.startswith(c, F.lit(quote)) & F.endswith(c, F.lit(quote))
    return F.transform(found, lambda c: F.when(quoted(c), F.replace(
        F.substring(c, F.lit(2), F.length(c) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(c))


def scan_ragged_csv(spark: SparkSession, path: str | list[str], skip: int = 1, n_keys: int = 2,
                    keys: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8",
                    fill: bool = True, runs: bool = False) -> DataFrame:
    """Headerless CSV lines of varying width as ordered cells (keys, col_pos, row_pos, value).

    ``fill`` pads every line to the widest line of its file. Within the same keys the reading
    order is (col_pos, row_pos): columns are stacked. Cells may be quoted; ``sep`` is literal text. With ``runs`` a line stays one
    row: ``value`` is the array of its cells, ``col_pos`` the place of the first.
    """
    keys = keys or [f"V{i + 1}" for i in range(n_keys)]
    lines = read_lines(spark, path, skip, encoding).select(
        "file", F.struct("block_start", "line_no").alias("row_pos"), split_cells(F.col("line"), sep).alias("cells"))
    if fill:
        widest = lines.groupBy("file").agg(F.max(F.size("cells")).alias("widest"))
        lines = lines.join(widest, "file").withColumn("cells", F.concat("cells", F.array_repeat(
            F.lit(None).cast("string"), F.col("widest") - F.size("cells"))))
    heads = [F.trim(F.get("cells", F.lit(i))).alias(k) for i, k in enumerate(keys)]
    tokens = F.slice("cells", n_keys + 1, F.greatest(F.size("cells") - n_keys, F.lit(0)))
    if runs:
        return lines.select(*heads, "row_pos", F.lit(0).alias("col_pos"), tokens.alias("value"))
    return lines.select(*heads, "row_pos", F.posexplode(tokens).alias("col_pos", "value"))


def scan_csv_typed(spark: SparkSession, path: str | list[str], schema: str, drop: tuple[str, ...] = (),
                   encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("encoding", encoding)
            .option("sep", sep).csv(path).drop(*drop))


def union_extracts(extracts: list[DataFrame]) -> DataFrame:
    first, *rest = extracts
    for extract in rest:
        first = first.unionByName(extract, allowMissingColumns=True)
    return first
