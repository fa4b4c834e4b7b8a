"""The sheet: a table of numbered rows, or blocks in a folder with a table that orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def insert_rows(existing: DataFrame, block: DataFrame, target_row: int) -> DataFrame:
    """Insert a block ``(rank 1…n, cells)`` at a row and push the rest down.

    ``existing(row_no, cells)``.  Narrow apart from counting the block.
    """
    count = block.agg(F.count("*")).scalar()
    pushed = existing.withColumn(
        "row_no", F.when(F.col("row_no") >= target_row, F.col("row_no") + count).otherwise(F.col("row_no"))
    )
    placed = block.withColumn("row_no", F.col("rank") + (target_row - 1)).drop("rank")
    return pushed.unionByName(placed)


def write_sheet(rows: DataFrame, path: str, file_format: str = "parquet", partitions: int | None = None) -> None:
    """Write rows so that file order follows ``row_no``; sorted by range, not in one task."""
    ranged = rows.repartitionByRange(partitions, "row_no") if partitions else rows.repartitionByRange("row_no")
    writer = ranged.sortWithinPartitions("row_no").write.mode("errorifexists")
    (writer.option("header", True).option("escape", '"') if file_format == "csv" else writer).format(file_format).save(path)


#: A piece of the sheet: ranks ``low`` to ``high`` of a block stand from ``row_no`` on.
#: ``after`` notes what the batch that wrote the block left to go on with.
OFFSETS = "block string, low bigint, high bigint, row_no bigint, after map<string,bigint>"


class Sheet:
    """A sheet that grows by inserted blocks; inserting renumbers no rows.

    Rows of a block are written once, with their rank in it.  Which ranks stand where is
    said by a table of offsets with a line for each piece of a block: an insertion cuts
    at most one piece in two, moves the pieces below and adds its own, and reads no rows.
    Its lines number at most twice the insertions, so one task and the driver hold them.

    A block becomes part of the sheet when the next version of the offsets, one file, is
    committed.  What a failed attempt left is not read and is overwritten by the next; a
    block that is in the sheet already is not inserted again.
    """

    def __init__(self, spark: SparkSession, path: str, cells: T.StructType):
        """``cells`` is the schema of a row without its number."""
        self._spark, self._path = spark, path.rstrip("/")
        self._schema = T.StructType([T.StructField("rank", T.LongType()), *cells.fields])

    @classmethod
    def create(cls, rows: DataFrame, path: str) -> Sheet:
        """A new sheet of ``rows(row_no, cells)``; missing numbers are blank rows."""
        spark = rows.sparkSession
        sheet = cls(spark, path, T.StructType([f for f in rows.schema.fields if f.name != "row_no"]))
        low, high = rows.agg(F.min("row_no"), F.max("row_no")).first()
        sheet._write_block("first", rows.withColumnRenamed("row_no", "rank"))
        sheet._commit(0, [] if low is None else [("first", low, high, low, {})])
        return sheet

    def _write_block(self, name: str, block: DataFrame) -> None:
        cells = [F.col(f.name).cast(f.dataType) for f in self._schema.fields]
        ranged = block.select(*cells).repartitionByRange("rank").sortWithinPartitions("rank")
        ranged.write.mode("overwrite").parquet(f"{self._path}/blocks/{name}")

    def _commit(self, version: int, lines: list[tuple]) -> None:
        offsets = self._spark.createDataFrame(lines, OFFSETS).coalesce(1)
        offsets.write.mode("overwrite").parquet(f"{self._path}/offsets/version={version}")

    def _versions(self) -> list[int]:
        """Committed versions of the offsets."""
        folder = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path}/offsets/version=*/_SUCCESS")
        files = folder.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        found = files.globStatus(folder) or []
        return sorted(int(s.getPath().getParent().getName().removeprefix("version=")) for s in found)

    def offsets(self) -> tuple[int, list[tuple]]:
        """The latest version and its lines, from the top of the sheet."""
        latest = self._versions()[-1]
        rows = self._spark.read.schema(OFFSETS).parquet(f"{self._path}/offsets/version={latest}").collect()
        return latest, sorted((tuple(r) for r in rows), key=lambda line: line[3])

    def insert(self, block: DataFrame, target_row: int, name: str, after: dict[str, int] | None = None) -> bool:
        """Put ``block(rank 1…n, cells)`` at a row and push the rest down; false if the sheet has it already."""
        version, lines = self.offsets()
        if any(line[0] == name for line in lines):
            return False
        self._write_block(name, block)
        written = self._spark.read.schema(self._schema).parquet(f"{self._path}/blocks/{name}")
        count = written.agg(F.max("rank")).first()[0] or 0
        self._commit(version + 1, inserted(lines, target_row, count, name, after or {}))
        return True

    def rows(self) -> DataFrame:
        """(row_no, cells): blocks joined with the few lines that place their ranks."""
        lines = self.offsets()[1]
        names = sorted({line[0] for line in lines if line[2] >= line[1]})
        if not names:
            empty = self._spark.createDataFrame([], self._schema)
            return empty.withColumnRenamed("rank", "row_no")
        placed = self._spark.createDataFrame(lines, OFFSETS).select(
            F.col("block"), "low", "high", (F.col("row_no") - F.col("low")).alias("shift")
        )
        paths = [f"{self._path}/blocks/{name}" for name in names]
        named = F.element_at(F.split("_metadata.file_path", "/"), -2)
        blocks = self._spark.read.schema(self._schema).parquet(*paths).withColumn("block", named)
        inside = (blocks["block"] == placed["block"]) & blocks["rank"].between(F.col("low"), F.col("high"))
        cells = [blocks[f.name] for f in self._schema.fields[1:]]
        return blocks.join(F.broadcast(placed), inside).select((F.col("rank") + F.col("shift")).alias("row_no"), *cells)


def inserted(lines: list[tuple], target_row: int, count: int, name: str, after: dict[str, int]) -> list[tuple]:
    """Offsets after ``count`` rows went in at ``target_row``."""
    out = []
    for block, low, high, row_no, noted in lines:
        end = row_no + high - low
        if end < target_row:
            out.append((block, low, high, row_no, noted))
        elif row_no >= target_row:
            out.append((block, low, high, row_no + count, noted))
        else:
            cut = low + target_row - row_no
            out += [(block, low, cut - 1, row_no, noted), (block, cut, high, target_row + count, noted)]
    # A batch without rows is noted too, so that it is not done again.
    out.append((name, 1, count, target_row, after))
    return out
