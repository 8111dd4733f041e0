"""Daily snapshot files as a data source: one partition per day, the header read by the task, filters on day and model pushed down.

Planning starts no job, whatever the number of days: the schema is day, disk, model, failure and the sensors that are asked for, all but
the day as text, as files of different years name and order their columns differently. A day that has no file is an error that names it.
Files are opened with pyarrow's file systems, so any store that these reach will do.
"""
from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, StringType, StructField, StructType

from spindlewatch.functions.names import resolve_columns, sensor_columns
from spindlewatch.functions.scalars import safe_double

# What the two kinds of files call their columns, how they name a day, and their null.
KINDS = {
    "hdd": {"disk": "serial_number", "failure": "failure", "format": "%Y-%m-%d", "null": "", "prefix": ""},
    "ssd": {"disk": "disk_id", "failure": None, "format": "%Y%m%d", "null": "\\N", "prefix": "s"},
}
BLOCK_BYTES = 8 << 20


class DayPartition(InputPartition):
    def __init__(self, day: datetime.date, path: str):
        self.day, self.path = day, path


class DayReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.kind, self.schema_ = KINDS[options.get("kind", "hdd")], schema
        self.folder = options["path"].rstrip("/")
        first = datetime.date.fromisoformat(options["start"])
        self.format = options.get("dateformat", self.kind["format"])
        self.days = [first + datetime.timedelta(days=i) for i in range(int(options["days"]))]
        self.models: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Days choose files and models rows; every filter but those on the model is left to Spark as well."""
        tests = {EqualTo: lambda d, v: d == v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v}
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("model",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.models = own if self.models is None else self.models & own
                continue
            if column == ("day",) and type(f) in tests:
                self.days = [d for d in self.days if tests[type(f)](d, f.value)]
            elif column == ("day",) and isinstance(f, In):
                self.days = [d for d in self.days if d in f.value]
            yield f

    def partitions(self) -> list[DayPartition]:
        return [DayPartition(d, f"{self.folder}/{d.strftime(self.format)}.csv") for d in self.days]

    def read(self, partition: DayPartition):
        import pyarrow as pa
        from pyarrow import compute, csv, fs

        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path or partition.path.startswith("file:") else (fs.LocalFileSystem(), partition.path)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no file of {partition.day}: {partition.path}")
        with store.open_input_stream(path, compression=None) as lines:
            header = csv.open_csv(lines, read_options=csv.ReadOptions(block_size=BLOCK_BYTES)).schema.names
        source = {"disk": self.kind["disk"], "model": "model", "failure": self.kind["failure"], **resolve_columns(sensor_columns(header))}
        read = csv.ConvertOptions(column_types={c: pa.string() for c in header}, null_values=["", self.kind["null"]], strings_can_be_null=True)
        fields = [f.name for f in self.schema_.fields]
        kinds = [pa.date32() if f == "day" else pa.string() for f in fields]
        with store.open_input_stream(path, compression=None) as lines:
            for batch in csv.open_csv(lines, read_options=csv.ReadOptions(block_size=BLOCK_BYTES), convert_options=read):
                table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                if self.models is not None:
                    keep = compute.is_in(table["model"], pa.array(sorted(self.models), pa.string()))
                    table = {n: c.filter(keep) for n, c in table.items()}
                rows = len(next(iter(table.values())))
                columns = []
                for name, kind in zip(fields, kinds):
                    if name == "day":
                        columns.append(pa.array([partition.day] * rows, kind))
                    elif source.get(name) in table:
                        columns.append(table[source[name]].cast(kind))
                    else:
                        columns.append(pa.nulls(rows, kind))
                yield pa.RecordBatch.from_arrays(columns, names=fields)


class DeviceDays(DataSource):
    """Options: path, start (a date), days, kind (hdd or ssd), sensors (canonical names with commas), dateformat."""

    @classmethod
    def name(cls) -> str:
        return "device_days"

    def schema(self) -> StructType:
        sensors = [s.strip() for s in self.options.get("sensors", "").split(",") if s.strip()]
        return StructType([StructField("day", DateType()), *[StructField(c, StringType()) for c in ("disk", "model", "failure", *sensors)]])

    def reader(self, schema: StructType) -> DayReader:
        return DayReader(dict(self.options), schema)


def read_days(spark: SparkSession, path: str, start: str, days: int, sensors: list[str], kind: str = "hdd", models: list[str] | None = None, date_format: str | None = None) -> DataFrame:
    """disk, day, model, failure and the sensors as doubles; rows of SSDs with a null are left out.

    A filter on the day of the result chooses the files. A sensor that a day's file does not have is null there.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DeviceDays)
    reader = spark.read.format("device_days").options(path=path, start=start, days=days, kind=kind, sensors=",".join(sensors))
    raw = (reader.option("dateformat", date_format) if date_format else reader).load()
    if models:
        raw = raw.where(F.col("model").isin(models))
    if kind == "ssd":
        raw = raw.dropna("any", subset=["disk", "model", *sensors])
    disk = F.concat(F.lit(KINDS[kind]["prefix"]), "disk")
    return raw.select(disk.alias("disk"), "day", "model", F.coalesce(F.col("failure").try_cast("int"), F.lit(0)).alias("failure"), *[safe_double(F.col(f"`{c}`")).alias(c) for c in sensors])
