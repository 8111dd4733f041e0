"""WARC archives compressed with a dictionary per file.

Equal payloads are found by their SHA-256; the page with the smallest id holds the response, the others become revisits without a
payload. Winners are chosen on digests and ids alone; one more aggregation with map-side combine moves each payload once, so a group of
copies of any size costs a task one row. Each task writes archives of bounded size: a Zstandard dictionary is trained on records of the
archive, stands in a leading skippable frame, and every record is a frame of its own. Archives are read back with Spark's binary reader,
so any store that Spark reads will do; they are written through pyarrow's file systems below the given folder, under names of their own
for every attempt of a task. The paths that the successful attempts returned are a stored table, and only these archives are read.
"""
from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.common import bounded_batches, stage
from spindlewatch.session import checked_broadcast, work_dir

#: Fixed values of the format: magic numbers of the dictionary frame and of a dictionary.
SKIPPABLE = 0x184D2A5D
DICTIONARY = 0xEC30A437
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
WRITTEN = "name string, records long, bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def page_of(urn: str) -> int | None:
    page = urn.strip("<>").split(":")[2]
    return int(page) if page else None


def header_value(url: str | None) -> str:
    """A URL must not break the header."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record(kind: str, page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, copy)}", f"WARC-Target-URI: {header_value(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    block = b"" if kind == "revisit" else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A dictionary built from the records, in a skippable frame, then one frame per record."""
    import zstandard

    samples, left = [], SAMPLE_BYTES
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:  # records of the whole archive, not only the first
        if left <= 0:
            break
        samples.append(r[:left])
        left -= len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too short to train on: the sample itself serves as the dictionary
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = trained.as_bytes()
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    head = SKIPPABLE.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
    return head + b"".join(coder.compress(r) for r in records)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    import zstandard

    if not data:
        return
    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    end = 8 + int.from_bytes(data[4:8], "little")
    content = data[8:end]
    raw = int.from_bytes(content[:4], "little") != DICTIONARY
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
    reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(data[end:]), read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 20)
    while version := lines.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        headers = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(": ")
            headers[name] = value.rstrip("\r\n")
        size = int(headers["Content-Length"])
        block = lines.read(size)
        if len(block) != size or lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, copy, url, payload (null for revisits), sha1, n_bytes, kind, refers_to: what the archives will hold.

    Of equal payloads of at least min_bytes bytes the smallest page_id is the response; null ids come last. Of rows that repeat one
    (page_id, payload), one is the response.
    """
    payload = F.coalesce("html", F.lit(""))
    bytes_ = payload.cast("binary")
    sha, sha1, n_bytes = F.unhex(F.sha2(bytes_, 256)).alias("sha"), F.sha1(bytes_).alias("sha1"), F.octet_length(bytes_).cast("long").alias("n_bytes")
    none, zero = F.lit(None), F.lit(0).cast("long")
    order = F.struct(F.struct(F.col("page_id").isNull().alias("none"), "page_id").alias("id"), F.col("url").isNull(), F.coalesce("url", F.lit("")))
    # which page is the response, by keys alone
    keys = pages.select("page_id", "url", sha, sha1, n_bytes).where(F.col("n_bytes") >= min_bytes)
    own = stage(keys.groupBy("sha", "page_id", "url").agg(F.count("*").alias("n"), F.min("sha1").alias("sha1"), F.min("n_bytes").alias("n_bytes")), "payload-keys")
    chosen = own.groupBy("sha").agg(F.min_by(F.struct("page_id", "url"), order).alias("r")).select(F.col("sha").alias("_sha"), F.col("r.page_id").alias("_first"), F.col("r.url").alias("_url"))
    met = own.join(chosen, own["sha"] == chosen["_sha"])
    is_first = F.col("page_id").eqNullSafe(F.col("_first")) & F.col("url").eqNullSafe(F.col("_url"))
    more = met.withColumn("n", F.col("n") - is_first.cast("long")).where("n > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    revisit = more.select("page_id", copies, "url", none.cast("string").alias("payload"), "sha1", "n_bytes", F.lit("revisit").alias("kind"), F.col("_first").alias("refers_to"))
    # one row for each payload, combined in the map tasks: the same choice, with the payload
    shared = pages.select("page_id", "url", payload.alias("payload"), sha, sha1, n_bytes).where(F.col("n_bytes") >= min_bytes)
    first = shared.groupBy("sha").agg(F.min_by(F.struct("page_id", "url", "payload", "sha1", "n_bytes"), order).alias("r"))
    response = first.select("r.page_id", zero.alias("copy"), "r.url", "r.payload", "r.sha1", "r.n_bytes", F.lit("response").alias("kind"), none.cast("long").alias("refers_to"))
    rows = response.unionByName(revisit)
    if min_bytes > 0:
        small = pages.select("page_id", zero.alias("copy"), "url", payload.alias("payload"), sha1, n_bytes, F.lit("response").alias("kind"), none.cast("long").alias("refers_to"))
        rows = rows.unionByName(small.where(F.col("n_bytes") < min_bytes))
    return rows


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives below folder; one row (name, records, bytes) per archive. The archives exist once the result has been computed.

    A repeated attempt writes archives of its own; those of attempts that failed are in no row of the result.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        number, waiting, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, waiting, size
            data = archive(waiting)
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            done = pa.RecordBatch.from_pylist([{"name": name, "records": len(waiting), "bytes": len(data)}])
            number, waiting, size = number + 1, [], 0
            return done

        for batch in batches:
            for r in batch.to_pylist():
                payload = None if r["payload"] is None else r["payload"].encode()
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                refers = record_id(r["refers_to"], 0) if r["kind"] == "revisit" else None
                one = record(r["kind"], r["page_id"], r["copy"], r["url"], payload or b"", digest, r["n_bytes"], refers)
                waiting.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if waiting:
            yield flush()

    return records(pages, min_bytes).mapInArrow(run, WRITTEN)


def read(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """Every record of the archives below folder that written names (of all, without it): page_id, payload_bytes, payload_digest, record_type, refers_to.

    The block of a response is checked against its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in parse(data.as_py()):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    if kind == "response" and (len(block) != size or base32_sha1(block) != digest):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")
                    rows.append((page_of(headers["WARC-Record-ID"]), size, digest, kind, page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if written is not None:
        names = written.select(F.col("name").alias("_name"))
        files = files.join(checked_broadcast(names), F.substring_index("path", "/", -1) == F.col("_name"), "left_semi")
    return files.select("content").mapInArrow(run, ROWS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives pages (page_id, url, html) below the shared folder and reads them back.

    Null html is an empty payload; null ids and urls are kept; repeated rows are records each; an empty table gives no rows and other
    columns are ignored.
    """
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return read(spark, target, stage(write(pages, target, min_bytes), "archives"))
