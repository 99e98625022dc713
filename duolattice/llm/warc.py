"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: payloads that occur more than once are found by digest; of equal payloads the one with the largest page_id is a
`response` record, the others are `revisit` records that refer to it and carry no payload. The digests are aggregated before
they are joined, and the join leaves hot payloads to the skew handling of adaptive execution. Each task writes its records to
new files below the shared folder and returns their paths; what a lost or repeated task has written is in no manifest and so
never read. Reading: each archive's dictionary is loaded from its first frame, then frame after frame is decoded and checked.

Defined results: a null payload is an empty one; a null url writes no WARC-Target-URI and is read as null; rows with a null
page_id count as smaller than all others; page_ids must be whole numbers (other types are an error); repeated rows with the largest page_id of their payload are all responses; an empty
table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, integral, materialized, scratch_path

#: Fixed values of the formats: the skippable frame that holds a dictionary, the first bytes of trained dictionaries, the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
TRAINED_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task begins a new archive, and the sample that a dictionary is made from.
ROLL_BYTES = 32 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def urn_page(urn: str) -> int | None:
    if not urn.startswith("<urn:x-page:") or not urn.endswith(">"):
        raise ValueError(f"not the id of a page's record: {urn}")
    name = urn[len("<urn:x-page:") : -1]
    return None if name == "none" else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One WARC record. The block is an HTTP response whose Content-Length is that of the full payload; a revisit has its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]):
    """A dictionary trained on the samples, or made of their beginnings where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"".join(s[:1024] for s in samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def load_dictionary(data: bytes):
    import zstandard

    if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        data = zstandard.ZstdDecompressor().decompress(data)
    trained = data[:4] == struct.pack("<I", TRAINED_MAGIC)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """One archive: the first records wait until there is enough to make the dictionary from."""

    def __init__(self, folder: str):
        self.path = f"{folder}/part-{uuid.uuid4().hex}.warc.zst"
        fs, where = file_system(self.path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(where, compression=None)
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.records = 0
        self.press = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.press is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._write(self.press.compress(record))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        import zstandard

        dictionary = make_dictionary(self.waiting)
        data = dictionary.as_bytes()
        self._write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self._write(self.press.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.press is None:
            self._begin()
        self.out.close()
        return self.path, self.records, self.size


def frames(uri: str) -> Iterator[bytes]:
    """The decoded frames of an archive, one by one."""
    import zstandard

    fs, where = file_system(uri)
    with fs.open_input_stream(where, compression=None) as f:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError(f"{uri}: no leading frame")
        magic, size = struct.unpack("<II", head)
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri}: it doesn't begin with a dictionary frame")
        data = f.read(size)
        if len(data) != size:
            raise ValueError(f"{uri}: its dictionary is cut off")
        reader = zstandard.ZstdDecompressor(dict_data=load_dictionary(data))
        rest = b""
        while True:
            rest = rest or f.read(1 << 16)
            if not rest:
                return
            one, out = reader.decompressobj(), []
            while True:
                out.append(one.decompress(rest))
                if one.eof:
                    rest = one.unused_data
                    break
                rest = f.read(1 << 16)
                if not rest:
                    raise ValueError(f"{uri}: its last frame is cut off")
            yield b"".join(out)


def headers(block: bytes, first: str) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and what follows them; the first line must begin with `first`."""
    head, blank, rest = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or not lines[0].startswith(first):
        raise ValueError(f"a header doesn't begin with {first}: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    return fields, rest


def parse_record(record: bytes) -> dict:
    """Fields of the one record of a frame; wrong headers, lengths or digests are errors."""
    fields, rest = headers(record, "WARC/1.")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing:
        raise ValueError(f"a record lacks {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a record's block has {len(rest) - 4} bytes, not {size}, or isn't its frame's only one")
    http, payload = headers(rest[:size], "HTTP/")
    full = int(http["content-length"])
    kind, name = fields["warc-type"], fields["warc-payload-digest"]
    if not name.startswith("sha1:"):
        raise ValueError(f"unknown digest: {name[:20]}")
    digest = name[5:]
    refers = None
    if kind == "response":
        if len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{fields['warc-record-id']}: its payload doesn't match its length or digest")
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in fields:
            raise ValueError(f"{fields['warc-record-id']}: not a revisit of an identical payload")
        refers = urn_page(fields["warc-refers-to"])
    else:
        raise ValueError(f"unknown record type: {kind}")
    return {"page_id": urn_page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": full, "payload_digest": digest, "refers_to": refers, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes one record per row and returns the manifest, already written: path, n_records, n_bytes."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(integral(pages, id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_bytes
    # Only digests that occur more than once, written, so that the join knows their size: few go to all tasks, and else the hot ones are split.
    kept = materialized(rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payloads")
    judged = rows.join(kept.withColumn("known", F.lit(True)), "digest", "left")
    judged = judged.select("page_id", "payload", "url", "digest", "keeper", (F.col("known").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in chunks(batches):
            for page, payload, url, digest, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or ArchiveWriter(folder)
                writer.add(record_bytes(page, url, payload.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), revisit, keeper, date))
                if writer.size >= ROLL_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_records", "n_bytes"])

    return materialized(judged.mapInArrow(kernel, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (of responses)."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    fields = fields if with_payload else fields[:-1]
    schema = pa.schema(fields)

    def batch_of(records: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], t) for n, t in fields], schema=schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                records, size, n = [], 0, 0
                for frame in frames(path):
                    r = parse_record(frame)
                    if not with_payload:
                        r["payload"] = None
                    records.append(r)
                    n += 1
                    size += len(r["payload"] or b"") + 200
                    if size >= 4 << 20:
                        yield batch_of(records)
                        records, size = [], 0
                if n != expected:
                    raise ValueError(f"{path} has {n} records, not {expected}")
                if records:
                    yield batch_of(records)

    n = manifest.count()
    sql = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return manifest.select("path", "n_records").repartition(max(1, n)).mapInArrow(kernel, sql)
