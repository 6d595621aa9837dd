"""WARC archives: writing page records with revisits, and reading them back by a verified chain of record boundaries.

A record may hold the text that starts a record, so a reader that cuts at each "WARC/1.0" finds false records. Here each
task reads its split cut at that mark and emits, for each candidate, where its declared length says the next record
starts, already followed to the end of the split. Pointer jumping from the start of each file over these exits finds the
one true entry of each split. A second scan walks from there and yields true records only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import ship, stored
from .exact_dedup import filter_bits, repeated_bits, with_suspicion

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "<urn:page:%s>"
DATE = "1970-01-01T00:00:00Z"  # of the records, fixed so that reruns write equal archives
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = ("path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, "
          "declared_digest string, payload binary, piece binary")


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: 8 times 20 bits of the hex form, 4 letters each."""
    hexed = F.sha1(data)
    letters = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: Column, key: Column, url: Column, digest: Column, refers: Column, payload: Column, date: str) -> Column:
    """One record without the two line ends after it; a revisit has the HTTP head only."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    ident = lambda c: F.format_string(ID, F.coalesce(c.cast("string"), F.lit("none")))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(kind == "revisit", head).otherwise(F.concat(head, payload))
    return F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", kind), line("WARC-Record-ID", ident(key)), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", " ")),
        F.when(refers.isNotNull(), line("WARC-Refers-To", ident(refers))).otherwise(""),
        F.when(kind == "revisit", line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 0, date: str = DATE) -> None:
    """Write a record for each row, as uncompressed archives, one per task.

    Of rows with equal payloads of at least `least_bytes`, the one with the smallest key is a response, the others revisit
    it without a payload. Null html is an empty payload; a null url leaves its header out; a null key is written as
    `none` and never is the smallest next to another key. Rows that repeat the smallest key are responses alike. Only pages
    whose payload may be repeated are shuffled. Other columns are not read. All records are dated `date`.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), payload.alias("_payload"))
    long_enough = F.octet_length("_payload") >= least_bytes
    digest = F.unhex(F.sha1(F.col("_payload").cast("binary")))
    prints = stored(rows.where(long_enough).select("_key", digest.alias("_digest")), "prints")
    bits = filter_bits(prints.count())
    filtered = stored(repeated_bits(prints, "_digest", bits), "filter")
    first = (with_suspicion(prints, F.col("_digest"), filtered, bits, "_suspect").where("_suspect")
             .groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    judged = with_suspicion(rows, digest, filtered, bits, "_suspect").withColumn("_suspect", F.col("_suspect") & long_enough)
    alone = judged.where(~F.col("_suspect")).withColumn("_first", F.col("_key"))
    moved = judged.where("_suspect").withColumn("_digest", digest).join(first, "_digest", "left")
    kind = F.when(F.col("_n").isNull() | F.col("_first").isNull() | F.col("_key").eqNullSafe(F.col("_first")), "response")
    moved = moved.withColumn("_kind", kind.otherwise("revisit"))
    both = alone.withColumn("_kind", F.lit("response")).unionByName(moved.drop("_digest", "_n"))
    refers = F.when(F.col("_kind") == "revisit", F.col("_first"))
    both.select(_record(F.col("_kind"), F.col("_key"), F.col("_url"), base32_sha1(F.col("_payload").cast("binary")), refers,
                        F.col("_payload"), date).alias("value")).write.option("lineSep", END.decode()).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """<path, block, content>: the archives cut at each mark, in file order inside each split.

    The marks themselves are cut off; the first segment of a file is what precedes its first mark.
    """
    cut = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return cut.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").cast("binary").alias("content"))


def _head(content: bytes) -> tuple[dict[str, str], int, int] | None:
    """Fields, length of the head with its blank line, and declared block length; None if this is no record head."""
    end = content.find(END)
    if end < 0:
        return None
    fields = {}
    for row in content[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    return (fields, end + len(END), int(size)) if size.isascii() and size.isdigit() else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, int | None, int]]:
    """Split, content, and, in the second scan, the split's entry and base."""
    for batch in batches:
        known = "entry" in batch.schema.names
        for i in range(batch.num_rows):
            yield ((batch.column("path")[i].as_py(), batch.column("block")[i].as_py()), batch.column("content")[i].as_py(),
                   batch.column("entry")[i].as_py() if known else None, batch.column("base")[i].as_py() if known else 0)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate its place in the split and the place where its chain leaves the split (null: it breaks).

    A row without candidate tells the split's length. Per split only two numbers for each candidate are held.
    """

    def close(split, found: list[tuple[int, int | None]], length: int) -> pa.RecordBatch:
        leaves: dict[int, int | None] = {}
        for at, after in reversed(found):
            leaves[at] = after if after is None or after >= length - len(MAGIC) else leaves.get(after)
        rows = [(at, leaves[at]) for at, _ in found] + [(None, length)]
        return pa.RecordBatch.from_pydict({"path": [split[0]] * len(rows), "block": [split[1]] * len(rows),
                                           "at": pa.array([r[0] for r in rows], pa.int64()),
                                           "leave": pa.array([r[1] for r in rows], pa.int64())})

    split, found, place = None, [], 0
    for own, content, _, _ in _rows(batches):
        if own != split:
            if split:
                yield close(split, found, place)
            split, found = own, []
            place = 0 if own[1] == 0 else len(MAGIC)  # in later splits each row follows a mark
            first = own[1] == 0
        if not first:
            head = _head(content)
            at = place - len(MAGIC)
            found.append((at, at + len(MAGIC) + head[1] + head[2] + len(END) if head else None))
        first = False
        place += len(content) + len(MAGIC)
    if split:
        yield close(split, found, place)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """<path, block, base, entry>: each split's first byte and the place in it of its first true record, if it has one.

    One row per split, as many as the scan has tasks.
    """
    ship(spark)
    shape = "path string, block long, at long, leave long"
    emitted = stored(segments(spark, path).mapInArrow(_exits, shape), "candidates")
    # a split's rows end after the mark that opens the next split's first row, so lengths overlap by one mark
    lengths = emitted.where("at is null").select("path", "block", F.col("leave").alias("length"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(lengths.withColumn("base", F.coalesce(F.sum(F.col("length") - len(MAGIC)).over(before), F.lit(0))), "bases")
    nodes = (emitted.where("at is not null").join(F.broadcast(bases), ["path", "block"])
             .select("path", "block", (F.col("base") + F.col("at")).alias("offset"), (F.col("base") + F.col("leave")).alias("leave")))
    targets = nodes.where("leave is not null").select("path", F.col("leave").alias("offset")).distinct()
    starts = nodes.where("offset = 0").select("path", "offset")
    jumps = stored(nodes.where("leave is not null").join(targets.unionByName(starts).distinct(), ["path", "offset"], "left_semi")
                   .select("path", "offset", "leave"), "jumps")
    reached, count = stored(starts, "reached"), -1
    while (n := reached.count()) > count:
        count = n
        step = reached.join(jumps, ["path", "offset"]).select("path", F.col("leave").alias("offset"))
        reached = stored(reached.unionByName(step).distinct(), "reached")
        ahead = jumps.select("path", F.col("offset").alias("leave"), F.col("leave").alias("_next"))
        jumps = stored(jumps.join(ahead, ["path", "leave"]).select("path", "offset", F.col("_next").alias("leave")), "jumps")
    true = nodes.join(reached, ["path", "offset"], "left_semi").groupBy("path", "block").agg(F.min("offset").alias("_first"))
    return bases.join(true, ["path", "block"], "left").select(
        "path", "block", "base", (F.col("_first") - F.col("base")).alias("entry"))


def _parsed(path: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    head, blank, payload = block.partition(END)
    return (path, offset, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
            fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            payload if blank else block, None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True records from each split's entry on; what belongs to a record that leaves its split comes out as pieces."""
    names = ["path", "offset", "warc_type", "record_id", "target_uri", "refers_to", "declared_digest", "payload", "piece"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary()]
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    split, place, parts, have, start, want, fields, broken = None, 0, [], 0, 0, 0, {}, False

    def left() -> list[tuple]:
        """Parts of the record still open, as pieces; the first names itself in record_id."""
        at, rows = start, []
        for k, part in enumerate(parts):
            rows.append((split[0], at, "open" if k == 0 else "more", None, None, None, None, None, part))
            at += len(part)
        return rows

    for own, content, entry, base in _rows(batches):
        if own != split:
            out += left() if split else []
            split, parts, place, first, broken = own, [], 0 if own[1] == 0 else len(MAGIC), own[1] == 0, False
        at = place - len(MAGIC)
        place += len(content) + len(MAGIC)
        if first:  # before the file's first mark
            first = False
            continue
        if parts:
            parts.append(MAGIC + content)
            have += len(MAGIC) + len(content)
        elif broken:
            continue
        elif entry is None or at < entry:
            out.append((split[0], base + at, "more", None, None, None, None, None, MAGIC + content))
            held += len(content)
            continue
        else:
            head = _head(content)
            if head is None:  # the chain ends here: the file is cut off
                broken = True
                continue
            fields, skip, size = head
            parts, start, want = [MAGIC + content], base + at, len(MAGIC) + skip + size
            have = len(MAGIC) + len(content)
        if have >= want:
            whole = b"".join(parts)
            out.append(_parsed(split[0], start, fields, whole[len(MAGIC):][skip:want - len(MAGIC)]))
            held += len(whole)
            parts = []
        if held > 4_000_000 or len(out) >= 2000:
            yield batch()
            out.clear()
            held = 0
    out += left() if split else []
    if out:
        yield batch()


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One record out of its pieces."""
    rows = sorted(zip(table.column("offset").to_pylist(), table.column("piece").to_pylist(), strict=True))
    whole = b"".join(piece for _, piece in rows)[len(MAGIC):]
    head = _head(whole)
    kinds = {"path": pa.string(), "offset": pa.int64(), "warc_type": pa.string(), "record_id": pa.string(),
             "target_uri": pa.string(), "refers_to": pa.string(), "declared_digest": pa.string(), "payload": pa.binary(),
             "piece": pa.binary()}
    got = []
    if head and len(whole) >= head[1] + head[2]:
        got = [_parsed(key[0].as_py(), key[1].as_py(), head[0], whole[head[1]:head[1] + head[2]])]
    return pa.table({n: pa.array([r[i] for r in got], k) for i, (n, k) in enumerate(kinds.items())})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """<path, offset, warc_type, record_id, target_uri, refers_to, declared_digest, payload>: the archives' true records.

    Marks inside payloads are data. A file whose chain breaks yields the records before the break; an empty file yields
    none. Only pieces of records that both hold a mark and leave their split are shuffled.
    """
    with_entry = segments(spark, path).join(F.broadcast(entries(spark, path)), ["path", "block"])
    walked = with_entry.select("path", "block", "content", "entry", "base").mapInArrow(_walk, RECORD)
    whole = walked.where("piece is null").drop("piece")
    pieces = stored(walked.where("piece is not null").select("path", "offset", "warc_type", "piece"), "pieces")
    back = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("warc_type") == "open", F.col("offset")), ignorenulls=True).over(back)
    owned = pieces.withColumn("owner", owner).where("owner is not null")
    merged = owned.groupBy("path", "owner").applyInArrow(_merge, RECORD).drop("piece")
    return whole.unionByName(merged)


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives, read them back: <page_id, payload_bytes, payload_digest, record_type, refers_to>.

    A revisit takes size and digest from the response it refers to. Page ids are integers; others come back null.
    """
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    ident = lambda c: F.when(number(F.col(c)) != "", number(F.col(c)).cast("long"))
    got = stored(read_warc(spark, path).select(
        ident("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.col("warc_type").alias("record_type"),
        ident("refers_to").alias("refers_to"), "declared_digest"), "records")
    responses = got.where("record_type = 'response'").drop("declared_digest")
    revisits = got.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared_digest")
    sizes = (responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"))
             .agg(F.max("payload_bytes").alias("payload_bytes")))
    found = revisits.join(sizes, ["refers_to", "declared_digest"]).select(
        "page_id", "payload_bytes", F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(found)
