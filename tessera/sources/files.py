"""Record files: CSV and TSV, JSON in three shapes, Parquet; profiles, mappings and checks before resolution.

Files are read by Spark in parallel; the driver looks at a first block alone. A CSV file is read in splits, also where quoted cells
go over lines' ends. Rows and sizes are not limited, but a field's length and the number of columns are.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.functions import normalize as N
from tessera.plans.tables import cut

MAX_FIELD, MAX_COLUMNS = 32_768, 250
#: Bytes that are looked at first; the longest file that is hashed.
BLOCK, HASHED = 1 << 16, 100 << 20
SEPARATORS = ",\t;|"
#: Canonical fields, and those of which a mapping needs one.
MATCHABLE = ("entityName", "legalName", "brandName", "domain", "ticker", "cik", "lei", "figi", "isin", "cusip")
FIELDS = (*MATCHABLE, "recordId", "exchange", "addressLine1", "city", "state", "postalCode", "country", "observationDate", "source", "metadata", "sourceRecord")
COLUMN = {"recordId": "record_id", "entityName": "entity_name", "legalName": "legal_name", "brandName": "brand_name", "addressLine1": "address_line1", "postalCode": "postal_code", "observationDate": "observation_date"}
# Usual column names and the fields they stand for.
SUGGESTIONS = {
    "record_id": "recordId", "source_id": "recordId", "id": "recordId", "company": "entityName", "company_name": "entityName", "merchant_name": "entityName", "legal_name": "legalName", "brand": "brandName", "ticker_symbol": "ticker", "symbol": "ticker",
    "ticker": "ticker", "url": "domain", "website": "domain", "company_website": "domain", "domain": "domain", "event_date": "observationDate", "event_dt": "observationDate", "transaction_date": "observationDate", "observation_date": "observationDate",
    "country_code": "country", "country": "country", "cik": "cik", "lei": "lei", "figi": "figi", "isin": "isin", "cusip": "cusip", "exchange": "exchange",
}


class IngestionError(ValueError):
    pass


# --- what a file is


def first_block(spark: SparkSession, path: str, n: int = BLOCK) -> tuple[bytes, bool]:
    """(the first n bytes of a file, or of the first file of a folder; whether that is all of it), read as a stream wherever it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isDirectory():
        inside = sorted((s.getPath().getName(), s.getPath()) for s in files.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._")
        if not inside:
            raise IngestionError(f"{path} holds no file.")
        where = inside[0][1]
    stream = files.open(where)
    try:
        found = bytes(stream.readNBytes(n + 1))
    finally:
        stream.close()
    if not found:
        raise IngestionError(f"{path} is empty.")
    return found[:n], len(found) <= n


def encoding_of(block: bytes, whole: bool) -> str | None:
    """utf-8, windows-1252, or None where neither fits. A character that the block's end cuts is no fault."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(block, whole)
        return "utf-8"
    except UnicodeDecodeError:
        undefined = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
        return None if undefined & set(block) else "windows-1252"


def separator_of(text: str) -> str:
    """The one that cuts most of the first lines into as many cells as the header, and into most; a comma if none cuts them."""
    lines = text.splitlines()[:50]

    def fit(sep: str) -> tuple:
        widths = [len(r) for r in csv.reader(lines, delimiter=sep) if r]
        return (sum(w == widths[0] for w in widths) / len(widths), widths[0]) if widths and widths[0] > 1 else (0.0, 0)

    return max(SEPARATORS, key=fit)


#: What Windows-1252 has where ISO 8859-1, which Spark reads, has controls.
_WINDOWS = [x.decode(kind, "ignore") for x in [bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))] for kind in ("iso-8859-1", "windows-1252")]


def looked_at(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """(encoding, separator, whether some line has an odd number of quotes), by one scan of all lines."""
    block, whole = first_block(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd, broken = spark.read.text(path).agg(F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)), F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False))).first()
    encoding = encoding_of(block, whole)
    if encoding == "utf-8" and broken:
        encoding = "windows-1252"  # what is none of UTF-8 comes after the first block
    if not encoding:
        raise IngestionError(f"{path} is neither UTF-8 nor Windows-1252 text.")
    return encoding, separator_of(block.decode(encoding, "ignore").removeprefix("\ufeff")), odd


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, separator)"""
    return looked_at(spark, path)[:2]


def facts(spark: SparkSession, path: str, most: int = HASHED) -> DataFrame:
    """(path, length, sha256) of each file; no hash of those that are longer than most bytes."""
    files = spark.read.format("binaryFile").load(path)
    hashed = files.where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return hashed.unionByName(files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("string").alias("sha256")))


# --- readers


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their numbers in reading order, 1 and up without gaps; written once so that they stay."""
    held = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r.part: r.n for r in held.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    offset = F.get(F.array(*map(F.lit, before)), F.shiftright("_at", 33).cast("int")) if before else F.lit(0)
    return held.select(*[F.col(f"`{c}`") for c in rows.columns], (offset + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long").alias(name))


# Quoted cells that go over lines' ends. A line begins a record or goes on in a quoted cell; which, depends on all lines before. Each split says what it makes of either beginning,
# and those sayings are put together in the order of splits: so a file is read in splits, and a record belongs to the split that it begins in.

#: Splits whose first line goes on in a cell, or that end in one, and are told to all tasks at most; characters of a record that goes over a split's end.
TOLD, LONGEST = 100_000, 16 << 20


def _open(line: str, separator: str, inside: bool) -> bool:
    """Whether a quoted cell is open after the line, by the csv module's own rules."""
    if '"' not in line:
        return inside
    after = iter((f'"{line}' if inside else line, "."))
    next(csv.reader(after, delimiter=separator))
    return next(after, None) is None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _decoder(encoding: str):
    return lambda line: line.decode("utf-8-sig" if encoding == "utf-8" else "cp1252", "replace")


def _splits(lines: DataFrame, encoding: str, separator: str) -> DataFrame:
    """(file, block, fresh, going, head): whether a quoted cell is open after the split, if none is before it and if one is; and, if one is, the lines that it takes to
    close it (null if that is none, or more than LONGEST)."""
    decode = _decoder(encoding)

    def said(batches):
        key, fresh, going, head, closed, size = None, False, True, [], False, 0
        given = lambda: pa.RecordBatch.from_pylist([dict(zip(("file", "block", "fresh", "going", "head"), (*key, fresh, going, "\n".join(head) if closed else None), strict=True))], schema)
        for batch in batches:
            for *now, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key:
                        yield given()
                    key, fresh, going, head, closed, size = now, False, True, [], False, 0
                line = decode(line)
                fresh, going = _open(line, separator, fresh), _open(line, separator, going)
                if not closed and size <= LONGEST:
                    head.append(line)
                    size += len(line)
                    closed = not going
        if key:
            yield given()

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("fresh", pa.bool_()), ("going", pa.bool_()), ("head", pa.string())])
    return lines.mapInArrow(said, "file string, block long, fresh boolean, going boolean, head string")


def _beginnings(splits: DataFrame) -> DataFrame:
    """(file, block, going, tail, cut) of splits whose first line goes on in a cell (going) or that end in one: tail, the lines that close it, cut, that there are none."""
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # a split ends alike whatever its beginning (sure), or turns one into the other, or leaves it
    s = splits.withColumns({"sure": F.when(F.col("fresh") == F.col("going"), F.col("fresh")), "turns": F.col("fresh") & ~F.col("going")})
    s = s.withColumn("n", F.sum(F.col("turns").cast("int")).over(w))
    last = F.last(F.when(F.col("sure").isNotNull(), F.struct("sure", "n")), True).over(before)
    s = s.withColumn("last", last).withColumn("turned", (F.coalesce(F.lag("n").over(w), F.lit(0)) - F.coalesce("last.n", F.lit(0))) % 2 == 1)
    s = s.withColumn("going", F.coalesce("last.sure", F.lit(False)) != F.col("turned"))
    s = s.withColumns({"next": F.lead("going").over(w), "tail": F.lead("head").over(w)})
    on = F.coalesce("next", F.lit(False))
    return s.where(F.col("going") | on).select("file", "block", "going", F.when(on, F.col("tail")).alias("tail"), (on & F.col("tail").isNull()).alias("cut"))


def _cells(spark: SparkSession, path: str, encoding: str, separator: str, names: list[str]) -> DataFrame | None:
    """(names.., n): the cells of each record as text, empty ones null, and how many there are, in the order of the file. None if too many splits must be told."""
    lines, decode, width = _lines(spark, path), _decoder(encoding), len(names)
    told = cut(_beginnings(_splits(lines, encoding, separator)))
    if told.count() > TOLD:
        return None
    if not told.where("cut").isEmpty():
        raise IngestionError(f"A quoted cell of {path} goes on for more than {LONGEST:,} characters, or does not end.")

    def parsed(batches):
        key, record, inside, tail, skipping = None, [], False, None, False
        rows = [[] for _ in range(width + 1)]

        def done() -> None:
            nonlocal record
            text, record = [*record, *(tail.split("\n") if inside and tail is not None else ())], []
            if text[-1:] and text[-1].endswith("\r"):
                text[-1] = text[-1][:-1]
            cells = next(csv.reader([t + "\n" for t in text[:-1]] + text[-1:], delimiter=separator), [])
            if cells:
                for i in range(width):
                    rows[i].append(cells[i] or None if i < len(cells) else None)
                rows[width].append(len(cells))

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*(pa.array(r, pa.string()) for r in rows[:-1]), pa.array(rows[-1], pa.int32())], [*names, "n"])
            for r in rows:
                r.clear()
            return out

        header = False
        for batch in batches:
            for *now, line, going, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if record and not header:
                        done()
                    key, record, tail, skipping = now, [], rest, bool(going)
                    inside, header = skipping, now[1] == 0
                line = decode(line)
                inside = _open(line, separator, inside)
                if skipping:  # the split before has these lines
                    skipping = inside
                    continue
                record.append(line)
                if not inside:
                    if header:
                        record, header = [], False
                    else:
                        done()
            if len(rows[width]) >= 1000:
                yield given()
        if record and not header:
            done()
        yield given()

    kinds = ", ".join(f"{n} string" for n in names)
    own = lines.join(F.broadcast(told.select("file", "block", "going", "tail")), ["file", "block"], "left").select("file", "block", "line", "going", "tail")
    return own.mapInArrow(parsed, f"{kinds}, n int")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. Headers must be there and differ; rows must have as many cells as the header."""
    encoding, separator, odd = looked_at(spark, path)
    head = first_block(spark, path)[0].decode(encoding, "ignore").removeprefix("\ufeff")
    header = [h.strip() for h in next(csv.reader(head.splitlines(True), delimiter=separator), [])]
    if "" in header or not header:
        raise IngestionError(f"The header of {path} has no name for column {header.index('') + 1 if header else 1}.")
    if again := {h for h in header if header.count(h) > 1}:
        raise IngestionError(f"The header of {path} names {', '.join(sorted(again))} more than once.")
    names = [f"c{i}" for i in range(len(header))]

    def checked(rows: DataFrame, ragged: Column) -> None:
        if rows.where(ragged).limit(1).count():
            bad = numbered(rows.withColumn("bad_", ragged), "row").where("bad_").orderBy("row").first()
            raise IngestionError(f"Data row {bad.row} of {path} does not have {len(header)} cells as the header has.")

    if odd and (rows := _cells(spark, path, encoding, separator, names)) is not None:
        checked(rows, F.col("n") != len(header))
        return rows.select(*[F.col(n).alias(h) for n, h in zip(names, header, strict=True)])
    options = {
        "schema": ", ".join(f"{n} string" for n in (*names, "extra", "bad")), "sep": separator, "encoding": "utf-8" if encoding == "utf-8" else "iso-8859-1", "header": True, "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "bad", "enforceSchema": True, "multiLine": odd,
    }
    rows = spark.read.option("columnPruning", False).csv(path, **options)  # all cells are looked at, whatever is asked for
    cell = re.escape(separator)
    bare = F.regexp_replace("bad", rf'(^|{cell})"[^"]*+(?:""[^"]*+)*+"', "$1")  # separators inside quotes are none
    few = F.col(names[-1]).isNull() & F.col("bad").isNotNull() & (F.size(F.split(bare, cell)) < len(header))
    checked(rows, F.col("extra").isNotNull() | few)
    text = (lambda c: F.col(c)) if encoding == "utf-8" else (lambda c: F.translate(c, *_WINDOWS))
    return spark.read.csv(path, **options).select(*[text(n).alias(h) for n, h in zip(names, header, strict=True)])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object with them under ``records``."""
    rows = spark.read.json(path, multiLine=True)
    if rows.columns == ["records"] and isinstance(rows.schema["records"].dataType, ArrayType):
        if not isinstance(rows.schema["records"].dataType.elementType, StructType):
            raise IngestionError(f"{path} has records that are no objects.")
        rows = rows.selectExpr("inline(records)")
    return _objects(rows, path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object on each line; blank lines are skipped."""
    return _objects(spark.read.json(path), path)


def _objects(rows: DataFrame, path: str) -> DataFrame:
    if "_corrupt_record" in rows.columns:
        raise IngestionError(f"{path} has records that are no JSON objects.")
    return rows


READERS = {".csv": read_csv, ".tsv": read_csv, ".json": read_json, ".jsonl": read_lines, ".ndjson": read_lines, ".parquet": lambda s, p: s.read.parquet(p), ".pq": lambda s, p: s.read.parquet(p)}


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in READERS:
        raise IngestionError(f"{path}: files that end with {kind or 'nothing'} are not read; those that end with {' '.join(READERS)} are.")
    return READERS[kind](spark, path)


# --- profiles and checks


def profile(rows: DataFrame) -> DataFrame:
    """(column, rows, null_rate, longest) in one pass: null and empty count as missing."""
    text = {c: F.col(f"`{c}`").cast("string") for c in rows.columns}
    one = rows.agg(
        F.count("*").alias("rows"),
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.round(F.avg(F.when(t.isNull() | (t == ""), 1.0).otherwise(0.0)), 6).alias("null_rate"), F.coalesce(F.max(F.length(t)), F.lit(0)).alias("longest")) for c, t in text.items()
        ]).alias("columns"),
    )
    return one.select("rows", F.explode("columns").alias("c")).select("c.column", "rows", "c.null_rate", "c.longest")


def check_fields(rows: DataFrame, most: int = MAX_FIELD, columns: int = MAX_COLUMNS) -> None:
    """Raises if there are no rows, more columns, or a field longer than most characters."""
    if len(rows.columns) > columns:
        raise IngestionError(f"There are {len(rows.columns)} columns; at most {columns} are read.")
    found = profile(rows).collect()  # a row per column
    if not found or not found[0].rows:
        raise IngestionError("There are no records.")
    if long := [f"{r.column} ({r.longest:,})" for r in found if r.longest > most]:
        raise IngestionError(f"Fields may have {most:,} characters; longer are {', '.join(long)}.")


# --- mappings


def suggest_mapping(columns: list[str]) -> dict[str, str]:
    """A field for each column of a usual name, whatever its case and blanks; others are metadata."""
    usual = ("_".join(c.casefold().strip().split(" ")) for c in columns)
    return {c: SUGGESTIONS.get(u, "metadata") for c, u in zip(columns, usual, strict=True)}


def load_mapping(document: dict | None, columns: list[str]) -> tuple[dict[str, str], str | None, str]:
    """(mapping, date pattern, digest of the content) of a mapping document, or a suggestion."""
    document = document or {}
    mapping = document.get("mapping", {k: v for k, v in document.items() if k not in ("dateFormat", "mappingVersion")}) or suggest_mapping(columns)
    return mapping, document.get("dateFormat"), _digest(document)


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fingerprint(mapping_version: str, mapping_sha256: str | None, sources: dict) -> str:
    return _digest({"mappingVersion": mapping_version, "mappingContentSha256": mapping_sha256, "providers": sources})


def mapping_faults(mapping: dict[str, str], columns: list[str]) -> list[str]:
    """All that is wrong with a mapping of columns to fields."""
    named = [(c, f) for c, f in mapping.items() if f not in ("", "ignore")]
    fields = [f for _, f in named if f != "metadata"]
    faults = {
        "there is nothing in it": not mapping, "columns that the file lacks": sorted({c for c, _ in named} - set(columns)), "fields that are none": sorted(set(fields) - set(FIELDS)),
        "fields that several columns are mapped to": sorted({f for f in fields if fields.count(f) > 1}),
        f"none of the fields that records are matched by ({', '.join(MATCHABLE)})": bool(mapping) and not set(fields) & set(MATCHABLE),
    }
    return [f"{what}: {', '.join(found)}" if isinstance(found, list) else what for what, found in faults.items() if found]


def validate_mapping(mapping: dict[str, str], columns: list[str]) -> None:
    if faults := mapping_faults(mapping, columns):
        raise IngestionError(f"The mapping has {'; '.join(faults)}.")


def default_id(source: str, row: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{source}:"), row.cast("string")).cast("binary"), 256), 1, 20)


def apply_mapping(rows: DataFrame, mapping: dict[str, str], source: str, row: str, date_format: str | None = None) -> DataFrame:
    """Canonical columns, ids where there are none, other columns as a metadata map and the whole row as JSON. row: a column of row numbers."""
    columns = [c for c in rows.columns if c != row]
    validate_mapping(mapping, columns)
    chosen = {t: s for s, t in mapping.items() if t not in ("", "ignore", "metadata")}
    value = lambda t: N.normalize_null(F.when(F.col(f"`{chosen[t]}`").cast("string") != "", F.col(f"`{chosen[t]}`").cast("string")))
    out = {COLUMN.get(t, t): value(t) for t in chosen}
    out["record_id"] = F.coalesce(out.get("record_id", F.lit(None)), default_id(source, F.col(row)))
    out["source"] = F.coalesce(out.get("source", F.lit(None)), F.lit(source))
    if "country" in out:
        out["country"] = N.normalize_country(out["country"])
    if "observation_date" in out:
        out["raw_date"], out["observation_date"] = out["observation_date"], N.parse_date(out["observation_date"], date_format)
    rest = [c for c in columns if c not in chosen.values()]
    out["metadata"] = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])) if rest else F.create_map().cast("map<string,string>")
    out["source_record"] = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return rows.select(F.col(row).alias("row"), *[c.alias(n) for n, c in out.items()])


def duplicate_ids(records: DataFrame) -> DataFrame:
    """(record_id, n, first_row) of ids that several rows have."""
    return records.groupBy("record_id").agg(F.count("*").alias("n"), F.min("row").alias("first_row")).where("n > 1")


def bad_dates(records: DataFrame) -> DataFrame:
    return records.where("raw_date is not null and observation_date is null").select("row", "raw_date")


def preflight(records: DataFrame) -> None:
    """Raises for ids that repeat and dates that are none, with the first of them."""
    if bad := duplicate_ids(records).orderBy("first_row").first():
        raise IngestionError(f"{bad.n} rows have the id {bad.record_id!r}, the first of them data row {bad.first_row}.")
    if "raw_date" in records.columns and (bad := bad_dates(records).orderBy("row").first()):
        raise IngestionError(f"Data row {bad.row} has {bad.raw_date!r} for a date.")
