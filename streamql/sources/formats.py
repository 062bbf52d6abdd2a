"""Message formats: decode a `value BINARY` column to typed rows, encode rows to bytes.

JSON, CSV, raw and the CDC envelopes are Spark expressions; Avro and protobuf, whose
connectors are separate jars, go through Arrow batches with a reader of their own.
"""

import json
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = {"tinyint": "b", "smallint": "h", "int": "i", "bigint": "q", "float": "f", "double": "d"}


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


#: Timestamps in messages keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

# JSON.


def _lenient(kind: T.DataType) -> T.DataType:
    """Scalars are read as text first, so that "12", 12 and " 12 " are all numbers."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _lenient(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_lenient(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), _lenient(kind.valueType))
    return T.StringType()


def _coerce(x: Column, kind: T.DataType, strict: bool) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(_coerce(x[f.name], f.dataType, strict).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _coerce(e, kind.elementType, strict))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _coerce(v, kind.valueType, strict))
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, T.BooleanType):  # anything but "true" is false
        return F.lower(F.trim(x)) == "true"
    x = F.trim(x)
    if isinstance(kind, T.BinaryType):
        return F.unbase64(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):  # SQL or ISO-8601 text
        x = F.replace(x, F.lit("T"), F.lit(" "))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return x.cast(kind) if strict else F.when(F.rlike(x, F.lit(r"^[+-]?\d+$")), x).try_cast(kind)
    return x.cast(kind) if strict else x.try_cast(kind)


def decode_json(df: DataFrame, schema, value: str = "value", ignore_parse_errors: bool = False) -> DataFrame:
    """Rows of JSON objects; an array at the top gives a row per element. Bad fields are NULL if errors are ignored, else fail."""
    schema = _schema(schema)
    text = F.trim(df[value].cast("string"))
    loose = _lenient(schema)
    options = {"mode": "PERMISSIVE" if ignore_parse_errors else "FAILFAST"}
    many = F.when(F.startswith(text, F.lit("[")), F.from_json(text, T.ArrayType(loose), options)).otherwise(F.array(F.from_json(text, loose, options)))
    rows = df.select(*(df[c] for c in df.columns if c != value), F.explode(many).alias("_row")).where("_row is not null")
    return rows.select(*(c for c in df.columns if c != value), *(_coerce(F.col("_row")[f.name], f.dataType, not ignore_parse_errors).alias(f.name) for f in schema))


def encode_json(df: DataFrame, *, ignore_null_fields: bool = False, map_null_key: str = "FAIL", literal: str = "null") -> DataFrame:
    """A `value` column of JSON objects. NULL map keys: FAIL, DROP or LITERAL."""
    cols = []
    for f in df.schema:
        x = df[f.name]
        if isinstance(f.dataType, T.MapType) and map_null_key == "DROP":
            x = F.map_filter(x, lambda k, _: k.isNotNull())
        elif isinstance(f.dataType, T.MapType) and map_null_key == "LITERAL":
            x = F.transform_keys(x, lambda k, _: F.coalesce(k, F.lit(literal)))
        cols.append(x.alias(f.name))
    options = {"ignoreNullFields": str(ignore_null_fields).lower()} | TIMES
    return df.select(F.to_json(F.struct(*cols), options).cast("binary").alias("value"))


# CSV.


def decode_csv(df: DataFrame, schema, value: str = "value", *, delimiter: str = ",", quote: str | None = '"', comments: bool = False, null_literal: str | None = None, ignore_parse_errors: bool = False) -> DataFrame:
    """One CSV record per message. A bad field is NULL and a short row padded if errors are ignored, else they fail."""
    schema = _schema(schema)
    options = {"sep": delimiter, "quote": quote or "", "escape": quote or "\\", "mode": "PERMISSIVE"}
    if comments:
        options["comment"] = "#"
    loose = ", ".join(f"`{f.name}` STRING" for f in schema)
    text = df[value].cast("string")
    rows = df.select(*(df[c] for c in df.columns if c != value), text.alias("_text"), F.from_csv(text, loose, options).alias("_row"))
    if comments:
        rows = rows.where(~F.startswith(F.ltrim("_text"), F.lit("#")))
    out = []
    for f in schema:
        x = F.col("_row")[f.name]
        x = F.when(x != null_literal, x) if null_literal is not None else x
        out.append(_coerce(x, f.dataType, not ignore_parse_errors).alias(f.name))
    return rows.select(*(c for c in df.columns if c != value), *out)


def encode_csv(df: DataFrame, *, delimiter: str = ",", quote: str = '"', null_literal: str = "", array_delimiter: str = ";") -> DataFrame:
    """A `value` column of CSV records without line ends. Text that is long or holds special characters is quoted."""

    def field(x, kind):
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(x, lambda e: e.cast("string")), array_delimiter, null_literal)
        if isinstance(kind, T.StructType):
            return F.concat_ws(array_delimiter, *(F.coalesce(x[f.name].cast("string"), F.lit(null_literal)) for f in kind))
        return x.cast("string")

    parts = []
    for f in df.schema:
        text = field(df[f.name], f.dataType)
        special = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit(quote)) | F.rlike(text, F.lit(r"[\r\n]|^\s|\s$")) | (F.length(text) > 24)
        quoted = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        parts.append(F.coalesce(F.when(special & F.lit(not isinstance(f.dataType, T.NumericType)), quoted).otherwise(text), F.lit(null_literal)))
    return df.select(F.concat_ws(delimiter, *parts).cast("binary").alias("value"))


# Raw.


def decode_raw(df: DataFrame, column: str, kind: str = "string", value: str = "value", *, big_endian: bool = True) -> DataFrame:
    """The whole message is one value: text, bytes, a boolean (byte not 0) or a number of exact width."""
    x = df[value]
    if kind in ("string", "binary"):
        out = x.cast(kind)
    elif kind == "boolean":
        out = F.hex(x) != "00"
    else:
        width = struct.calcsize(RAW[kind])
        hexed = F.hex(x if big_endian else F.unhex(F.array_join(F.reverse(F.expr(f"transform(sequence(1, {width}), i -> substring(hex(`{value}`), 2 * i - 1, 2))")), "")))
        checked = F.when(x.isNull(), F.lit(None)).when(F.length(x) == width, hexed).otherwise(F.raise_error(F.lit(f"raw {kind} needs {width} bytes")).cast("string"))
        if kind in ("float", "double"):
            out = _float_of(kind)(F.unhex(checked))
        else:
            unsigned = F.conv(checked, 16, 10).cast("decimal(20,0)")
            half = 1 << (8 * width - 1)
            out = F.when(unsigned >= F.lit(str(half)).cast("decimal(20,0)"), unsigned - F.lit(str(2 * half)).cast("decimal(21,0)")).otherwise(unsigned).cast(kind)
    return df.select(*(df[c] for c in df.columns if c != value), F.when(x.isNotNull(), out).alias(column))


def _float_of(kind):
    import numpy as np
    import pandas as pd

    number = np.dtype(">" + RAW[kind])

    @F.pandas_udf(kind)
    def read(x: pd.Series) -> pd.Series:
        there = x.notna().to_numpy()
        out = pd.Series([None] * len(x), dtype=object)
        out[there] = np.frombuffer(b"".join(x[there]), number).astype(number.newbyteorder("=")).tolist()
        return out

    return read


# Change data capture: envelopes to a changelog, and back.

#: Per dialect: how the operation is named, which names insert, update and delete, where the images stand.
CDC = {
    "debezium": {"op": "op", "insert": ("c", "r"), "update": ("u",), "delete": ("d",), "before": "before", "after": "after"},
    "ogg": {"op": "op_type", "insert": ("I",), "update": ("U",), "delete": ("D",), "before": "before", "after": "after"},
    "maxwell": {"op": "type", "insert": ("insert",), "update": ("update",), "delete": ("delete",), "before": "old", "after": "data"},
    "canal": {"op": "type", "insert": ("INSERT",), "update": ("UPDATE",), "delete": ("DELETE",), "before": "old", "after": "data"},
}


def decode_cdc(df: DataFrame, schema, dialect: str, value: str = "value", ignore_parse_errors: bool = False) -> DataFrame:
    """row_kind and the columns of schema: +I, or -U and +U, or -D per change. NULL values (tombstones) are skipped.

    Maxwell and Canal give only the changed fields of the old row: a field they name keeps
    that value, null included, any other has the new row's. Canal's rows come in arrays, and
    what any of its old rows names counts for all. An unknown operation fails, but for
    Canal's CREATE, which is skipped.
    """
    schema, d = _schema(schema), CDC[dialect]
    text = df[value].cast("string")
    loose = _lenient(schema).simpleString()
    many = dialect == "canal"
    envelope = f"`{d['op']}` STRING, `{d['before']}` {f'ARRAY<{loose}>' if many else loose}, `{d['after']}` {f'ARRAY<{loose}>' if many else loose}"
    rows = df.where(text.isNotNull()).select(text.alias("_text"), F.from_json(text, envelope, {"mode": "PERMISSIVE" if ignore_parse_errors else "FAILFAST"}).alias("_e"))
    op, before, after = F.col("_e")[d["op"]], F.col("_e")[d["before"]], F.col("_e")[d["after"]]
    if many:
        named = F.array_distinct(F.flatten(F.transform(F.from_json(F.get_json_object("_text", "$.old"), "ARRAY<MAP<STRING,STRING>>"), lambda m: F.map_keys(m))))
        rows = rows.where(op.isNull() | (op != "CREATE")).select("*", named.alias("_named"), F.posexplode(after).alias("_i", "_after")).withColumn("_before", F.get(before, F.col("_i")))
    elif dialect == "maxwell":
        rows = rows.select("*", F.json_object_keys(F.get_json_object("_text", "$.old")).alias("_named"), before.alias("_before"), after.alias("_after"))
    else:
        rows = rows.select("*", before.alias("_before"), after.alias("_after"))
    if dialect in ("maxwell", "canal"):
        old = F.struct(*(F.when(F.array_contains("_named", F.lit(f.name)), F.col("_before")[f.name]).otherwise(F.col("_after")[f.name]).alias(f.name) for f in schema))
        gone = F.col("_after")
    else:
        old = gone = F.col("_before")
    entry = lambda kind, row: F.struct(F.lit(kind).alias("row_kind"), row.alias("row"))
    changes = (
        F.when(op.isin(*d["insert"]), F.array(entry("+I", F.col("_after"))))
        .when(op.isin(*d["update"]), F.array(entry("-U", old), entry("+U", F.col("_after"))))
        .when(op.isin(*d["delete"]), F.array(entry("-D", gone)))
    )
    if not ignore_parse_errors:
        bad = F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null"))))
        rows = rows.where(F.when(changes.isNull(), bad.cast("boolean")).otherwise(F.lit(True)))
    out = rows.select(F.inline(changes))
    return out.select("row_kind", *(_coerce(F.col("row")[f.name], f.dataType, not ignore_parse_errors).alias(f.name) for f in schema))


def encode_cdc(df: DataFrame, dialect: str) -> DataFrame:
    """A changelog as CDC messages: +I and +U carry the row as new, -U and -D as deleted."""
    d = CDC[dialect]
    row = F.struct(*(c for c in df.columns if c != "row_kind"))
    adds = F.col("row_kind").isin("+I", "+U")
    image = F.array(row) if dialect == "canal" else row
    op = F.when(adds, d["insert"][0]).otherwise(d["delete"][0]).alias(d["op"])
    if dialect in ("maxwell", "canal"):
        body = F.struct(image.alias("data"), op)
    else:
        body = F.struct(F.when(~adds, image).alias(d["before"]), F.when(adds, image).alias(d["after"]), op)
    return df.select(F.to_json(body, {"ignoreNullFields": "false"} | TIMES).cast("binary").alias("value"))


# Avro.


def avro_schema(schema, name: str = "record") -> dict:
    """The Avro schema of a row type: every field nullable."""
    simple = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}

    def of(kind, path):
        if type(kind) in simple:
            return simple[type(kind)]
        if isinstance(kind, T.DateType):
            return {"type": "int", "logicalType": "date"}
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return {"type": "long", "logicalType": "timestamp-millis"}
        if isinstance(kind, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": ["null", of(kind.elementType, path)]}
        if isinstance(kind, T.MapType):
            return {"type": "map", "values": ["null", of(kind.valueType, path)]}
        if isinstance(kind, T.StructType):
            return {"type": "record", "name": path, "fields": [{"name": f.name, "type": ["null", of(f.dataType, f"{path}_{f.name}")]} for f in kind]}
        raise ValueError(f"no Avro type for {kind}")

    return of(_schema(schema), name)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n):
        if self.at + n > len(self.data):
            raise ValueError("Avro body ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self):
        shift = n = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def blocks(self):
        while n := self.long():
            if n < 0:
                self.long()
                n = -n
            yield from range(n)


def _avro_read(r: _Reader, s):
    import datetime
    import decimal

    if isinstance(s, list):
        return _avro_read(r, s[r.long()])
    kind = s["type"] if isinstance(s, dict) else s
    logical = s.get("logicalType") if isinstance(s, dict) else None
    if isinstance(kind, (dict, list)):
        return _avro_read(r, kind)
    if kind == "null":
        return None
    if kind == "boolean":
        return r.take(1) != b"\0"
    if kind in ("int", "long"):
        n = r.long()
        if logical == "date":
            return datetime.date(1970, 1, 1) + datetime.timedelta(days=n)
        if logical and logical.endswith(("timestamp-millis", "timestamp-micros")):  # all are read as milliseconds
            return datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=n)
        return n
    if kind == "float":
        return struct.unpack("<f", r.take(4))[0]
    if kind == "double":
        return struct.unpack("<d", r.take(8))[0]
    if kind in ("bytes", "string", "fixed"):
        b = r.take(s["size"] if kind == "fixed" else r.long())
        if logical == "decimal":
            x = decimal.Decimal(int.from_bytes(b, "big", signed=True)).scaleb(-s.get("scale", 0), decimal.Context(prec=60))
            return x if len(x.as_tuple().digits) <= s["precision"] else None
        return b.decode() if kind == "string" else b
    if kind == "enum":
        return s["symbols"][r.long()]
    if kind == "array":
        return [_avro_read(r, s["items"]) for _ in r.blocks()]
    if kind == "map":
        return {r.take(r.long()).decode(): _avro_read(r, s["values"]) for _ in r.blocks()}
    return {f["name"]: _avro_read(r, f["type"]) for f in s["fields"]}


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _avro_write(x, s) -> bytes:
    import datetime

    if isinstance(s, list):
        return _zigzag(0) if x is None else _zigzag(1) + _avro_write(x, s[1])
    kind, logical = (s["type"], s.get("logicalType")) if isinstance(s, dict) else (s, None)
    if kind == "boolean":
        return b"\1" if x else b"\0"
    if kind in ("int", "long"):
        if logical == "date":
            x = (x - datetime.date(1970, 1, 1)).days
        elif logical:
            x = (x.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1)
        return _zigzag(x)
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", x)
    if kind in ("bytes", "string"):
        if logical == "decimal":
            n = int(x.scaleb(s["scale"]))
            x = n.to_bytes(max(1, (n + (n < 0)).bit_length() // 8 + 1), "big", signed=True)
        b = x.encode() if kind == "string" else bytes(x)
        return _zigzag(len(b)) + b
    if kind == "array":
        return (_zigzag(len(x)) + b"".join(_avro_write(e, s["items"]) for e in x) if x else b"") + b"\0"
    if kind == "map":
        return (_zigzag(len(x)) + b"".join(_avro_write(k, "string") + _avro_write(v, s["values"]) for k, v in x.items()) if x else b"") + b"\0"
    return b"".join(_avro_write(x[f["name"]], f["type"]) for f in s["fields"])


def _per_message(df, value, schema, read, ignore_parse_errors):
    """Rows of `schema` from each message by a Python reader, over Arrow batches; NULL messages are skipped."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(schema)

    def rows(batches):
        target = to_arrow_schema(schema, timezone="UTC") if "timezone" in to_arrow_schema.__code__.co_varnames else to_arrow_schema(schema)
        for b in batches:
            out = []
            for message in b.column(0).to_pylist():
                if message is None:
                    continue
                try:
                    out.append(read(message))
                except Exception:
                    if not ignore_parse_errors:
                        raise
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in out], schema=target)

    return df.select(df[value]).mapInArrow(rows, schema)


def decode_avro(df: DataFrame, schema, value: str = "value", *, writer_schema: dict | None = None, ignore_parse_errors: bool = False) -> DataFrame:
    """Bare Avro bodies, written with writer_schema (by default that of the row type)."""
    writer = writer_schema or avro_schema(schema)
    return _per_message(df, value, schema, lambda m: _avro_read(_Reader(m), writer), ignore_parse_errors)


def decode_avro_confluent(df: DataFrame, schema, registry, value: str = "value", *, ignore_parse_errors: bool = False) -> DataFrame:
    """Avro behind a magic byte and a schema id; registry(id) gives the writer's schema, asked once per id and task."""
    known: dict[int, dict] = {}

    def read(message):
        if message[0]:
            raise ValueError("unknown magic byte")
        i = int.from_bytes(message[1:5], "big")
        if i not in known:
            found = registry(i)
            known[i] = json.loads(found) if isinstance(found, str) else found
        return _avro_read(_Reader(message[5:]), known[i])

    return _per_message(df, value, schema, read, ignore_parse_errors)


def encode_avro(df: DataFrame, *, schema_id: int | None = None) -> DataFrame:
    """A `value` column of Avro bodies, framed if a schema id is given."""
    import pyarrow as pa

    s = avro_schema(df.schema)
    head = b"" if schema_id is None else b"\0" + schema_id.to_bytes(4, "big")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([head + _avro_write(r, s) for r in b.to_pylist(maps_as_pydicts="strict")], pa.binary())], names=["value"])

    return df.mapInArrow(rows, "value binary")


# Protobuf.


def decode_protobuf(df: DataFrame, schema, descriptor_set: bytes, message: str, value: str = "value", *, ignore_parse_errors: bool = False) -> DataFrame:
    """Messages of a type in a serialised FileDescriptorSet; empty repeated fields and maps are NULL."""
    names = [f.name for f in _schema(schema)]

    def read(data, cache={}):  # noqa: B006 - one class per task
        if "class" not in cache:
            cache["class"] = _message_class(descriptor_set, message)
        m = cache["class"].FromString(data)
        return {n: _plain(m, n) for n in names if n in m.DESCRIPTOR.fields_by_name}

    return _per_message(df, value, schema, read, ignore_parse_errors)


def encode_protobuf(df: DataFrame, descriptor_set: bytes, message: str) -> DataFrame:
    """A `value` column of messages whose fields are set by column name."""
    import pyarrow as pa

    def rows(batches):
        cls = _message_class(descriptor_set, message)
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = cls()
                for k, v in r.items():
                    if isinstance(v, list):
                        getattr(m, k).extend(v)
                    elif v is not None:
                        setattr(m, k, v)
                out.append(m.SerializeToString(deterministic=True))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return df.mapInArrow(rows, "value binary")


def _message_class(descriptor_set: bytes, message: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(message))


def _plain(m, name):
    f = m.DESCRIPTOR.fields_by_name[name]
    if f.message_type is not None and f.message_type.GetOptions().map_entry:
        return dict(getattr(m, name)) or None
    repeated = f.is_repeated if hasattr(f, "is_repeated") else f.label == f.LABEL_REPEATED
    if repeated:
        items = list(getattr(m, name))
        return [_fields(x) for x in items] if f.message_type else items or None
    if f.message_type is not None:
        return _fields(getattr(m, name)) if m.HasField(name) else None
    return getattr(m, name)


def _fields(m):
    return {f.name: _plain(m, f.name) for f in m.DESCRIPTOR.fields}


DECODERS = {"json": decode_json, "csv": decode_csv, "raw": decode_raw, "avro": decode_avro, "avro-confluent": decode_avro_confluent, "protobuf": decode_protobuf}
DECODERS |= {f"{d}-json": (lambda d: lambda df, schema, **o: decode_cdc(df, schema, d, **o))(d) for d in CDC}
ENCODERS = {"json": encode_json, "csv": encode_csv, "avro": encode_avro, "protobuf": encode_protobuf} | {f"{d}-json": (lambda d: lambda df, **o: encode_cdc(df, d, **o))(d) for d in CDC}


def decode(df: DataFrame, fmt: str, schema, **options) -> DataFrame:
    return DECODERS[fmt](df, schema, **options)


def encode(df: DataFrame, fmt: str, **options) -> DataFrame:
    return ENCODERS[fmt](df, **options)


def decode_debezium_avro(df: DataFrame, schema, registry, value: str = "value") -> DataFrame:
    """Debezium envelopes as framed Avro; tombstones are skipped, an unknown operation fails."""
    row = _schema(schema).simpleString()
    flat = decode_avro_confluent(df, f"op STRING, before {row}, after {row}", registry, value)
    entry = lambda kind, x: F.struct(F.lit(kind).alias("row_kind"), F.col(x).alias("row"))
    changes = F.when(F.col("op").isin("c", "r"), F.array(entry("+I", "after"))).when(F.col("op") == "u", F.array(entry("-U", "before"), entry("+U", "after"))).when(F.col("op") == "d", F.array(entry("-D", "before")))
    checked = F.when(changes.isNull(), F.raise_error(F.lit("unknown operation"))).otherwise(F.lit(True)).cast("boolean")
    return flat.where(checked).select(F.inline(changes)).select("row_kind", "row.*")
