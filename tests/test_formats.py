import datetime
import decimal
import json
import struct

import pytest

from streamql.sources import formats as f


def messages(spark, *values):
    return spark.createDataFrame([(v.encode() if isinstance(v, str) else v,) for v in values], "value binary").coalesce(1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_json(spark):
    df = messages(spark, '{"sku": " 90017 ", "title": "lamp", "sold": "TRUE", "price": 4.995, "seen": "2023-11-05T06:07:08", "sizes": [8, "13"], "extra": {"w": 2}}', '[{"sku": 31}, {"sku": 32}, {"sku": 33}]')
    schema = "sku bigint, title string, sold boolean, price decimal(10,2), seen timestamp_ntz, sizes array<int>, extra string"
    got = rows(f.decode(df, "json", schema))
    assert got[0] == (90017, "lamp", True, decimal.Decimal("5.00"), datetime.datetime(2023, 11, 5, 6, 7, 8), [8, 13], '{"w":2}')
    assert [r[0] for r in got[1:]] == [31, 32, 33]
    bad = messages(spark, '{"sku": "nine", "title": "desk"}')
    assert rows(f.decode_json(bad, "sku bigint, title string", ignore_parse_errors=True)) == [(None, "desk")]
    with pytest.raises(Exception):
        f.decode_json(bad, "sku bigint, title string").collect()
    out = rows(f.encode_json(spark.createDataFrame([(12, None)], "sku int, title string")))
    assert json.loads(out[0][0]) == {"sku": 12, "title": None}
    assert json.loads(rows(f.encode_json(spark.createDataFrame([(12, None)], "sku int, title string"), ignore_null_fields=True))[0][0]) == {"sku": 12}


def test_csv(spark):
    df = messages(spark, '41|"left|right"|0.75', "# comment", "oops|z", "43|NONE|8")
    got = rows(f.decode_csv(df, "shelf int, label string, load double", delimiter="|", comments=True, null_literal="NONE", ignore_parse_errors=True))
    assert got == [(41, "left|right", 0.75), (None, "z", None), (43, None, 8.0)]
    out = rows(f.encode_csv(spark.createDataFrame([(6, "x,y", 'say "hi"', None, [4, 5, 6])], "shelf int, label string, quote string, gap string, bins array<int>")))
    assert out[0][0] == b'6,"x,y","say ""hi""",,4;5;6'


def test_raw(spark):
    for kind, fmt, v in [("int", ">i", -70_001), ("bigint", ">q", -(2**63)), ("smallint", ">h", 300), ("double", ">d", -0.125), ("float", ">f", 6.5)]:
        assert rows(f.decode_raw(messages(spark, struct.pack(fmt, v), None), "x", kind)) == [(v,), (None,)]
        assert rows(f.decode_raw(messages(spark, struct.pack(fmt.replace(">", "<"), v)), "x", kind, big_endian=False)) == [(v,)]
    assert rows(f.decode_raw(messages(spark, "größe", None), "x")) == [("größe",), (None,)]
    assert rows(f.decode_raw(messages(spark, b"\x09", b"\x00"), "x", "boolean")) == [(True,), (False,)]
    with pytest.raises(Exception):
        f.decode_raw(messages(spark, b"12345"), "x", "int").collect()


SENSOR = "sensor bigint, place string, celsius double"


def test_debezium_and_ogg(spark):
    for dialect, insert, update, delete in (("debezium", "r", "u", "d"), ("ogg", "I", "U", "D")):
        op = f.CDC[dialect]["op"]
        hall, cellar = {"sensor": 70, "place": "hall", "celsius": 19.25}, {"sensor": 70, "place": "cellar", "celsius": 11}
        sent = [{"after": hall, op: insert}, {"before": hall, "after": cellar, op: update}, {"before": cellar, op: delete}]
        df = messages(spark, *(json.dumps({"before": None, "after": None} | m) for m in sent[:2]), None, json.dumps({"after": None} | sent[2]))
        assert rows(f.decode(df, f"{dialect}-json", SENSOR)) == [("+I", 70, "hall", 19.25), ("-U", 70, "hall", 19.25), ("+U", 70, "cellar", 11.0), ("-D", 70, "cellar", 11.0)]
        with pytest.raises(Exception):
            f.decode(messages(spark, json.dumps({op: "?", "after": hall})), f"{dialect}-json", SENSOR).collect()


def test_maxwell_keeps_what_old_names(spark):
    now = {"sensor": 5, "place": "roof", "celsius": -3.5}
    df = messages(spark, *(json.dumps(m) for m in ({"type": "insert", "data": now}, {"type": "update", "data": now, "old": {"celsius": None, "sensor": 4}}, {"type": "update", "data": now, "old": {}}, {"type": "delete", "data": now})))
    assert rows(f.decode(df, "maxwell-json", SENSOR)) == [
        ("+I", 5, "roof", -3.5), ("-U", 4, "roof", None), ("+U", 5, "roof", -3.5), ("-U", 5, "roof", -3.5), ("+U", 5, "roof", -3.5), ("-D", 5, "roof", -3.5),
    ]


def test_canal_pairs_its_arrays(spark):
    three = [{"sensor": i, "place": p, "celsius": i / 2} for i, p in ((11, "north"), (12, "south"), (13, "west"))]
    update = {"type": "UPDATE", "data": three, "old": [{"place": "east"}, {"celsius": 40.5}, {"place": None}]}
    df = messages(spark, '{"type": "CREATE", "sql": "create table x"}', json.dumps(update), json.dumps({"type": "DELETE", "data": three[:1]}))
    got = rows(f.decode(df, "canal-json", SENSOR))
    # What any old row names counts for all: place and celsius are both taken from the old rows.
    assert got == [
        ("-U", 11, "east", None), ("+U", 11, "north", 5.5), ("-U", 12, None, 40.5), ("+U", 12, "south", 6.0), ("-U", 13, None, None), ("+U", 13, "west", 6.5), ("-D", 11, "north", 5.5),
    ]


def test_cdc_round_trips(spark):
    log = spark.createDataFrame([("+I", 8, "dock", 2.5), ("-D", 8, "dock", 2.5), ("+I", 9, None, None)], "row_kind string, " + SENSOR).coalesce(1)
    for dialect in f.CDC:
        assert rows(f.decode(f.encode(log, f"{dialect}-json"), f"{dialect}-json", SENSOR)) == rows(log)


AVRO = "i int, l bigint, s string, b boolean, d double, dec decimal(10,2), day date, ts timestamp_ntz, a array<int>, m map<string,bigint>, r struct<x:int,y:string>"


def test_avro(spark):
    data = [(77, 2**41, "köln", False, -0.25, decimal.Decimal("990.05"), datetime.date(2020, 12, 31), datetime.datetime(2021, 3, 4, 5, 6, 7, 8000), [None, 21, 3], {"up": 6, "down": -6}, (44, "yes")), (None,) * 11]
    df = spark.createDataFrame(data, AVRO).coalesce(1)
    back = f.decode_avro(f.encode_avro(df), AVRO)
    assert rows(back) == rows(df)
    framed, known = f.encode_avro(df, schema_id=3001), json.dumps(f.avro_schema(AVRO))
    assert rows(f.decode_avro_confluent(framed, "l bigint, s string", lambda i: {3001: known}[i])) == [(2**41, "köln"), (None, None)]
    with pytest.raises(Exception):
        f.decode_avro(messages(spark, b"\x02"), AVRO).collect()


def test_debezium_avro(spark):
    row = "struct<sensor:bigint,place:string>"
    schema = f"op string, before {row}, after {row}"
    known = json.dumps(f.avro_schema(schema))
    decode = lambda data: f.decode_debezium_avro(f.encode_avro(spark.createDataFrame(data, schema).coalesce(1), schema_id=5), "sensor bigint, place string", lambda i: {5: known}[i])
    assert rows(decode([("c", None, (1, "a")), ("u", (1, "a"), (1, "z")), ("d", (1, "z"), None)])) == [("+I", 1, "a"), ("-U", 1, "a"), ("+U", 1, "z"), ("-D", 1, "z")]
    with pytest.raises(Exception):
        decode([("x", None, (1, "a"))]).collect()


def test_protobuf(spark):
    from google.protobuf import descriptor_pb2 as pb

    file = pb.FileDescriptorProto(name="reading.proto", package="lab", syntax="proto3")
    m = file.message_type.add(name="Reading")
    for i, (n, kind, label) in enumerate([("sensor", 3, 1), ("place", 9, 1), ("celsius", 1, 1), ("flags", 9, 3)], 1):
        m.field.add(name=n, number=i, type=kind, label=label)
    ds = pb.FileDescriptorSet(file=[file]).SerializeToString()
    df = spark.createDataFrame([(21, "attic", 30.5, ["hot", "dry"]), (22, "yard", 0.0, None)], SENSOR + ", flags array<string>").coalesce(1)
    assert rows(f.decode_protobuf(f.encode_protobuf(df, ds, "lab.Reading"), SENSOR + ", flags array<string>", ds, "lab.Reading")) == rows(df)
