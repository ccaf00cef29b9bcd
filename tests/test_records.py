import csv
import io
import json
import math
import random
import re

from quillspan.operators.records import RESPONSE_EXPORT, faulty, parse_records, sound

GOOD = '1,AB000000001,m,true,1.5,3,"{""a"": 1}"'
PIECE = r'(?:"(?:[^"]|"")*"|[^",]*)'


def reference(raw):
    if raw is None:
        return "columns"
    if not re.match(rf"{PIECE}(?:,{PIECE})*\Z", raw, re.S):
        return "quoting"
    fields = next(csv.reader(io.StringIO(raw, newline=""), strict=True), []) if "\n" not in raw else re.findall(rf"(?:\A|,)({PIECE})", raw, re.S)
    fields = [f[1:-1].replace('""', '"') if f.startswith('"') and f.endswith('"') and "\n" in raw and len(f) > 1 else f for f in fields]
    if len(fields) != 7:
        return "columns"
    a, b, c, d, e, f, g = fields
    ok = re.fullmatch(r"[0-9]+", a) and int(a) > 0 and re.fullmatch(r"AB[0-9]{9}", b) and c.strip() and d.lower() in ("true", "false")
    ok = ok and (e == "" or (re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", e) and 0 <= float(e) < math.inf))
    ok = ok and (f == "" or re.fullmatch(r"[0-9]+", f))
    if ok and g:
        try:
            ok = isinstance(json.loads(g, parse_constant=lambda x: 1 / 0), dict)
        except (ValueError, ZeroDivisionError):
            ok = False
    return None if ok else "value"


def test_against_reference(spark):
    rng = random.Random(3)
    lines = [
        GOOD, GOOD.replace('"{', '{'), GOOD + " ", GOOD + ",", "", ",,,,,,", '"",AB000000001,m,true,,,', '1,AB000000001,"a ""b"", c",TRUE,1e3,,',
        '1,AB000000001,m,true,-1,,', '1,AB000000001,m,true,inf,,', '1,AB000000001,m,true,-0,,', '0,AB000000001,m,true,,,', '1,AB00000001,m,true,,,',
        '1,AB000000001, ,true,,,', '1,AB000000001,m,tru,,,', '1,AB000000001,m,true,,1.0,', '1,AB000000001,m,true,,,[]', "1,AB000000001,m,true,,,{'a': 1}",
        '1,AB000000001,m,true,,,"{""a"": NaN}"', '1,AB000000001,m,true,,,"{""a"": 1} x"', '1,AB000000001,m,true,,,"{""a"": 1},{}"',
        '1,AB000000001,m,true,,,"{""a"": ""x\x01""}"', 'a"b,c', '"a"b,c', '"a""', '""""', '1,AB000000001,"m\nn",true,,,"{\n}"', '1,AB000000001,m\x01S,true,,,{}', None,
    ]
    for _ in range(300):
        s = list(GOOD)
        for _ in range(rng.randint(1, 3)):
            s[rng.randrange(len(s))] = rng.choice('",a1{} ')
        lines.append("".join(s))
    rows = [(i, x, True, "clash") for i, x in enumerate(lines)] * 2
    parsed = parse_records(spark.createDataFrame(rows, "record_id long, raw_line string, done boolean, faults string"), "record_id", "raw_line", RESPONSE_EXPORT)
    got = {r.record_id: r.fault for r in faulty(parsed, "record_id").collect()}
    for i, line in enumerate(lines):
        assert got.get(i) == reference(line), repr(line)
    assert sound(parsed).count() == len(lines) - len(got)


def test_loaded_columns_and_long_text(spark):
    long = '7,AB000000002,"x, ""y""",False,2,,"{""a"": ""' + "q, " * 200_000 + '""}"'
    parsed = parse_records(spark.createDataFrame([(1, long)], "record_id long, raw_line string"), "record_id", "raw_line", RESPONSE_EXPORT)
    row = sound(parsed).first()
    assert (row.response_id, row.model, row.done, row.request_duration_s, row.completion_tokens) == (7, 'x, "y"', False, 2.0, None)
    assert json.loads(row.content)["a"] == "q, " * 200_000


def test_empty(spark):
    empty = spark.createDataFrame([], "record_id long, raw_line string")
    assert parse_records(empty, "record_id", "raw_line", RESPONSE_EXPORT).collect() == []


def test_records_of_null_key_all_stay(spark):
    rows = [(None, GOOD), (None, GOOD), (None, "x"), (None, "x"), (1, GOOD), (1, GOOD), (2, None), (2, None)]
    parsed = parse_records(spark.createDataFrame(rows, "record_id long, raw_line string"), "record_id", "raw_line", RESPONSE_EXPORT)
    assert sorted(str(r.record_id) for r in sound(parsed).collect()) == ["1", "None", "None"]
    assert sorted((str(r.record_id), r.fault) for r in faulty(parsed, "record_id").collect()) == [("2", "columns"), ("None", "columns"), ("None", "columns")]
