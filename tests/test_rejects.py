import csv
import io
import json

from tessera.sources.rejects import parse_lines, split_lines

V = ",".join(["0.5"] * 15 + ["-1e-2"])
J = f"[{V}]"
GOOD_CSV = [
    f'a,b,"{J}",', f'"a","b, ""c""","{J}","{{""x"":1}}"', f'a,"two\nlines","{J}",', f'a,,"{J}",', "a,text,,", "a,text,null,", "a,text,[],{}", "a,null,[],", "  a,é\x00字,,\r\n", 'a," ",,',
]
BAD_CSV = {
    "a,b,c": "csv_missing_columns", f'a,b,"{J}",,': "csv_too_many_columns", f'a,"b,"{J}",': "csv_unterminated_quote", f'a,"b"x,"{J}",': "csv_quoting", f'a,b "c" d,"{J}",': "csv_quoting",
    'a"b,"c,d,e': "csv_quoting", "a,b\nc,,": "csv_quoting", ",b,,": "observation_id", " a b,c,,": "observation_id", f'{"x" * 65},b,,': "observation_id", "a,,,": "no_content", "a,,null,": "no_content",
    'a,b,"[1,2]",': "embedding_width", 'a,b,"[1,]",': "invalid_json", "a,b,x,": "invalid_json", 'a,b,"{}",': "embedding_not_a_list", f'a,b,"[{V[:-5]}NaN]",': "invalid_json", f'a,b,"[{V[:-5]}1e999]",': "embedding_value",
}
GOOD_JSON = [
    f'{{"observation_id":"a","embedding":{J}}}', '{"text":"t"}', '{"observation_id":-12,"text":"t","embedding":[]}', '{"observation_id":"a","text":"\\ud800","embedding":null,"x":[1,{"y":null}]}',
    f'{{"observation_id":"b","observation_id":"a","embedding":{J}}}', "\t{\"text\": \"t\"}\r\n", '{"text":"t","embedding":[ ]}',
]
BAD_JSON = {
    "[1]": "not_an_object", "null": "not_an_object", "{}": "no_content", '{"text":""}': "no_content", '{"text":"t"} x': "invalid_json", "{'text':'t'}": "invalid_json", '{"text":"t",}': "invalid_json",
    '{"text":"a\tb"}': "invalid_json", '{"text":NaN}': "invalid_json", '{"observation_id":null,"text":"t"}': "observation_id", '{"observation_id":1.0,"text":"t"}': "observation_id",
    '{"observation_id":"a b","text":"t"}': "observation_id", '{"observation_id":"é","text":"t"}': "observation_id", '{"text":"t","embedding":"x"}': "embedding_not_a_list", '{"text":"t","embedding":[1]}': "embedding_width",
    f'{{"embedding":[{V[:-5]}true]}}': "embedding_value", f'{{"embedding":[{V[:-5]}"1"]}}': "embedding_value", f'{{"embedding":[{V[:-5]}null]}}': "embedding_value", "﻿{}": "invalid_json",
}
SCHEMA = "raw_id bigint, batch_file string, line_no int, fmt string, raw_line string, received_at timestamp_ntz, reason string"


def rows_of(cases):
    return [(i, "f", i + 1, fmt, line, None, "clash") for i, (fmt, line) in enumerate(cases)]


def test_each_case(spark):
    cases = [("csv", x) for x in GOOD_CSV] + [("jsonl", x) for x in GOOD_JSON] + [("csv", x) for x in BAD_CSV] + [("jsonl", x) for x in BAD_JSON]
    cases += [("csv", ""), ("jsonl", "  # no"), ("csv", None), ("jsonl", " \t\r\n")]
    got = {r["raw_id"]: r for r in parse_lines(spark.createDataFrame(rows_of(cases), SCHEMA)).collect()}
    good = len(GOOD_CSV) + len(GOOD_JSON)
    for i, (_, line) in enumerate(cases[:good]):
        assert got[i]["status"] == "loaded", (line, got[i])
    for i, reason in enumerate([*BAD_CSV.values(), *BAD_JSON.values()], start=good):
        assert (got[i]["status"], got[i]["reason"]) == ("rejected", reason), (cases[i], got[i])
    assert set(got) == set(range(good + len(BAD_CSV) + len(BAD_JSON)))
    for i, line in enumerate(GOOD_CSV):
        fields = next(csv.reader(io.StringIO(line.strip(" \t\r\n"), newline=""), strict=True))
        assert (got[i]["observation_id"], got[i]["text"]) == (fields[0], fields[1] or got[i]["text"]), line
    assert got[0]["embedding"] == json.loads(J)
    assert got[len(GOOD_CSV) + 1]["observation_id"] == f"obs-{len(GOOD_CSV) + 2}"


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x", None, None), (2, "f", None, "jsonl", '{"text":"t"}', None, None), (3, "f", 1, "csv", f"a,{'y' * 3_000_000},,", None, None), (3, "f", 1, "csv", f"a,{'y' * 3_000_000},,", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["raw_id"], r["status"], r["reason"], len(r["text"] or "")) for r in parse_lines(df).collect())
    assert got == [(1, "rejected", "unknown_format", 0), (2, "rejected", "observation_id", 0), (3, "loaded", None, 3_000_000), (3, "loaded", None, 3_000_000)]
    good, bad = split_lines(df)
    assert good.count() == 2 and {r["raw_line"] for r in bad.collect()} == {"x", '{"text":"t"}'}
    assert parse_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_values_keep_their_form(spark):
    line = '{"text": 12, "metadata": {"layer": 7, "big": 123456789012345678901234567890, "x": [1.5, true, null, "é"]}}'
    got = parse_lines(spark.createDataFrame(rows_of([("jsonl", line)]), SCHEMA)).first()
    assert got["text"] == "12" and got["metadata"] == '{"layer":7,"big":123456789012345678901234567890,"x":[1.5,true,null,"é"]}'
