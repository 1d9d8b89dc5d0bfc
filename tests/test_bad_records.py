import random
import re
from datetime import datetime

from lodestone.operators.bad_records import split_valid

SCHEMA = "raw_id long, raw_line string, run_id string"


def brute(line):
    """The reason by a plain character walk, None for a valid record."""
    text = line or ""
    text = text[:-1] if text.endswith("\r") else text
    fields, i = [], 0
    while True:
        if i < len(text) and text[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(text):
                    return "quoting"
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + text[i], i + 1
            if i < len(text) and text[i] != ",":
                return "quoting"
        else:
            j = text.find(",", i)
            j = len(text) if j < 0 else j
            value = text[i:j]
            if '"' in value:
                return "quoting"
            i = j
        fields.append(value.strip(" "))
        if i >= len(text):
            break
        i += 1
    if len(fields) != 9:
        return "columns"
    number = lambda v: re.fullmatch("[0-9]+", v) and int(v) <= 2147483647
    time = re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", fields[8])
    try:
        time = time and datetime.strptime(fields[8], "%Y-%m-%d %H:%M:%S")
    except ValueError:
        time = None
    ok = number(fields[0]) and fields[1] and fields[2] in ("mysql", "oracle", "postgres", "tsql", "sqlite") and number(fields[3]) and (fields[4] == "" or number(fields[4])) and number(fields[5]) and fields[7].lower() in ("true", "false") and time
    return None if ok else "value"


GOOD = '1,a.sql,mysql,3,2,1,"x, ""y""\nz",true,2024-02-29 23:59:59'
CASES = [
    GOOD, GOOD + "\r", None, "", "\r", "1,2", GOOD.replace("mysql", "MYSQL"), GOOD.replace("2024-02-29", "2023-02-29"), GOOD.replace("23:59:59", "24:00:00"), GOOD.replace("1,a", "0000000000001,a"), GOOD.replace("1,a", "2147483648,a"),
    GOOD.replace("1,a", "١,a"), GOOD.replace(",2,", ",,"), GOOD.replace(",2,", ", ,"), GOOD.replace("a.sql", " "), GOOD.replace("true", "TrUe "), GOOD.replace('"x', ' "x'), GOOD.replace('z"', 'z" '), GOOD.replace("a.sql", 'a"b'), GOOD + ",", '"' * 5, '""', '"a', GOOD.replace("z", "\\1\\0\\2 \x01"),
    GOOD.replace("z", "q" * 200_000 + '""' * 5_000), GOOD.replace("2024-02-29 23:59:59", "0000-01-01 00:00:00"), GOOD.replace("true", "yes"), "1;a;mysql;3;2;1;;true;2024-01-01 00:00:00",
]


def test_cases_and_random_lines_against_a_walk(spark):
    rnd = random.Random(5)
    lines = CASES + ["".join(rnd.choice(['"', ",", "a", " ", "\n", "\r", "1"]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    pieces = GOOD.split(",")
    for _ in range(300):
        p = list(pieces)
        p[rnd.randrange(len(p))] = rnd.choice(["", " ", '"', '""', "x", "-1", "+1", "1.0", "99999999999", '" 7 "', "2024-13-01 00:00:00", "false"])
        lines.append(",".join(p))
    df = spark.createDataFrame([(i, line, "clash") for i, line in enumerate(lines)], SCHEMA)
    valid, bad = split_valid(df)
    got = {r.raw_id: r.reason for r in bad.collect()} | {r.raw_id: None for r in valid.collect()}
    assert got == {i: brute(line) for i, line in enumerate(lines)}


def test_typed_values_replace_clashing_columns(spark):
    valid, _ = split_valid(spark.createDataFrame([(1, GOOD, "clash")], SCHEMA))
    row = valid.first()
    assert valid.columns.count("run_id") == 1
    assert (row.run_id, row.skipped_previews, row.dewrapped, row.finished_at) == (1, 'x, "y"\nz', True, datetime(2024, 2, 29, 23, 59, 59))


def test_empty_table(spark):
    valid, bad = split_valid(spark.createDataFrame([], SCHEMA))
    assert valid.count() == bad.count() == 0
