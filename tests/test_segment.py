import random
import re

import pytest

from kohorta.operators.segment import (HEADER_ATTRIBUTES, LAB_ATTRIBUTES, TREATMENT_ATTRIBUTES, Rules, header_attributes,
                                       segment_records, with_positions)

NUMBER = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")


def number(v):
    return float(v) if v is not None and NUMBER.match(v) else None


def scan(tokens, allow_final=False):
    """Brute force: cut one token list from the left."""
    found, i, spare = [], 0, 0 if allow_final else 1
    while i < len(tokens):
        left = len(tokens) - spare - i
        if left >= 9 and number(tokens[i + 5]) == 0 and tokens[i] and re.search(r"._|MIN|IM|M[0-9]|WAU|WGA", tokens[i]):
            found.append(("lab", tokens[i:i + 9]))
            i += 9
        elif (left >= 5 and number(tokens[i + 4]) == 0 and tokens[i + 2] and len(tokens[i + 2]) > 5
              and number(tokens[i + 2]) is None):
            found.append(("treatment", tokens[i:i + 5]))
            i += 5
        else:
            i += 1
    return found


def streams(seed, lengths):
    rng = random.Random(seed)
    vocabulary = ["0", "000000", "K_1", "M7", "IM", "Infusion", "Treatment x", "12", "abc", "", None, "1234567", "0.0"]
    return {f"e{i}": [rng.choice(vocabulary) for _ in range(n)] for i, n in enumerate(lengths)}


def run(spark, data, rules=Rules(), **options):
    rows = [("p", e, i, v) for e, tokens in data.items() for i, v in enumerate(tokens)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "patient string, encounter string, pos bigint, value string").repartition(3)
    out = {}
    for r in segment_records(df, ["patient", "encounter"], rules, **options).collect():
        out.setdefault(r.encounter, {}).setdefault(r.rec_no, {})[r.seq] = (r.rec_type, r.attr, r.value)
    got = {}
    for e, records in out.items():
        assert sorted(records) == list(range(1, len(records) + 1))
        got[e] = []
        for n in sorted(records):
            cells = [records[n][s] for s in sorted(records[n])]
            names = LAB_ATTRIBUTES if cells[0][0] == "lab" else TREATMENT_ATTRIBUTES
            assert [c[1] for c in cells] == list(names)
            got[e].append((cells[0][0], [c[2] for c in cells]))
    return got


@pytest.mark.parametrize("options", [{}, {"chunk_size": 9, "fan": 2}, {"chunk_size": 16, "fan": 3}])
@pytest.mark.parametrize("allow_final", [False, True])
def test_equals_brute_force(spark, options, allow_final):
    data = streams(5, [0, 1, 4, 5, 8, 9, 10, 17, 18, 19, 40, 137, 600])
    want = {e: scan(t, allow_final) for e, t in data.items() if scan(t, allow_final)}
    assert run(spark, data, Rules(allow_final=allow_final), **options) == want
    assert sum(map(len, want.values())) > 20


def test_record_on_the_last_token(spark):
    record = ["K_1", "Na", "5", "mmol", "3102019", "0", "x", "1", "9"]
    assert run(spark, {"e": record}) == {}
    assert run(spark, {"e": record}, Rules(allow_final=True)) == {"e": [("lab", record)]}
    assert run(spark, {"e": [*record, "end"]}) == {"e": [("lab", record)]}


def test_header_and_positions(spark):
    rows = [("e", c, r, f"{c}{r}") for c in range(5) for r in range(2)]
    df = with_positions(spark.createDataFrame(rows, "e string, col_pos int, row_pos int, value string"), ["e"],
                        ["col_pos", "row_pos"])
    got = {r.attr: r.value for r in header_attributes(df, ["e"]).collect()}
    assert got == dict(zip(HEADER_ATTRIBUTES, ["00", "01", "10", "11", "20", "21"]))


def test_arrays_of_tokens_are_numbered_as_single_ones(spark):
    """Lines as arrays get the positions of their cells; the line of an encounter that has no other stays one row."""
    lines = [("a", 0, ["x", None, "y", "z"]), ("b", 0, ["1", "2", None]), ("b", 1, ["3", None, "4"]), (None, 0, ["n"]),
             (None, 1, ["m"]), ("c", 2, []), ("d", 3, [None])]
    runs = spark.createDataFrame([(e, r, 0, v) for e, r, v in lines], "e string, row_pos int, col_pos int, value array<string>")
    single = spark.createDataFrame([(e, r, i, x) for e, r, v in lines for i, x in enumerate(v) if x is not None],
                                   "e string, row_pos int, col_pos int, value string")
    order = ["col_pos", "row_pos"]
    expected = {(r.e, r.pos, r.value) for r in with_positions(single, ["e"], order).collect()}
    got = with_positions(runs, ["e"], order).collect()
    assert {(r.e, r.pos + i, x) for r in got for i, x in enumerate(r.value)} == expected
    assert sum(len(r.value) for r in got) == len(expected)
    assert [r.value for r in got if r.e == "a"] == [["x", "y", "z"]]
