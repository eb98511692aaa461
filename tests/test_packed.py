import json

from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.operators.packed import candidates, packed_values, parse, unpack
from tests.helpers import null_pair, pair, pairs


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_notations(spark):
    words = ["red fox", "blue whale", "grey wolf", "read/write lock", "acid, weak", "signal|noise"]
    cells = {1: "red fox, blue whale", 2: "red fox;blue whale ; grey wolf", 3: '["red fox", "blue whale"]', 4: "['red fox', 'grey wolf']", 5: '"acid, weak",red fox', 6: "read/write lock | grey wolf", 7: '[{"term": "red fox", "confidence": 0.1}, {"term": "grey wolf"}]', 8: "[{'topic_descriptor': 'blue whale', 'probability': 0.0}, {'topic_descriptor': 'red fox'}]", 9: "red fox\nblue whale\n", 10: "red fox、blue whale", 11: " , red fox,,blue whale,", 12: "red fox / grey wolf"}
    # the rest of the column tells which values are known
    filler = {100 + i: json.dumps([words[i % 6], words[(i + 1) % 6]]) for i in range(60)}
    rows = [pair(k, keywords=v) for k, v in (cells | filler).items()]
    r = got(unpack(pairs(spark, rows), "pair_id", "keywords"))
    assert r[1] == ["red fox", "blue whale"] and r[2] == ["red fox", "blue whale", "grey wolf"]
    assert r[3] == ["red fox", "blue whale"] and r[4] == ["red fox", "grey wolf"]
    assert r[5] == ["acid, weak", "red fox"] and r[6] == ["read/write lock", "grey wolf"]
    assert r[7] == ["red fox", "grey wolf"] and r[8] == ["blue whale", "red fox"]
    assert r[9] == ["red fox", "blue whale"] and r[10] == ["red fox", "blue whale"]
    assert r[11] == ["red fox", "blue whale"] and r[12] == ["red fox", "grey wolf"]


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [null_pair(1), null_pair(), pair(2, keywords=""), pair(3, keywords="[]"), pair(4, keywords=" , ;"), pair(5, keywords="a, A ,a"), pair(5, keywords="a, A ,a"), pair(6, keywords='["x", null, 3, ""]')]
    df = pairs(spark, rows)
    values = unpack(df, "pair_id", "keywords").collect()
    assert sorted((r.pair_id, r.pos, r.value) for r in values if r.pair_id == 5) == sorted(2 * [(5, 0, "a"), (5, 1, "A"), (5, 2, "a")])
    assert [r.value for r in sorted(values) if r.pair_id == 6] == ["x", "3"]
    assert not [r for r in values if r.pair_id in (1, 2, 3, 4)]
    assert unpack(df.limit(0), "pair_id", "keywords").count() == 0
    assert {r.pair_id for r in packed_values(df, "pair_id", "keywords", 2).collect()} == {5, 6}


def test_very_long_cell(spark):
    cell = ";".join(f"w{i % 50}" for i in range(20_000))
    assert unpack(pairs(spark, [pair(1, keywords=cell), pair(2, keywords="w1;w2")]), "pair_id", "keywords").count() == 20_002


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=6).filter(lambda x: x.strip()), min_size=1, max_size=6))
def test_round_trip(values):
    values = [v.strip() for v in values]
    assert parse(" ; ".join(f'"{v}"' for v in values), frozenset(";"), True) == values
    assert [v for _, v in candidates(json.dumps(values))] == [values]


def test_only_some_ids(spark):
    rows = [pair(i, keywords=f"a{i % 5}, b{i % 3}") for i in range(60)] + [pair(99, keywords='["x"]')]
    df = pairs(spark, rows)
    every = {tuple(r) for r in unpack(df, "pair_id", "keywords").collect()}
    some = {tuple(r) for r in unpack(df, "pair_id", "keywords", only=df.where("pair_id % 7 = 1")).collect()}
    assert some == {r for r in every if r[0] % 7 == 1} and some


def test_three_of_six_separators():
    cell = "a,b;c|d\te•f / g"
    assert len(candidates(cell)) == 2**6 and ["a,b", "c|d", "e•f / g"] in [v for _, v in candidates(cell)]
