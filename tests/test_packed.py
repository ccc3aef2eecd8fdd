import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators.packed import Tokenizer, explode_values

CASES = [
    (None, []), ("", []), ("  ", []), ("##", []), ("||", []), ('""', []), ("« »", []), ("#6#", ["6"]), ("#24#17#", ["24", "17"]), ("2,,20,,20|15", ["2", "20", "20", "15"]),
    ("23 ;3", ["23", "3"]), ("a\tb\nc\r\nd", ["a", "b", "c", "d"]), ('"Culture ""vivante"""\t«35»', ['Culture "vivante"', "35"]), ("«Habitat; bâti ancien»#Retraites", ["Habitat; bâti ancien", "Retraites"]),
    ("« Justice »;  Climat ", ["Justice", "Climat"]), ("Outre-mer / insularité", ["Outre-mer / insularité"]), ('"a, b', ['"a', "b"]), ("«a; b", ["«a", "b"]), ("«a «b; c» d»;e", ["a «b; c» d", "e"]),
    ('""",""', ['"""']), ('5" écran; x', ['5" écran', "x"]), ('"a";"b;c";d', ["a", "b;c", "d"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert Tokenizer().split(text) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='abé ";,#|«»', min_size=1, max_size=8).map(str.strip).filter(lambda v: v and v.count("«") == v.count("»") == 0), max_size=6), st.sampled_from("#|;,\t\n"))
def test_round_trip(values, separator):
    packed = separator.join('"' + v.replace('"', '""') + '"' for v in values)
    assert Tokenizer().split(packed) == [v.strip() for v in values]


def test_long_fields_take_linear_time():
    began = time.time()
    for text in ('"' * 300_001 + ";x", "«" * 200_000 + ";x", "a;" * 200_000, '";' * 100_001, "«;" * 100_000):
        Tokenizer().split(text)
    assert time.time() - began < 30


def test_rows(spark):
    df = spark.createDataFrame([(1, "a;a;b", "p"), (1, "a;a;b", "p"), (2, None, "p"), (None, "x", "p"), (3, " ; ", "p"), (None, "x", "p"), (4, "u;v", "p"), (4, "u;w", "p"), (4, "u;v", "p")], "id bigint, f string, pos string")
    got = {tuple(r) for r in explode_values(df, "id", "f").collect()}
    assert got == {(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (None, 1, "x"), (4, 1, "u"), (4, 2, "v"), (4, 2, "w")}
    assert explode_values(df, "id", "f").count() == len(got)
    assert explode_values(df.limit(0), "id", "f").count() == 0
