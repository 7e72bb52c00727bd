"""Constants that the secret lexer propagates, and the forms of names and values that it reads."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gablework.llm import secret_scan
from gablework.llm.secret_scan import Literal, Summary, literal_score, spans_of


def literals(text):
    return [text[s.start : s.end] for s in spans_of(text) if s.kind == "literal"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abXY12 $*.exampltsuryo%", max_size=14), min_size=1, max_size=6))
def test_joined_summaries_equal_the_summary_of_the_whole(parts):
    whole, joined = Summary.of("".join(parts)), Summary.of(parts[0])
    for p in parts[1:]:
        joined = joined.joined(Summary.of(p))
    assert joined == whole


@pytest.mark.parametrize("lines", [22, 60, 5_000])
def test_doubling_constants(lines):
    text = 'a0 = "Zk8#pQ2!vR7x"\n' + "\n".join(f"a{i + 1} = a{i} + a{i}" for i in range(lines)) + f"\nmaster_password = a{lines}"
    began = time.time()
    assert literals(text) == ["Zk8#pQ2!vR7x"] and time.time() - began < 5


def test_growing_constants_are_linear():
    text = 'a = "x"\n' + 'a = a + "Zk8#pQ2!"\n' * 20_000 + "secret_key = a"
    began = time.time()
    spans_of(text)
    spans_of("a='b=\"' + 'b=\"' + " * 10_000)
    assert time.time() - began < 20


@pytest.mark.parametrize("n", [10, 60, 100, 5_000])
def test_names_of_any_length(n):
    assert literals("db_pwd_" + "x" * n + ' = "Zk8#pQ2!vR7x"') == ["Zk8#pQ2!vR7x"]


@pytest.mark.parametrize(
    "text, secret",
    [
        ('db_pwd = (\n    "Zk8#pQ2!vR7x"\n)', "Zk8#pQ2!vR7x"),
        ('db_pwd = ("Zk8#pQ2!"\n          "vR7xW9tL")', 'Zk8#pQ2!"\n          "vR7xW9tL'),
        ('db_pwd:\n  "Zk8#pQ2!vR7x"', "Zk8#pQ2!vR7x"),
        ("db_pwd = ['Zk8#pQ2!vR7x']", "Zk8#pQ2!vR7x"),
        ("config = \"db_pwd = 'Zk8#pQ2!vR7x'\"", "Zk8#pQ2!vR7x"),
        ("x = y.auth_key = 'G7h2Kq90sLmZ'", "G7h2Kq90sLmZ"),
    ],
)
def test_values_beyond_the_sign(text, secret):
    assert literals(text) == [secret]


def test_schema_of_the_caller_stays(spark):
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id bigint not null, text string not null, n_chars bigint").select("*")
    before = docs.schema.json()
    secret_scan.redacted_documents(docs).collect()
    assert docs.schema.json() == before


def test_score_needs_a_sensitive_name():
    value = Literal(0, 12, "Zk8#pQ2!vR7x")
    assert literal_score("colour", value) == 0 < secret_scan.Scoring().threshold <= literal_score("db_pwd", value)
