import dataclasses

import pytest

from plumbrook.functions import text


@pytest.mark.parametrize(
    ("name", "expected"),
    [("Foo", "Foo"), ("FooBarBaz", "FooBarBaz"), ("foo_bar", "FooBar"), ("foo__bar", "Foo_Bar"), ("Foo_Bar", "FooBar"), ("Foo42Bar", "Foo42Bar"), ("FOOBARBaz", "FOOBARBaz"), ("foo  bar_ Baz", "Foo_Bar_Baz"), ("foo  Bar__bAZ", "Foo_Bar_BAZ")],
)
def test_camel_case(name, expected):
    assert text.camel_case(name) == expected


@pytest.mark.parametrize(
    ("name", "expected"),
    [("FooBarBaz", "foo_bar_baz"), ("foo__bar", "foo__bar"), ("Foo_Bar", "foo_bar"), ("Foo42", "foo42"), ("Foo42Bar", "foo42_bar"), ("FooBARBaz", "foo_bar_baz"), ("FOOBARBaz", "foobar_baz"), ("foo  bar_ Baz", "foo__bar__baz"), ("foo  Bar__bAZ", "foo__bar__b_az")],
)
def test_snake_case(name, expected):
    assert text.snake_case(name) == expected


def test_replace_params():
    @dataclasses.dataclass
    class Params:
        value: str

    assert text.replace_params("a ${value} b", Params("x")) == "a x b"
    assert text.replace_params("a ${value} b", {"value": 1}) == "a 1 b"
    assert text.replace_params("a ${other} b") == "a ${other} b"
    with pytest.raises(KeyError):
        text.replace_params("a ${other} b", {"value": 1})


def test_small_helpers():
    assert text.trimmed(None) is None and text.trimmed(" \n") is None and text.trimmed(" a  b ") == "a  b"
    assert text.sql_list(["foo", "bar"]) == '("foo","bar")' and text.sql_list([]) == "()"
    assert text.word_characters("foo -:? bar") == "foo_____bar" and text.word_characters("foo =^_^= bar", collapse=True) == "foo_bar"
    assert text.without_line_comments("foo\nbar # meh\nbaz", "#") == "foo\nbar \nbaz"
    assert text.sql_literal("a'b\\") == "'a\\'b\\\\'"


def test_split_statements_respects_literals_and_comments():
    assert text.split_statements("SELECT ';' AS a; -- x; y\nSELECT `b;c`;/* ; */") == ["SELECT ';' AS a", "-- x; y\nSELECT `b;c`"]
    assert text.split_statements("") == [] and text.split_statements(" -- only a comment") == []
