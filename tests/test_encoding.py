"""Templated commands against an exhaustive reading, and the spelling of numbers and fields."""

import itertools

from pyspark.sql import functions as F

from lodequery.functions import spelling
from lodequery.operators import encoding


def readings(phrase):
    found = set()
    for other, size, colour, category in itertools.product((False, True), (None, *encoding.SIZES), (None, *encoding.COLOURS), encoding.CATEGORIES):
        if phrase == " ".join(w for w in ("other" if other else None, size, colour, category) if w):
            found.add((other, size, colour, category))
    return found


def every_reading(text):
    found = set()
    if not text.startswith("the "):
        return found
    body = text[4:]
    for wrapper, at in itertools.product(encoding.WRAPPERS, range(len(body))):
        if not body.startswith(wrapper, at):
            continue
        rest = body[at + len(wrapper) :]
        for target, (alias, (relation, k)) in itertools.product(readings(body[:at]), encoding.ALIASES.items()):
            tail = rest[len(alias) + 1 :]
            if not rest.startswith(alias + " "):
                continue
            if relation == "between" and tail.startswith(encoding.BOTH) and tail != encoding.BOTH:
                found.add((target, relation, k, (), True))
            if not tail.startswith("the "):
                continue
            if relation != "between":
                found |= {(target, relation, k, (a,), False) for a in readings(tail[4:])}
                continue
            for cut in range(4, len(tail)):
                if tail.startswith(" and the ", cut):
                    found |= {(target, relation, k, (a, b), False) for a in readings(tail[4:cut]) for b in readings(tail[cut + 9 :])}
    return found


def expected(text):
    found = every_reading(text)
    if len(found) != 1:
        return "unsupported", "ambiguous_parse" if found else "unrecognized_text", len(found), None, None
    ((target, relation, k, anchors, plural),) = found
    phrases = (target, *anchors)
    reason = "plural_reference" if plural else "coreference" if any(p[0] for p in phrases) else "size_comparison" if any(p[1] for p in phrases) else None
    return ("parsed", None, 1, relation, k) if reason is None else ("unsupported", reason, 1, None, None)


def test_commands(spark, sf_dir):
    odd = ["", "the ", "a chair", "the chair that is between both of the ", "the chair that is between both of the lamps", "the chair that is on the table that is on the box", "the big red chair that is near the table", "the chair that is between the box and the lamp and the table", "the lamp that are in between the box and the other lamp"]
    texts = encoding.command_texts(spark, sf_dir).select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    rows = encoding.commands(texts, encoding.phrases(spark, encoding.CATEGORIES, encoding.COLOURS)).collect()
    assert {r.text: (r.status, r.reason, r.analyses, r.relation, r.k) for r in rows} == {r.text: expected(r.text) for r in rows}
    assert {r.reason for r in rows} >= {None, "unrecognized_text", "plural_reference", "coreference", "size_comparison"}


def test_two_readings_are_ambiguous(spark):
    vocabulary = spark.createDataFrame([("chair", False, None, None, "chair"), ("chair", False, None, "chair", ""), ("table", False, None, None, "table")], "phrase string, other boolean, size string, colour string, category string")
    row = encoding.commands(spark.createDataFrame([("the chair that is on the table",)], "text string"), vocabulary).first()
    assert (row.status, row.reason, row.analyses, row.relation) == ("unsupported", "ambiguous_parse", 2, None)


def test_number_spelling():
    cases = {0.0: "0", 1.0: "1", 0.1: "0.1", 1e-7: "1e-07", 1e23: str(int(1e23)), -2.5: "-2.5", float("nan"): None, float("inf"): None}
    assert [spelling.spelled_number(k) for k in cases] == list(cases.values())
    assert spelling.spelled_number(-0.0) == "0"


def test_canonical_records_and_fields(spark):
    df = spark.createDataFrame([('é"x', 2.0, None), (None, None, 3)], "b string, a double, c int")
    assert [r[0] for r in df.select(spelling.canonical({"b": "text", "a": "double", "c": "other"})).collect()] == ['{"a":2,"b":"é\\"x","c":null}', '{"a":null,"b":null,"c":3}']
    texts = spark.createDataFrame([("a=1 b=2 a=3",), ("none",), (None,)], "t string")
    assert [r[0] for r in texts.select(spelling.field_map(F.col("t"), "([a-z])=([0-9])")).collect()] == [{"b": "2", "a": "3"}, {}, None]
    arrays = spark.createDataFrame([([1, 2, 3], [1, 2]), ([], [1]), ([1, None], [1, None, 4]), ([5], [6]), (None, [1])], "a array<int>, b array<int>")
    assert [r[0] for r in arrays.select(spelling.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 0, None]
