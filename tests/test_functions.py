"""Golden values of the scalar library, evaluated in one projection for each group."""

import pytest
from pyspark.sql import functions as F

from canopy.functions import conditions as C
from canopy.functions import dates as D
from canopy.functions import maths as M
from canopy.functions import operators as O
from canopy.functions import patterns as P
from canopy.functions import strings as S
from canopy.functions import unicode as U
from canopy.functions import values as V

L = F.lit


def check(spark, cases):
    cols = [c[0].alias(f"c{i}") for i, c in enumerate(cases)]
    row = spark.range(1).select(*cols).first()
    assert [(i, row[i]) for i in range(len(cases))] == [(i, c[1]) for i, c in enumerate(cases)]


def test_values(spark):
    text = lambda s: V.number_text(V.numprefix(L(s)))
    numbers = {"007": "7", "7.500": "7.5", ".5": ".5", "1E2": "100", "-.25": "-.25", "0.0": "0", "3apples": "3", "2e3": "2", "": "0", "abc": "0", "+4": "4", "1E-5": ".00001", "5.": "5", "-0.5x": "-.5", "1E20": "100000000000000000000", "1E-30": "." + "0" * 29 + "1", "1.25E-7": ".000000125", "-12345678.5": "-12345678.5", "1E400": ""}
    check(spark, [(text(s), t) for s, t in numbers.items()])
    truths = {"": False, "0": False, "0.00": False, "abc": False, "3apples": True, "2e3": True, "-1": True}
    check(spark, [(V.truthy(L(s)), t) for s, t in truths.items()])
    wholes = {"007": 7.0, "7.0": 7.0, " 5": None, "5x": None, "1d": None, "NaN": None, "1e3": 1000.0, "5\n": None, "": None}
    check(spark, [(V.wholenum(L(s)), t) for s, t in wholes.items()])
    check(spark, [(V.is_canonical(L(s)), t) for s, t in {"042": True, " 4.5 ": True, "1e3": False, "x": False}.items()])
    check(spark, [(V.number_text(L(x)), t) for x, t in ((float("nan"), ""), (float("inf"), ""), (0.5, ".5"), (-0.0, "0"), (1234567.25, "1234567.25"))])


def test_collation(spark):
    subs = ["A", "10", "2", "", "-1", ".5", "1abc", "a", "1d", "NaN"]
    got = spark.createDataFrame([(s,) for s in subs], "s string").orderBy(V.collation(F.col("s")))
    assert [r["s"] for r in got.collect()] == ["", "-1", ".5", "2", "10", "1abc", "1d", "A", "NaN", "a"]
    paths = [["2", "x"], ["10"], ["2"], ["A"]]
    got = spark.createDataFrame([(p,) for p in paths], "p array<string>").orderBy(V.collation_key(F.col("p")))
    assert [r["p"] for r in got.collect()] == [["2"], ["2", "x"], ["10"], ["A"]]


def test_operators(spark):
    two = lambda f, a, b: f(L(a), L(b))
    cases = [
        (two(O.int_divide, "7", "2"), "3"), (two(O.int_divide, "-7", "2"), "-3"), (two(O.modulo, "-7", "2"), "1"), (two(O.modulo, "7", "-2"), "-1"), (two(O.subtract, "7", "xyz"), "7"),
        (two(O.subtract, "10", "7abc"), "3"), (two(O.divide, "5", "0"), "0"), (two(O.modulo, "5", "0"), "0"), (two(O.int_divide, "5", "0"), "0"), (O.power(O.power(L("2"), L("3")), L("2")), "64"),
        (two(O.greater, "5", "10"), "0"), (two(O.equal, "007", "7"), "1"), (two(O.equal, "7.0", "7"), "1"), (two(O.equal, " 5", "5"), "0"), (two(O.greater, "5x", "10"), "1"),
        (two(O.less, "A", "a"), "1"), (two(O.less, "9", "A"), "1"), (two(O.unequal, "a", "b"), "1"), (two(O.not_less, "2", "10"), "0"), (two(O.not_greater, "2", "10"), "1"),
        (two(O.follows, "B", "A"), "1"), (two(O.not_follows, "B", "A"), "0"), (two(O.contains, "hello", "ell"), "1"), (two(O.contains, "x", ""), "1"), (two(O.not_contains, "hello", "z"), "1"),
        (two(O.sorts_after, "10", "2"), "1"), (two(O.not_sorts_after, "A", "2"), "0"), (O.minus(L("3abc")), "-3"), (O.plus(L("007")), "7"), (O.negation(L("0")), "1"),
        (two(O.both, "1", "0x"), "0"), (two(O.either, "0", "2"), "1"), (O.concat(L("a"), L(None).cast("string")), "a"), (two(O.divide, "7", "2"), "3.5"), (two(O.multiply, "1.5", "-2"), "-3"),
    ]
    check(spark, cases)


@pytest.mark.parametrize(
    ("value", "pattern", "want"),
    [("123", "3N", "1"), ("12A", "3N", "0"), ("Abc", "1U2L", "1"), ("", ".N", "1"), ("abc", '1L1"b"1L', "1"), ("aab", '.L1"b"', "0"), ("a\n", "1L", "0"), ("1-X.", "1N1P1U1P", "1"), ("12345", "2.4N", "0"), ("123", "2.4N", "1"), ("ab1", "3AN", "1"), ('x"y', '1L1""""1L', "1"), ("a]^_", "1L3P", "1"), ("\x7f", "1C", "1"), ("aF9", "3H", "1"), ("é", "1E", "1")],
)
def test_patterns(spark, value, pattern, want):
    check(spark, [(P.matches(L(value), pattern), want), (P.not_matches(L(value), pattern), "10"[int(want)])])


def test_bad_pattern():
    with pytest.raises(ValueError):
        P.regex("3!")


def test_strings(spark):
    abc = L("ABCDE")
    cases = [
        (S.ascii_code(L("ABC"), 3), 67), (S.ascii_code(L("A"), 2), -1), (S.ascii_code(L("")), -1), (S.char(65, 66), "AB"),
        (S.extract(abc, 3), "C"), (S.extract(abc, 2, 4), "BCD"), (S.extract(L("ABC"), 2, 99), "BC"), (S.extract(L("ABC"), 3, 2), ""), (S.extract(L("ABC"), -3, 2), "AB"), (S.extract(L("ABC"), 0), ""),
        (S.find(abc, "CD"), 5), (S.find(abc, "X"), 0), (S.find(L("ABCDEF"), "", 4), 4), (S.find(L("ABAB"), "AB", 2), 5),
        (S.justify(L("42"), 6), "    42"), (S.justify(L("3.146"), 0, 2), "3.15"), (S.justify(L("zz9"), 9, 1), "      0.0"), (S.justify(L("toolong"), 3), "toolong"), (S.justify(L("-0.01"), 0, 1), "0.0"),
        (S.length(L("a,b,,c"), ","), 4), (S.length(L(""), ","), 1), (S.length(L("héé")), 3), (S.length(L("a.b"), "."), 2),
        (S.piece(L("a,b,c"), ",", 2, 3), "b,c"), (S.piece(L("abc"), "x"), "abc"), (S.piece(L("a,,c"), ",", 2), ""), (S.piece(L("a::b::c"), "::", 3), "c"), (S.piece(L("a,b"), ",", 5), ""), (S.piece(L("ab"), ""), "ab"),
        (S.set_piece(L("a,b"), ",", 4, L("x")), "a,b,,x"), (S.set_piece(L(""), ",", 2, L("x")), ",x"), (S.set_extract(L("ABCDE"), 2, L("--"), 3), "A--DE"),
        (S.reverse(L("café")), "éfac"), (S.translate(L("ABC"), "BC", "B"), "AB"), (S.fnumber(L("1234567.891"), ",", 2), "1,234,567.89"), (S.fnumber(L("-5"), "P"), "(5)"), (S.fnumber(L("5"), "+"), "+5"),
        (S.convert(L("aé"), "U"), "Aé"), (S.width(L("é")), 2), (S.strip(L("  x "), "<"), "x "), (S.strip(L("xxaxx"), "*", "x"), "a"), (S.substr(L("abcdef"), 3, 2), "cd"), (S.substr(L("abc"), 0), ""),
        (S.qlength(L('^G(1,"a,b",3)')), 3), (S.qlength(L("^G")), 0), (S.qsubscript(L('^G(1,"a,b",3)'), 2), "a,b"), (S.qsubscript(L("^G(1)"), 0), "^G"), (S.qsubscript(L("^G(1)"), 5), ""),
        (S.reference(L("^G"), F.array(L("1"), L('a"b'))), '^G(1,"a""b")'), (S.reference(L("^G"), F.array().cast("array<string>")), "^G"),
    ]
    check(spark, cases)


def test_maths_dates_conditions_unicode(spark):
    cases = [
        (M.zabs(L("-3.5")), "3.5"), (M.sqrt(L("16")), "4"), (M.sqrt(L("-1")), ""), (M.ln(L("0")), ""), (M.exp(L("0")), "1"), (M.power(L("2"), L("10")), "1024"), (M.zabs(L("x")), "0"),
        (M.bit(L("5"), 0), 1), (M.bit(L("5"), 1), 0), (M.bit(L("5"), 99), 0), (M.random(L(0)), 0), (M.cos(L("0")), "1"), (M.arctan(L("0")), "0"),
        (D.horolog(L("2026-08-21 01:00:05").cast("timestamp")), "67803,3605"), (D.zdate(L("67803,3605")), "2026-08-21"), (D.ztime(L("67803,3605")), "01:00:05"),
        (D.zdatetime(L("67803,3605"), "DD.MM.YYYY at 12:MI AM"), "21.08.2026 at 01:00 AM"), (D.zdatetime(L("0,0")), "1840-12-31 00:00:00"),
        (C.select((L("0"), L("a")), (L("1"), L("b"))), "b"), (C.select((L("0"), L("a"))), ""), (C.case(L("2"), ("1", "x"), ("2", "y")), "y"), (C.case(L("3"), ("1", "x"), default="z"), "z"),
        (C.get(L(""), "d"), "d"), (C.get(L("v"), "d"), "v"), (C.json_parse(L('{ "a": [1, 2] }')), '{"a":[1,2]}'), (C.json_parse(L("{")), ""), (C.json_stringify(L("he")), '"he"'), (C.json_stringify(L("[1]")), "[1]"),
        (U.count(L("né")), 2), (U.char_bytes(L("日本")), 3), (U.slice_of(L("héllo"), 1, 2), "él"), (U.reverse(L("né")), "én"), (U.upper(L("né")), "Né"), (U.is_alpha(L("né")), True), (U.is_alpha(L("n1")), False),
        (U.is_digit(L("12")), True), (U.is_alnum(L("a1é")), True), (U.code_point(L("日"), 0), 26085), (U.code_point(L("日"), 1), -1), (U.from_code_point(L(128578)), "🙂"), (U.is_valid(L("x")), True),
    ]
    check(spark, cases)
    with pytest.raises(ValueError):
        U.slice_of(L("x"), -1, 2)


def test_unicode_of_long_words_and_empty_texts(spark):
    long = F.repeat(F.concat(L("aé"), F.left(F.col("id").cast("string"), L(0))), L(100_000))
    cases = [
        (U.is_alpha(long), True), (U.is_alnum(F.concat(long, L("7😀"))), True), (U.is_alpha(F.concat(long, L("-"))), False), (U.is_digit(F.repeat(L("7"), L(200_000))), True), (U.is_alpha(L("a\x7f")), False), (U.is_alpha(L("a\x80")), True),
        (U.from_code_point(U.code_point(L(""), 0)), ""), (U.from_code_point(L(0x1F600)), "😀"), (U.from_code_point(L(0)), "\x00"), (U.from_code_point(L(0xD800)), ""), (U.from_code_point(L(0x110000)), ""),
    ]
    check(spark, cases)


def test_decimals_round_the_exact_value(spark):
    values = [-0.0, -0.001, 0.125, 1.005, 2.675, 99999.995, -1.005, 4516.95]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(S.justify(F.col("v"), 0, 2, signed=True).alias("a"), S.fnumber(F.col("v").cast("string"), ",", 2).alias("b"), S.fnumber(F.col("v").cast("string"), "P,", 2).alias("c"))
    shown = [f"{abs(v):,.2f}" for v in values]
    assert [tuple(r) for r in df.collect()] == [(f"{v:.2f}", ("-" if v < 0 else "") + s, f"({s})" if v < 0 else f"{v:,.2f}") for v, s in zip(values, shown, strict=True)]
    check(spark, [(S.justify(L("-0.01"), 8, 1), "     0.0"), (S.justify(L("1e30"), 0, 2), "1.00"), (S.justify(L("2.5"), 0, 0), "2")])
