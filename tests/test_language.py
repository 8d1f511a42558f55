"""Expressions compiled to Columns, and commands in sessions."""

import pytest

from canopy.functions.compiler import SyntaxProblem, column
from canopy.operators import nodes
from canopy.operators.session import Session, run

EXPRESSIONS = [
    ("2+3*4", "20"), ("7\\2", "3"), ("-7\\2", "-3"), ("-7#2", "1"), ("2**3**2", "64"), ("-2**2", "4"), ('7-"xyz"', "7"), ('10-"7abc"', "3"), ('5>"10"', "0"), ('"007"=7', "1"), ('" 5"=5', "0"),
    ('"5x">"10"', "1"), ('"A"<"a"', "1"), ("'0", "1"), ('"123"?3N', "1"), ('"12A"?3N', "0"), ('"Abc"?1U2L', "1"), ('$ASCII("ABC",3)', "67"), ('$A("")', "-1"), ('$E("ABCDE",2,4)', "BCD"),
    ('$L("a,b,,c",",")', "4"), ('$F("ABCDE","CD")', "5"), ('$P("a,b,c",",",2,3)', "b,c"), ("$J(3.146,0,2)", "3.15"), ('$TR("ABC","BC","B")', "AB"), ('$S(0:"a",1:"b")', "b"),
    ('$CASE(2,1:"x",2:"y",:"z")', "y"), ("007", "7"), ("7.500", "7.5"), (".5", ".5"), ("1E2", "100"), ("-.25", "-.25"), ("0.0", "0"), ("1=1&(2>1)", "1"), ('"a""b"', 'a"b'), ("1'=2", "1"),
    ("5'<5", "1"), ('"abc"["b"', "1"), ('$NI_JSON("parse","[1, 2]")', "[1,2]"), ("--3", "3"), ('"A"?1"X"!1', "1"), ('$RE("abc")', "cba"),
]


def test_expressions(spark):
    row = spark.range(1).select(*[column(s).alias(f"c{i}") for i, (s, _) in enumerate(EXPRESSIONS)]).first()
    assert [(s, row[i]) for i, (s, _) in enumerate(EXPRESSIONS)] == EXPRESSIONS
    df = spark.createDataFrame([("a^b", 3)], "s string, n long")
    assert df.select(column('$P(s,"^",2)_n*2').alias("x")).first()["x"] == "0"
    for bad in ("1+", "$NOPE(1)", "(1", "1 2"):
        with pytest.raises(SyntaxProblem):
            column(bad)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("SET X=1,Y=2 WRITE X+Y", "3"),
        ("S (A,B)=5 W A,B,!", "55\n"),
        ('SET X="a^b" SET $P(X,"^",3)="c" WRITE X SET $E(X,1)="Z" WRITE X', "a^b^cZ^b^c"),
        ("FOR I=1:1:3 WRITE I", "123"),
        ("FOR I=3:-1:1,9 WRITE I", "3219"),
        ("SET I=0 FOR  SET I=I+1 QUIT:I>4  WRITE I", "1234"),
        ("IF 1=2 WRITE 1 ELSE  WRITE 2", "2"),
        ('IF 1 WRITE "y" ', "y"),
        ("WRITE:0 1 WRITE:1 2", "2"),
        ('SET ^D(1,2)="x" WRITE $D(^D(1)),$D(^D(1,2)),$D(^D(9)) SET ^D(1)=1 WRITE $D(^D(1))', "101011"),
        ('SET A(1)=1,A(3)=3,A("x")=4 WRITE $O(A("")),$O(A(1)),$O(A(3)),"/",$O(A("x"),-1),$O(A(""),-1)', "13x/3"),
        ('SET ^Q(1,2)="v" WRITE $Q(^Q(1))', "^Q(1,2)"),
        ("SET A(1)=1,A(2)=2 KILL A(1) WRITE $D(A(1)),$D(A(2))", "01"),
        ("SET A=1,B=2 KILL (A) WRITE $D(A),$D(B)", "10"),
        ("SET A(1)=1,B(2)=2 MERGE B=A WRITE B(1),B(2)", "12"),
        ("SET ^T=1 TSTART  SET ^T=2 WRITE ^T,$TL TROLLBACK  WRITE ^T,$TL", "2110"),
        ("TSTART  SET ^T=2 TCOMMIT  WRITE ^T", "2"),
        ('XECUTE "SET Z=4" WRITE Z', "4"),
        ('SET X="Y",Y=7 WRITE @X', "7"),
        ("SET N=5 WRITE $INCREMENT(N),N", "66"),
        ('WRITE $G(U,"d"),$G(U)', "d"),
        ('SET ^N(1,1)="a",^(2)="b" WRITE ^N(1,2)', "b"),
        ('LOCK +^A WRITE $D(^$LOCK("^A")) LOCK  WRITE $D(^$LOCK("^A"))', "10"),
        ('WRITE "ab",?5,"c"', "ab   c"),
        ("SET X=1 NEW X WRITE $D(X)", "0"),
        ("SET A(2)=1,A(10)=2 ZWRITE A", 'A(2)="1"\nA(10)="2"\n'),
    ],
)
def test_commands(spark, code, want):
    assert run(spark, code) == want


def test_routines_files_and_trees(spark, tmp_path):
    s = Session(spark)
    s.load('MAIN SET X=1\n DO SUB WRITE X\n QUIT\nSUB SET X=X+1\n QUIT:X>1\n WRITE "no"\n QUIT')
    assert s.run("DO MAIN") == "2"
    assert s.run(f'OPEN 1:("{tmp_path}/o":"WRITE") USE 1 WRITE "l1",!,"l2",! CLOSE 1') == ""
    assert s.run(f'OPEN 2:("{tmp_path}/o":"READ") USE 2 READ A,B,C CLOSE 2 WRITE A,B,$ZEOF') == "l1l21"
    s.attach(nodes.of_rows(spark, [("^BIG", ["2"], "b"), ("^BIG", ["10"], "c")]))
    assert s.run('WRITE ^BIG(2),$O(^BIG(2)),$D(^BIG)') == "b1010"
    s.run("SET ^A(1)=2")
    assert [tuple(r) for r in s.nodes().collect()] == [("^A", ["1"], "2")]
    s.special["ETRAP"] = 'WRITE "trapped"'
    assert s.run("WRITE $NOPE(1)") == "trapped" and s.special["ECODE"].startswith("M9999")


def test_attached_trees_are_asked_by_filters(spark):
    s = Session(spark)
    s.attach(nodes.of_rows(spark, [("^N", ["2"], "b"), ("^N", ["10"], "c"), ("^N", ["10", "x"], "d"), ("^N", ["k"], "e")]))
    assert s.run('WRITE $ORDER(^N("")),$ORDER(^N(2)),$ORDER(^N(10)),$ORDER(^N("k")),"/",$ORDER(^N("k"),-1),$ORDER(^N(2),-1)') == "210k/10"
    assert s.run('WRITE $DATA(^N(2)),$DATA(^N(10)),$DATA(^N(5)),$QUERY(^N(10)),$QUERY(^N("k"))') == '1110^N(10,"x")'


def test_loops_and_what_a_session_refuses(spark):
    assert run(spark, "FOR I=1:1:3000 SET X=I\nWRITE X") == "3000"
    for code in ("ZSYSTEM", "ZEDIT", "ZBREAK X", "WRITE $NI_NOPE(1)"):
        with pytest.raises(SyntaxProblem):
            run(spark, code)
    with pytest.raises(SyntaxProblem):
        column('$NI_SET("create","x")')
