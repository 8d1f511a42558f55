"""Queries over what runs on the driver: command sessions, routines, collections by id, files, stores and tools.

Each query runs its cases, (name, commands, what they write), and returns a row for each; the SQL holds what the
language asks them to write.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint, nodes, tools
from ..operators.session import Session
from ..sources import loaders
from .catalogue import ORACLES, QUERIES, query, table, tree

Case = tuple[str, str, str]


def quoted(s: str) -> str:
    """A text as an SQL expression."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def values_sql(rows: Iterable[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows) + ') AS t("case", output)'


def outputs(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "case string, output string")


def group(name: str, cases: list[Case], routine: str = "") -> None:
    """Registers a group of cases, each run in a session of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def one(code: str) -> str:
            session = Session(spark)
            if routine:
                session.load(routine, "MAIN")
            return session.run(code)

        return outputs(spark, [(c, one(code)) for c, code, _ in cases])

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = values_sql((c, want) for c, _, want in cases)


# What each case must write is fixed by the language.

group("session_literals", [
    ("integer", "WRITE 007", "7"), ("decimal", "WRITE 7.500", "7.5"), ("fraction", "WRITE .5,\" \",-.25", ".5 -.25"), ("exponent", "WRITE 1E2,\" \",1E-20*1", "100 .00000000000000000001"),
    ("string", 'WRITE "say ""hi"""', 'say "hi"'), ("variable", "SET X=4 WRITE X", "4"), ("subscripted", 'SET X(1,"b")=6 WRITE X(1,"b")', "6"),
    ("naked", 'SET ^N(1,1)="a",^(2)="b" WRITE ^N(1,2)', "b"), ("special", "WRITE $TEST", "1"), ("left_to_right", "WRITE 2+3*4", "20"), ("unary", "WRITE -2**2,\" \",--3", "4 3"),
    ("indirection", 'SET X="Y",Y=7 WRITE @X', "7"), ("indirect_subscript", 'SET A(3)="c",X="A(3)" WRITE @X', "c"), ("undefined", "WRITE U", ""),
    ("pattern", 'WRITE "12-ab"?2N1"-"2L,"12"?3N', "10"), ("follows", 'WRITE "b"]"a",2]10,2]]10', "110"),
])

group("session_variables", [
    ("get_local", 'SET A="x" WRITE $GET(A),$GET(B,"none")', "xnone"), ("kill_local", "SET A=1,B=2 KILL A WRITE $DATA(A),$DATA(B)", "01"), ("kill_subtree", "SET A(1)=1,A(1,2)=2,A(2)=3 KILL A(1) WRITE $DATA(A(1)),$DATA(A(2))", "01"),
    ("kill_all", "SET A=1,B=2 KILL  WRITE $DATA(A),$DATA(B)", "00"), ("kill_except", "SET A=1,B=2 KILL (A) WRITE $DATA(A),$DATA(B)", "10"), ("kill_one_node", "SET A(1)=1,A(1,2)=2 ZKILL A(1) WRITE $DATA(A(1))", "10"),
    ("data_local", "SET A(1,2)=1 WRITE $DATA(A),$DATA(A(1)),$DATA(A(1,2)) SET A(1)=5 WRITE $DATA(A(1))", "1010111"),
    ("order_local", 'SET A(10)=1,A(9)=1,A("x")=1,A(-1)=1 SET S="" FOR  SET S=$ORDER(A(S)) QUIT:S=""  WRITE S,";"', "-1;9;10;x;"),
    ("order_back", 'SET A(1)=1,A(3)=1 WRITE $ORDER(A(9),-1),$ZPREVIOUS(A(3)),"/",$ORDER(A(""),-1)', "31/"), ("order_between", "SET A(1)=1,A(3)=1 WRITE $ORDER(A(2)),$ZORDER(A(1)),$ZO(A(0))", "331"),
    ("query_local", 'SET A(1)=1,A(1,2)=2,A("k")=3 WRITE $QUERY(A(1)),$QUERY(A(1,2)),"/",$QUERY(A("k"))', 'A(1,2)A("k")/'), ("query_global", 'SET ^Q(1,2)="v" WRITE $QUERY(^Q(1))', "^Q(1,2)"),
    ("new", "SET X=1 NEW X WRITE $DATA(X)", "0"), ("new_except", "SET A=1,B=2 NEW (A) WRITE $DATA(A),$DATA(B)", "10"), ("new_ends", 'SET X=1 XECUTE "NEW X SET X=2 WRITE X" WRITE X', "21"),
    ("merge", 'SET A(1)=1,A(2)=2,B(9)=9 MERGE B=A WRITE B(1),B(2),B(9)', "129"), ("set_many", "SET (A,B)=5 WRITE A,B", "55"), ("set_piece", 'SET X="a^b" SET $PIECE(X,"^",4)="d" WRITE X', "a^b^^d"),
    ("set_extract", 'SET X="abc" SET $EXTRACT(X,2)="--" WRITE X', "a--c"), ("increment", "SET N=5 WRITE $INCREMENT(N),$INCREMENT(N,-2),N", "644"), ("name", 'WRITE $NAME(A(1,"x"))', 'A(1,"x")'),
    ("lock", 'LOCK +^A WRITE $DATA(^$LOCK("^A")) LOCK -^A WRITE $DATA(^$LOCK("^A"))', "10"), ("lock_replaces", 'LOCK ^A LOCK ^B WRITE $DATA(^$LOCK("^A")),$DATA(^$LOCK("^B"))', "01"), ("lock_clears", 'LOCK ^A LOCK  WRITE $DATA(^$LOCK("^A"))', "0"),
    ("job_known", 'WRITE $DATA(^$JOB(1)),$DATA(^$JOB(77))', "10"),
])

group("session_control", [
    ("if", 'IF 1 WRITE "y"', "y"), ("if_not", 'IF 0 WRITE "y"', ""), ("if_both", 'IF 1,0 WRITE "y"', ""), ("else", "IF 1=2 WRITE 1 ELSE  WRITE 2", "2"), ("test", "IF 0 WRITE 1\nWRITE $TEST", "0"),
    ("condition", "WRITE:0 1 WRITE:1 2", "2"), ("for_range", "FOR I=1:1:3 WRITE I", "123"), ("for_down", "FOR I=3:-1:1,9 WRITE I", "3219"), ("for_step", "FOR I=0:.5:1 WRITE I,\";\"", "0;.5;1;"),
    ("for_open", "SET I=0 FOR  SET I=I+1 QUIT:I>4  WRITE I", "1234"), ("for_list", 'FOR X="a","b" WRITE X', "ab"), ("for_nested", "FOR I=1:1:2 FOR J=1:1:2 WRITE I,J,\" \"", "11 12 21 22 "),
    ("xecute", 'XECUTE "SET Z=4" WRITE Z', "4"), ("halt", "WRITE 1 HALT  WRITE 2", "1"), ("hang", "HANG 0 WRITE 1", "1"), ("sleep", 'WRITE "<",$NI_SLEEP(0),">"', "<>"), ("break", "BREAK  WRITE 1", "BREAK\n1"),
    ("quiet_words", "VIEW 1 ZALLOCATE X YOPEN 1 WRITE 1", "1"), ("comment", "WRITE 1 ; WRITE 2", "1"),
])

group("session_special", [
    ("test", "WRITE $TEST,$T", "11"), ("x_y", 'WRITE "ab",!,"c",$X,$Y', "ab\nc11"), ("job", "WRITE $JOB,$J", "11"), ("io", "WRITE $IO,$PRINCIPAL", "00"), ("levels", "WRITE $TLEVEL,$TRESTART,$STACK,$ESTACK", "0000"),
    ("stack_inside", 'XECUTE "WRITE $STACK,$STACK(0)" WRITE $ST', "110"), ("empty", 'WRITE "<",$DEVICE,$KEY,$REFERENCE,$ECODE,$ETRAP,$ZERROR,$ZSTATUS,$ZTRAP,$ZEOF,$QUIT,">"', "<>"), ("storage", "WRITE $STORAGE>0", "1"),
    ("system", 'WRITE $SYSTEM\'="",$ZVERSION\'=""', "11"), ("horolog", 'WRITE $HOROLOG?1.N1","1.N,$H?1.N1","1.N,$ZHOROLOG?1.N1","1.N', "111"), ("set_trap", 'SET $ETRAP="WRITE 9" WRITE $ETRAP', "WRITE 9"),
    ("random", "SET R=$RANDOM(10) WRITE R'<0,R<10,$RANDOM(0)", "110"), ("uuid", 'WRITE $LENGTH($NI_UUID),$EXTRACT($NI_UUID,15)', "364"), ("tab", 'WRITE "ab",?5,"c"', "ab   c"), ("form", "WRITE #,1", "\f1"),
])

group("session_transactions", [
    ("commit", "TSTART  SET ^T=2 TCOMMIT  WRITE ^T", "2"), ("rollback", "SET ^T=1 TSTART  SET ^T=2 WRITE ^T,$TLEVEL TROLLBACK  WRITE ^T,$TLEVEL", "2110"), ("levels", "WRITE $TLEVEL TSTART  WRITE $TLEVEL TSTART  WRITE $TLEVEL TCOMMIT  WRITE $TLEVEL TCOMMIT  WRITE $TLEVEL", "01210"),
    ("nested_rollback", "TSTART  SET ^T=1 TSTART  SET ^T=2 TROLLBACK  WRITE $TLEVEL,^T TCOMMIT  WRITE ^T", "111"), ("own_writes", 'TSTART  SET ^T(1)="a" WRITE $DATA(^T(1)) TROLLBACK  WRITE $DATA(^T(1))', "10"),
    ("kill_undone", "SET ^T(1)=5 TSTART  KILL ^T WRITE $DATA(^T) TROLLBACK  WRITE ^T(1)", "05"), ("locals_stay", "SET A=1 TSTART  SET A=2 TROLLBACK  WRITE A", "2"),
])

_ROUTINE = 'MAIN WRITE "main"\n QUIT\nADD SET R=A+B\n QUIT\nLOOP FOR I=1:1:2 DO SHOW\n QUIT\nSHOW WRITE I,";"\n QUIT\nSKIP GOTO END\n WRITE "never"\nEND WRITE "end"'

group("session_routines", [
    ("do_label", "SET A=2,B=3 DO ADD WRITE R", "5"), ("do_first", "DO MAIN", "main"), ("do_routine", "DO ADD^MAIN WRITE R", "0"), ("nested", "DO LOOP", "1;2;"), ("goto", "DO SKIP", "end"), ("offset", "DO SKIP+1", "neverend"),
    ("text_first", "WRITE $TEXT(MAIN)", 'MAIN WRITE "main"'), ("text_offset", "WRITE $TEXT(ADD+1)", " QUIT"), ("text_elsewhere", "WRITE $T(END^MAIN)", 'END WRITE "end"'), ("text_value", 'SET X="SHOW" WRITE $TEXT(@X)', 'SHOW WRITE I,";"'), ("text_none", 'WRITE "<",$TEXT(NOPE),">"', "<>"),
    ("print", "ZPRINT END", 'END WRITE "end"\n'), ("remove", "ZREMOVE MAIN WRITE $TEXT(ADD)", ""), ("message", "ZMESSAGE 150", "150"), ("zwrite", 'SET A(2)=1,A(10)="q""" ZWRITE A', 'A(2)="1"\nA(10)="q"""\n'),
    ("trap", 'ZTRAP "WRITE ""caught""" WRITE $NOPE(1)', "caught"), ("trap_rolls_back", 'SET ^T=1,$ETRAP="WRITE ^T" TSTART  SET ^T=2 WRITE $NOPE(1)', "1"), ("job", "SET ^A=1 JOB ADD WRITE $DATA(R),^A", "01"),
], _ROUTINE)

group("session_collections", [
    ("array", 'SET X=$NI_ARRAY("create","a") WRITE $NI_ARRAY("add","a","p"),$NI_ARRAY("add","a","q"),$NI_ARRAY("get","a",1),$NI_ARRAY("set","a",0,"z"),$NI_ARRAY("get","a",0),$NI_ARRAY("set","a",9,"z"),$NI_ARRAY("get","a",9),$NI_ARRAY("len","a")', "12q1z02"),
    ("array_ends", 'SET X=$NI_ARRAY("create","a") SET X=$NI_ARRAY("add","a",1) WRITE $NI_ARRAY("clear","a"),$NI_ARRAY("len","a"),$NI_ARRAY("destroy","a"),$NI_ARRAY("destroy","a"),$NI_ARRAY("add","a",1),$NI_ARRAY("len","a")', "10100"),
    ("object", 'SET X=$NI_OBJECT("create","o") WRITE $NI_OBJECT("set","o","k","v"),$NI_OBJECT("get","o","k"),$NI_OBJECT("has","o","k"),$NI_OBJECT("has","o","x"),$NI_OBJECT("del","o","k"),$NI_OBJECT("len","o")', "1v1010"),
    ("stack", 'SET X=$NI_STACK("create","s") WRITE $NI_STACK("push","s","a"),$NI_STACK("push","s","b"),$NI_STACK("pop","s"),$NI_STACK("peek","s"),$NI_STACK("len","s"),$NI_STACK("pop","s"),"<",$NI_STACK("pop","s"),">"', "12ba1a<>"),
    ("queue", 'SET X=$NI_QUEUE("create","q") WRITE $NI_QUEUE("enqueue","q","a"),$NI_QUEUE("push","q","b"),$NI_QUEUE("dequeue","q"),$NI_QUEUE("peek","q"),$NI_QUEUE("pop","q"),$NI_QUEUE("len","q")', "12abb0"),
    ("set", 'SET X=$NI_SET("create","t") WRITE $NI_SET("add","t","a"),$NI_SET("add","t","a"),$NI_SET("add","t","b"),$NI_SET("has","t","a"),$NI_SET("contains","t","z"),$NI_SET("remove","t","a"),$NI_SET("len","t")', "1121011"),
    ("map", 'SET X=$NI_MAP("create","m") SET Y=$NI_MAP("set","m","k2","v2"),Z=$NI_MAP("set","m","k1","v1") WRITE $NI_MAP("get","m","k2"),$NI_MAP("has","m","k1"),$NI_MAP("keys","m"),"/",$NI_MAP("values","m"),$NI_MAP("del","m","k1"),$NI_MAP("len","m")', "v21k1,k2/v1,v211"),
    ("sorted", 'SET X=$NI_SORTED("create","d") SET A=$NI_SORTED("add","d","9"),B=$NI_SORTED("add","d","10"),C=$NI_SORTED("add","d","9") WRITE $NI_SORTED("toseq","d"),$NI_SORTED("has","d","10"),$NI_SORTED("del","d","10"),$NI_SORTED("len","d")', "10,9111"),
    ("deque", 'SET X=$NI_DEQUE("create","e") WRITE $NI_DEQUE("addfirst","e","f"),$NI_DEQUE("addlast","e","b"),$NI_DEQUE("pushfirst","e","g"),$NI_DEQUE("peekfirst","e"),$NI_DEQUE("peeklast","e"),$NI_DEQUE("popfirst","e"),$NI_DEQUE("poplast","e"),$NI_DEQUE("len","e")', "123gbgb1"),
    ("bag", 'SET X=$NI_BAG("create","g") WRITE $NI_BAG("add","g","x"),$NI_BAG("add","g","x"),$NI_BAG("add","g","y"),$NI_BAG("count","g","x"),$NI_BAG("del","g","x"),$NI_BAG("count","g","x"),$NI_BAG("len","g")', "1212112"),
    ("missing", 'WRITE "<",$NI_MAP("get","no","k"),$NI_MAP("has","no","k"),$NI_STACK("pop","no"),$NI_BAG("nope","no"),">"', "<0>"),
    ("json", 'WRITE $NI_JSON("parse","[1, 2]"),$NI_JSON("stringify","hello")', '[1,2]"hello"'),
])


# --- files, stores, keys, tools: what they give is stated row by row ---------------------------------------------------


def written(spark: SparkSession, name: str, lines: list[str]) -> str:
    """A text file in the folder for intermediate tables."""
    sc = spark.sparkContext
    folder = (sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{folder}/canopy-files/{name}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def shown(df: DataFrame) -> list[tuple[str, str]]:
    """Nodes as references and values."""
    return [(r["ref"], r["value"]) for r in nodes.walk(df).select("ref", "value").collect()]


def rows_query(name: str, want: list[tuple[str, str]]):
    """Registers a function that returns (case, output) rows, with the rows that it must return."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return outputs(spark, f(spark))

        run.__name__ = name
        QUERIES[name] = run
        ORACLES[name] = values_sql(want)
        return f

    return add


@rows_query("load_csv", [("^DATA(2,0)", "a"), ("^DATA(2,1)", "1"), ("^DATA(3,0)", "b"), ("^DATA(3,1)", "")])
def load_csv(spark):
    return shown(loaders.csv(spark, written(spark, "csv", ["name,n", "a , 1", "b,"])))


@rows_query("load_json", [("^DATA(0)", "x"), ("^DATA(1,\"k\")", "v"), ("^DATA(1,\"n\")", "")])
def load_json(spark):
    return shown(loaders.json(spark, written(spark, "json", ['["x", {"k": "v", "n": 3}]'])))


@rows_query("load_text", [("^TEXT", "one\ntwo\n")])
def load_text(spark):
    return shown(loaders.text(spark, written(spark, "text", ["one", "two"])))


@rows_query("load_directory", [("files", "1"), ("value", "in a folder\n")])
def load_directory(spark):
    rows = loaders.directory(spark, written(spark, "folder", ["in a folder"])).collect()
    return [("files", str(len(rows))), ("value", rows[0]["value"])]


@rows_query("load_delimited", [("cat", "animal"), ("oak", 'a "tree"')])
def load_delimited(spark):
    df = loaders.delimited(spark, written(spark, "delimited", ["term|broader", "cat|animal", 'oak|a "tree"']))
    return [(r["term"], r["broader"]) for r in df.collect()]


@rows_query("file_lines", [("1", "first"), ("2", "second")])
def file_lines(spark):
    session = Session(spark)
    path = written(spark, "lines", ["first", "second"])
    session.run(f'OPEN 1:("{path}":"READ") USE 1 READ A READ B USE 0 CLOSE 1')
    return [("1", session.value("A", ())), ("2", session.value("B", ()))]


@rows_query("file_writes", [("back", "one,two"), ("channel", "0"), ("appended", "one,three,two")])
def file_writes(spark):
    session = Session(spark)
    path = written(spark, "writes", [""])
    session.run(f'OPEN 2:("{path}":"WRITE") USE 2 WRITE "one",!,"two" CLOSE 2')
    read = lambda: ",".join(sorted(r["line"] for r in loaders.lines(spark, path).collect()))
    back = read()
    session.run(f'OPEN 2:("{path}":"APPEND") USE 2 WRITE "three" CLOSE 2')
    return [("back", back), ("channel", session.special["IO"]), ("appended", read())]


@rows_query("routine_files", [("linked", "5"), ("print", "SUM WRITE 2+3\n"), ("saved", "SUM WRITE 2+3"), ("removed", "")])
def routine_files(spark):
    session = Session(spark)
    path = written(spark, "SUM", ["SUM WRITE 2+3"])
    out = [("linked", session.run(f'ZLINK "{path}" DO SUM')), ("print", session.run("ZPRINT SUM"))]
    session.run(f'ZSAVE "{path}-saved"')
    out.append(("saved", Session(spark).run(f'ZLOAD "{path}-saved" WRITE $TEXT(SUM^SUM)') or Session(spark).run(f'ZLOAD "{path}-saved" WRITE $TEXT(SUM)')))
    return [*out, ("removed", session.run("ZREMOVE SUM WRITE $TEXT(SUM^SUM)"))]


@rows_query("key_codec", [("hex", "5E470031006200"), ("name", "^G"), ("subs", "1/b")])
def key_codec(spark):
    key = loaders.encoded_key(F.lit("^G"), F.array(F.lit("1"), F.lit("b")))
    back = loaders.decoded_key(key)
    r = spark.range(1).select(F.hex(key.cast("binary")).alias("hex"), F.get(back, F.lit(0)).alias("name"), F.array_join(F.slice(back, 2, 9), "/").alias("subs")).first()
    return [(c, r[c]) for c in ("hex", "name", "subs")]


@rows_query("store", [("get", "a"), ("overwritten", "b"), ("missing", ""), ("deleted", ""), ("names", "^A,^B"), ("prefixed", "^B"), ("synced", "^A(1)=b ^B=z")])
def store(spark):
    s = loaders.Store(nodes.of_rows(spark, [("^A", ["1"], "a"), ("^A", ["2"], "x")]))
    out = [("get", s.get("^A", "1"))]
    s.batch_put([("^A", ["1"], "b"), ("^B", [], "z")])
    out += [("overwritten", s.get("^A", "1")), ("missing", s.get("^A", "9"))]
    s.batch_delete([("^A", ["2"]), ("^Q", ["1"])])
    out += [("deleted", s.get("^A", "2")), ("names", ",".join(s.names())), ("prefixed", ",".join(s.names("^B")))]
    path = written(spark, "store", [""]) + "-tree"
    s.sync(path)
    return [*out, ("synced", " ".join(f"{a}={b}" for a, b in shown(loaders.load(spark, path))))]



@rows_query("lint_findings", [("W001", "1"), ("W002", "4"), ("W003", "1")])
def lint_findings(spark):
    lines = lint.lines_of(spark, "R", "MAIN SET A=1\n SET B=2\n WRITE A\n QUIT\n WRITE 9\nLAST DO NOPE\n QUIT")
    found = lint.report(lines).groupBy("code").agg(F.min("line_no").alias("at"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["code"]: r for r in found}
    return [("W001", str(by["W001"]["n"])), ("W002", str(by["W002"]["at"] - 1)), ("W003", str(by["W003"]["n"]))]


@rows_query("tool_server", [("initialize", "canopy"), ("list", "twice"), ("call", "8"), ("unknown", "-32601"), ("parse", "-32700"), ("invalid", "-32600")])
def tool_server(spark):
    server = tools.Tools()
    server.register("twice", lambda n: 2 * n, "doubles")
    ask = lambda **x: json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 1, **x})))
    return [
        ("initialize", ask(method="initialize")["result"]["serverInfo"]["name"]), ("list", ask(method="tools/list")["result"]["tools"][0]["name"]),
        ("call", ask(method="tools/call", params={"name": "twice", "arguments": {"n": 4}})["result"]["content"][0]["text"]), ("unknown", str(ask(method="nope")["error"]["code"])),
        ("parse", str(json.loads(server.answer("{"))["error"]["code"])), ("invalid", str(json.loads(server.answer("[]"))["error"]["code"])),
    ]


@rows_query("inspection", [("defined", 'A("1")="x"'), ("undefined", "B UNDEFINED"), ("loop", '6\nX="5"\n'), ("job", "5"), ("running", "0"), ("history", "3,4")])
def inspection(spark):
    session, out, jobs = Session(spark), [], tools.Jobs(spark)
    session.run('SET A(1)="x"')
    tools.loop(spark, iter(["SET X=5", "WRITE X+1,!", "/vars", "/quit"]), out.append)
    kept = tools.History(2)
    kept.extend([1, 2, 3, 4])
    return [
        ("defined", tools.inspected(session, "A", "1")), ("undefined", tools.inspected(session, "B")), ("loop", "".join(out)),
        ("job", str(jobs.wait(jobs.start(lambda: spark.range(5).count())))), ("running", str(len(jobs.running()))), ("history", ",".join(map(str, kept))),
    ]


@query("SELECT '^G' AS name, count(*) AS nodes, 4 AS depth, sum(octet_length(encode(o_orderstatus))) AS bytes FROM orders JOIN customer ON o_custkey = c_custkey")
def tree_statistics(spark, sf_dir):
    return tools.statistics(tree(spark, sf_dir)).select("name", "nodes", F.col("depth").cast("int").alias("depth"), "bytes")


@query("SELECT n_nationkey AS n, n_name AS line FROM nation")
def attached_reads(spark, sf_dir):
    """Commands that walk a tree that is a DataFrame."""
    session = Session(spark)
    session.attach(nodes.of_table(table(spark, sf_dir, "nation"), "^N", [F.col("n_nationkey")], F.col("n_name")))
    wrote = session.run('SET S="" FOR  SET S=$ORDER(^N(S)) QUIT:S=""  WRITE S,"=",^N(S),!')
    return spark.createDataFrame([(int(a), b) for a, b in (x.split("=") for x in wrote.splitlines())], "n int, line string")


@query("SELECT doc_id, length(coalesce(text, '')) AS n, true AS valid FROM documents")
def unicode_lengths(spark, sf_dir):
    from ..functions import unicode

    c = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", unicode.count(c).cast("bigint").alias("n"), unicode.is_valid(c.cast("binary")).alias("valid"))


@query("SELECT '^' || n_name AS doc_id, n_name AS text FROM nation")
def index_of_store(spark, sf_dir):
    from ..operators import search

    return search.documents_of(nodes.of_table(table(spark, sf_dir, "nation").withColumn("name", F.concat(F.lit("^"), "n_name")), "^", [], F.col("n_name")).drop("name").withColumn("name", F.concat(F.lit("^"), F.col("value"))), "^")


@query("""
SELECT row_number() OVER (ORDER BY r, n, c, o) AS place, '^G(' || r || ',' || n || ',' || c || ',' || o || ')="' || v || '"' AS line
FROM (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, o_orderkey AS o, o_orderstatus AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
""")
def tree_dump(spark, sf_dir):
    """The lines of a dump with their places: the sort of a whole tree."""
    from ..operators.lineage import numbered
    from ..functions.values import collation_key

    placed = numbered(tree(spark, sf_dir).withColumn("key", collation_key(F.col("subs"))), ["name", "key"], "place").drop("key")
    return placed.join(nodes.dump(tree(spark, sf_dir)).withColumn("subs", F.split(F.regexp_extract("line", r"\((.*)\)=", 1), ",")), "subs").select(F.col("place").cast("bigint").alias("place"), "line")


@query("""
SELECT event_type, window_start, n, total FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
""")
def event_windows(spark, sf_dir):
    """Tumbling windows of event time, over a table at rest."""
    from ..streaming import stateful

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = stateful.windowed(e, "1 day")
    return w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, sessions, largest FROM (SELECT user_id, count(*) AS sessions, max(n) AS largest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id)
""")
def event_sessions(spark, sf_dir):
    """Sessions that six quiet hours end."""
    from ..streaming import stateful

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.sessions(e, "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("largest"))
