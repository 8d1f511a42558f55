import json

from canopy.operators import nodes, tools
from canopy.operators.session import Session


def test_json_rpc():
    t = tools.Tools()
    t.register("add", lambda a, b: a + b, "adds")
    ask = lambda **x: json.loads(t.answer(json.dumps({"jsonrpc": "2.0", "id": 1, **x})))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "canopy"
    assert ask(method="tools/list")["result"]["tools"] == [{"name": "add", "description": "adds"}]
    assert ask(method="tools/call", params={"name": "add", "arguments": {"a": 1, "b": 2}})["result"]["content"][0]["text"] == "3"
    assert ask(method="tools/call", params={"name": "add", "arguments": {}})["error"]["code"] == tools.FAILED
    assert ask(method="nope")["error"]["code"] == ask(method="tools/call", params={"name": "x"})["error"]["code"] == tools.NO_METHOD
    assert json.loads(t.answer("{"))["error"]["code"] == tools.PARSE and json.loads(t.answer("[]"))["error"]["code"] == tools.INVALID


def test_sessions_and_jobs(spark):
    s = Session(spark)
    s.run('SET A(1)="x"')
    assert tools.inspected(s, "A", "1") == 'A("1")="x"' and tools.inspected(s, "B") == "B UNDEFINED"
    jobs = tools.Jobs(spark)
    assert jobs.wait(jobs.start(lambda: spark.range(5).count())) == 5 and jobs.running() == []
    stats = tools.statistics(nodes.of_rows(spark, [("^A", ["1", "2"], "xy"), ("^A", [], "z")])).first()
    assert (stats["nodes"], stats["depth"], stats["bytes"]) == (2, 2, 3)
    out = []
    tools.loop(spark, iter(["SET X=5", "WRITE X+1,!", "/vars", "1bad", "/help", "/quit", "WRITE 9"]), out.append)
    assert "".join(out).startswith('6\nX="5"\n') and "9" not in "".join(out)
