"""Small driver-side tools: JSON-RPC over registered functions, inspection of sessions, jobs, and a read-evaluate loop."""

from __future__ import annotations

import json
import sys
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compiler import SyntaxProblem
from .session import Session

# Fixed error codes of JSON-RPC.
PARSE, INVALID, NO_METHOD, FAILED = -32700, -32600, -32601, -32000


@dataclass
class Tools:
    """Functions by name, callable by JSON-RPC 2.0 requests: initialize, tools/list, tools/call."""

    functions: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    def register(self, name: str, function: Callable, about: str = "") -> None:
        self.functions[name] = (function, about)

    def answer(self, request: str) -> str:
        """The response to a request's text."""
        try:
            asked = json.loads(request)
        except ValueError:
            return self._error(None, PARSE, "not JSON")
        if not isinstance(asked, dict) or asked.get("jsonrpc") != "2.0" or "method" not in asked:
            return self._error(asked.get("id") if isinstance(asked, dict) else None, INVALID, "not a request")
        who, method, params = asked.get("id"), asked["method"], asked.get("params") or {}
        if method == "initialize":
            return self._result(who, {"capabilities": {"tools": {}}, "serverInfo": {"name": "canopy", "version": "1"}})
        if method == "tools/list":
            return self._result(who, {"tools": [{"name": n, "description": d} for n, (_, d) in sorted(self.functions.items())]})
        if method != "tools/call":
            return self._error(who, NO_METHOD, f"no method {method}")
        if params.get("name") not in self.functions:
            return self._error(who, NO_METHOD, f"no tool {params.get('name')}")
        try:
            value = self.functions[params["name"]][0](**(params.get("arguments") or {}))
        except Exception as problem:  # whatever a tool raises goes to its caller
            return self._error(who, FAILED, str(problem))
        return self._result(who, {"content": [{"type": "text", "text": str(value)}]})

    @staticmethod
    def _result(who, result: dict) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": who, "result": result})

    @staticmethod
    def _error(who, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": who, "error": {"code": code, "message": message}})


def inspected(session: Session, name: str, *subs: str) -> str:
    """A variable as NAME("sub")="value", or that it is undefined."""
    shown = name + ("(" + ",".join(f'"{s}"' for s in subs) + ")" if subs else "")
    value = session.value(name, subs)
    return f"{shown} UNDEFINED" if value is None else f'{shown}="{value}"'


class History(deque):
    """The last entries of a trace or of a variable's values."""

    def __init__(self, most: int = 10000):
        super().__init__(maxlen=most)


@dataclass
class Job:
    """Something that runs beside the driver's main thread, with its number and outcome."""

    number: int
    thread: threading.Thread
    started: float
    outcome: object = None
    problem: BaseException | None = None


@dataclass
class Jobs:
    """Numbered jobs; Spark actions within one share a job group, so that they can be cancelled together."""

    spark: SparkSession
    all: dict[int, Job] = field(default_factory=dict)

    def start(self, action: Callable[[], object]) -> int:
        number = len(self.all) + 1

        def run() -> None:
            self.spark.sparkContext.setJobGroup(f"canopy-{number}", "job", interruptOnCancel=True)
            try:
                job.outcome = action()
            except BaseException as problem:  # kept for whoever asks
                job.problem = problem

        job = Job(number, threading.Thread(target=run, daemon=True), time.time())
        self.all[number] = job
        job.thread.start()
        return number

    def running(self) -> list[int]:
        return [n for n, j in self.all.items() if j.thread.is_alive()]

    def wait(self, number: int) -> object:
        job = self.all[number]
        job.thread.join()
        if job.problem:
            raise job.problem
        return job.outcome

    def cancel(self, number: int) -> None:
        self.spark.sparkContext.cancelJobGroup(f"canopy-{number}")


def statistics(nodes: DataFrame) -> DataFrame:
    """Nodes, deepest path and bytes of values of each tree."""
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.size("subs")).alias("depth"), F.sum(F.octet_length("value")).alias("bytes"))


def loop(spark: SparkSession, lines=sys.stdin, write: Callable[[str], object] = sys.stdout.write) -> Session:
    """Runs lines of commands until /quit; /load file, /clear, /vars, /globals and /history do what they say."""
    session, history = Session(spark), History()
    for line in lines:
        line = line.rstrip("\n")
        history.append(line)
        word, _, rest = line.partition(" ")
        try:
            if word == "/quit":
                break
            if word == "/load":
                session.do_zlink('"' + rest + '"')
            elif word == "/clear":
                session = Session(spark)
            elif word in ("/vars", "/globals"):
                table = session.globals if word == "/globals" else session.scopes[-1]
                for name in sorted({k[0] for k in table}):
                    write(session.run(f"ZWRITE {name}"))
            elif word == "/history":
                write("\n".join(history) + "\n")
            elif word == "/help":
                write("/quit /load /clear /vars /globals /history /help\n")
            else:
                write(session.run(line))
        except SyntaxProblem as problem:
            write(f"{problem}\n")
    return session
