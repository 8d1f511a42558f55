"""Transactions: a stack of levels, each a delta of sets and subtree kills over a base table of nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import nodes as N


@dataclass
class Transactions:
    """Reads see all levels. Commit folds the top level into the one below, or into the base; rollback drops it."""

    base: DataFrame
    levels: list[list[tuple]] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return len(self.levels)

    def start(self) -> None:
        self.levels.append([])

    def set(self, name: str, *path_and_value: str) -> None:
        *path, value = map(str, path_and_value)
        self._do(("S", name, tuple(path), value))

    def kill(self, name: str, *path: str) -> None:
        self._do(("K", name, tuple(map(str, path)), None))

    def _do(self, op: tuple) -> None:
        if self.levels:
            self.levels[-1].append(op)
        else:
            self.base = _applied(self.base, [op])

    def commit(self) -> None:
        if not self.levels:
            return
        top = self.levels.pop()
        if self.levels:
            self.levels[-1] += top
        else:
            self.base = _applied(self.base, top)

    def rollback(self, all_levels: bool = False) -> None:
        del self.levels[0 if all_levels else -1 :]

    def view(self) -> DataFrame:
        """The nodes as a read inside the transaction sees them."""
        return _applied(self.base, [op for level in self.levels for op in level])


def _applied(base: DataFrame, ops: list[tuple]) -> DataFrame:
    """base after ops in order: killed subtrees go in one anti join, the values that outlive them come in one union."""
    sets: dict[tuple, str] = {}
    kills: list[tuple] = []
    for op, name, path, value in ops:
        if op == "S":
            sets[name, path] = value
        else:
            kills.append((name, path))
            sets = {k: v for k, v in sets.items() if not (k[0] == name and k[1][: len(path)] == path)}
    spark, out = base.sparkSession, base
    if kills:
        out = N.kill_all(out, spark.createDataFrame([(n, list(p)) for n, p in dict.fromkeys(kills)], "name string, subs array<string>"))
    if sets:
        out = N.put(out, N.of_rows(spark, [(n, list(p), v) for (n, p), v in sets.items()]))
    return out
