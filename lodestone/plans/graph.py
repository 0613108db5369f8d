"""A small runner for graphs of stages over a state DataFrame.

A node is a function DataFrame -> DataFrame. Rows leave a node by an edge, or
by a condition: a column that names the next node of each row. Rows that reach
END are done. Each step runs every node once over the rows that wait for it, so
a step is one Spark plan however many rows there are. What a node with several
targets gives is written once to the shared folder and read by each, so a loop
does not multiply work. Rows that have not ended after max_steps are an error:
none is lost silently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import written

END = "__end__"
NODE = "__node__"


class StageGraph:
    def __init__(self):
        self._nodes: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._next: dict[str, Column] = {}
        self._targets: dict[str, set[str]] = {}
        self._entry: str | None = None

    def add_node(self, name: str, stage: Callable[[DataFrame], DataFrame]) -> StageGraph:
        if name in self._nodes or name == END:
            raise ValueError(f"node {name} is there already")
        self._nodes[name] = stage
        self._entry = self._entry or name
        return self

    def set_entry(self, name: str) -> StageGraph:
        self._entry = name
        return self

    def add_edge(self, start: str, end: str) -> StageGraph:
        return self.add_condition(start, F.lit(end), {end})

    def add_condition(self, start: str, choose: Column, targets: set[str]) -> StageGraph:
        """After `start`, each row goes to the node that `choose` names; a
        null, or a name that is not among the targets, ends the row."""
        if start in self._next:
            raise ValueError(f"node {start} has an edge already")
        self._next[start], self._targets[start] = choose, set(targets)
        return self

    def compile(self) -> Callable[[DataFrame], DataFrame]:
        known = {*self._nodes, END}
        if self._entry not in self._nodes:
            raise ValueError("the graph has no entry node")
        for start, targets in self._targets.items():
            if start not in known or not targets <= known:
                raise ValueError(f"an edge of {start} leads nowhere")
        return self.invoke

    def invoke(self, state: DataFrame, max_steps: int = 10) -> DataFrame:
        """The state of all rows, each as it reached END. Raises RuntimeError
        if some have not after max_steps."""
        waiting = {self._entry: state}
        done: list[DataFrame] = []
        for _ in range(max_steps):
            arrived: dict[str, list[DataFrame]] = {}
            for name, rows in waiting.items():
                out = self._nodes[name](rows)
                targets = self._targets.get(name, set())
                if name not in self._next or targets == {END}:
                    done.append(out)
                    continue
                choose = self._next[name]
                out = written(out.withColumn(NODE, F.coalesce(F.when(choose.isin(*targets), choose), F.lit(END))), "state")
                for target in {*targets, END}:
                    part = out.filter(F.col(NODE) == target).drop(NODE)
                    (done if target == END else arrived.setdefault(target, [])).append(part)
            waiting = {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for name, parts in arrived.items()}
            # a loop may have ended for all rows; a graph without loops needs no look
            if len(self._nodes) < max_steps and not self._loops():
                continue
            waiting = {name: rows for name, rows in waiting.items() if not rows.isEmpty()}
            if not waiting:
                break
        if waiting and any(not rows.isEmpty() for rows in waiting.values()):
            raise RuntimeError(f"rows wait at {', '.join(sorted(waiting))} after {max_steps} steps")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)

    def _loops(self) -> bool:
        """Whether some node can be reached from itself."""
        reach = {n: set(t) for n, t in self._targets.items()}
        for _ in reach:
            reach = {n: t.union(*(reach.get(x, set()) for x in t)) for n, t in reach.items()}
        return any(n in t for n, t in reach.items())
