"""A replicated text: characters with unique ids in a tree ordered by id (RGA).

A delta is JSON: a list of inserts [client, counter, parent client, parent counter, text] and deletes [client, counter]. Inserted text is a run of characters, each the next one's parent. Applying deltas is idempotent and doesn't depend on their order: what refers to an unknown character waits for it.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = ("", 0)


class TextDoc:
    """One replica. client must be unique among the replicas that write."""

    def __init__(self, client: str = ""):
        self.client = client
        self.chars: dict[tuple[str, int], tuple[tuple[str, int], str]] = {}
        self.gone: set[tuple[str, int]] = set()
        self.clock = 0

    def _order(self) -> list[tuple[str, int]]:
        """Ids in the text's order: depth first, later siblings (by counter, then client) first."""
        below: dict[tuple[str, int], list[tuple[str, int]]] = {}
        for i, (parent, _) in self.chars.items():
            below.setdefault(parent, []).append(i)
        out, stack = [], [ROOT]
        while stack:
            node = stack.pop()
            if node != ROOT:
                out.append(node)
            stack.extend(sorted(below.get(node, ()), key=lambda i: (i[1], i[0])))
        return out

    def ids(self) -> list[tuple[str, int]]:
        return [i for i in self._order() if i not in self.gone]

    def text(self) -> str:
        return "".join(self.chars[i][1] for i in self.ids())

    def set_text(self, new: str) -> bytes:
        """Changes the text and gives the delta."""
        ids = self.ids()
        old = "".join(self.chars[i][1] for i in ids)
        start = 0
        while start < min(len(old), len(new)) and old[start] == new[start]:
            start += 1
        tail = 0
        while tail < min(len(old), len(new)) - start and old[len(old) - 1 - tail] == new[len(new) - 1 - tail]:
            tail += 1
        inserted, ops = new[start : len(new) - tail], []
        if inserted:
            parent = ids[start - 1] if start else ROOT
            ops.append([self.client, self.clock + 1, *parent, inserted])
        ops += [list(i) for i in ids[start : len(ids) - tail]]
        delta = json.dumps(ops, ensure_ascii=False).encode()
        self.apply(delta)
        return delta

    def apply(self, delta: bytes) -> None:
        for op in json.loads(delta):
            if len(op) == 2:
                self.gone.add(tuple(op))
                continue
            client, counter, parent = op[0], op[1], (op[2], op[3])
            for k, c in enumerate(op[4]):
                self.chars.setdefault((client, counter + k), (parent, c))
                parent = (client, counter + k)
            self.clock = max(self.clock, counter + len(op[4]) - 1)

    def state(self) -> bytes:
        """A delta that gives an empty replica everything."""
        ops = [[*i, *parent, c] for i, (parent, c) in sorted(self.chars.items())]
        return json.dumps(ops + [list(i) for i in sorted(self.gone)], ensure_ascii=False).encode()

    @classmethod
    def rebuild(cls, baselines: list[bytes], deltas: list[bytes], client: str = "") -> TextDoc:
        doc = cls(client)
        for d in [*baselines, *deltas]:
            doc.apply(d)
        return doc


def merged_texts(deltas: DataFrame) -> DataFrame:
    """(resource_id, text) from deltas (resource_id, delta), whatever their order. Memory: one resource's deltas."""

    def run(t: pa.Table) -> pa.Table:
        doc = TextDoc.rebuild([], [d for d in t.column("delta").to_pylist() if d is not None])
        return pa.table({"resource_id": t.column("resource_id").slice(0, 1), "text": pa.array([doc.text()])})

    return deltas.select(F.col("resource_id").cast("long").alias("resource_id"), F.col("delta").cast("binary").alias("delta")).groupBy("resource_id").applyInArrow(run, "resource_id long, text string")
