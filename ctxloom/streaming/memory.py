"""State that outlives a micro-batch: the immune memory of a system, and the items that agents share in a mesh.

Both are stateful processors over streams of actions, one state for each system or mesh, kept in
the state store and so in the query's checkpoint: a lost executor or a restarted query goes on
where it was. They need the state store of RocksDB (see STATE_STORE). A key's actions of one
batch are taken by time; how many a batch has is the source's own limit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.immune import WEIGHTS

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Actions on an immune memory: failure, screen, remove, reset, export.
IMMUNE_EVENT = "system string, ts timestamp, action string, id string, pattern string, symptom string, diagnosis string, severity string"
#: What comes out: alert (a pack is like an antibody), screened (safe or not), antibody (an export).
IMMUNE_OUT = "system string, kind string, id string, antibody string, similarity double, severity string, safe boolean, state string"
#: Actions on a mesh: publish, acknowledge, pending, pack, unregister, export.
MESH_EVENT = "mesh string, ts timestamp, action string, agent string, item_id string, item_kind string, priority double, scope array<string>, propagation string, expires_in double, kinds array<string>"
#: What comes out: pending or pack (an item that the agent is given), expired, dropped, item or ack (an export).
MESH_OUT = "mesh string, kind string, agent string, item_id string, item_kind string, priority double, propagation string, state string"


def likeness(a: dict, b: dict) -> float:
    """Likeness of two fingerprints, 0 to 1, as operators.immune.similarity() gives it on columns."""
    x, y = ({k["kind"]: k["ratio"] for k in p.get("kinds") or []} for p in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))

    def stats(name: str) -> float:
        return max(0.0, 1 - math.sqrt(sum((a[f"{name}_{k}"] - b[f"{name}_{k}"]) ** 2 for k in ("min", "max", "mean", "std"))) / 2)

    most = max(a["item_count"], b["item_count"])
    parts = {
        "kinds": sum(v * y.get(k, 0.0) for k, v in x.items()) / norm if norm else 1.0, "priority": stats("priority"), "recency": stats("recency"), "count": 1 - abs(a["item_count"] - b["item_count"]) / most if most else 1.0,
        "tokens": 1 - abs(a["token_utilization"] - b["token_utilization"]), "stale": 1 - abs(a["staleness_ratio"] - b["staleness_ratio"]), "redundancy": 1 - abs(a["redundancy"] - b["redundancy"]),
    }
    return sum(parts[k] * w for k, w in WEIGHTS.items())


def _ms(ts) -> int:
    return int(ts.timestamp() * 1000)


class ImmuneMemory(StatefulProcessor):
    """Antibodies of one system: the newest `most`, each until `ttl` seconds after its failure where that is given."""

    def __init__(self, threshold: float = 0.7, most: int = 100, ttl: float | None = None):
        self.threshold, self.most, self.ttl = threshold, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        life = None if self.ttl is None else int(self.ttl * 1000)
        self.antibodies = handle.getMapState("antibodies", "id string", "created long, pattern string, symptom string, diagnosis string, severity string", life)

    def _record(self, key, id_, created, pattern, symptom, diagnosis, severity) -> None:
        self.antibodies.updateValue((id_,), (created, pattern, symptom, diagnosis or "Unknown cause", severity or "warning"))
        known = [(v[0], k[0]) for k, v in self.antibodies.iterator()]
        for _, old in sorted(known)[: max(0, len(known) - self.most)]:
            self.antibodies.removeKey((old,))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        s = json.loads(initialState["state"])
        self._record(key, initialState["antibody"], s["created"], s["pattern"], s["symptom"], s["diagnosis"], s["severity"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        system = key[0]

        def row(kind, id_=None, antibody=None, similarity=None, severity=None, safe=None, state=None):
            return Row(system=system, kind=kind, id=id_, antibody=antibody, similarity=similarity, severity=severity, safe=safe, state=state)

        for r in sorted(rows, key=lambda r: (r["ts"], r["id"] or "")):
            if r["action"] == "failure":
                self._record(key, r["id"], _ms(r["ts"]), r["pattern"], r["symptom"], r["diagnosis"], r["severity"])
            elif r["action"] == "remove":
                if self.antibodies.containsKey((r["id"],)):
                    self.antibodies.removeKey((r["id"],))
            elif r["action"] == "reset":
                self.antibodies.clear()
            elif r["action"] == "screen":
                own, safe = json.loads(r["pattern"]), True
                for (antibody,), (_, pattern, _, _, severity) in sorted(self.antibodies.iterator()):
                    near = likeness(own, json.loads(pattern))
                    if near >= self.threshold:
                        safe = safe and severity != "block"
                        yield row("alert", r["id"], antibody, near, severity)
                yield row("screened", r["id"], safe=safe)
            elif r["action"] == "export":
                for (antibody,), v in sorted(self.antibodies.iterator()):
                    yield row("antibody", r["id"], antibody, severity=v[4], state=json.dumps(dict(zip(("created", "pattern", "symptom", "diagnosis", "severity"), v, strict=True))))


class SharedMesh(StatefulProcessor):
    """Items that agents share: the newest `most`, with scope, kinds, acknowledgements and expiry.

    Expired items are passed over at once, and leave the state, with a row `expired`, when the
    watermark has reached their time.
    """

    def __init__(self, most: int = 1000, ttl: float | None = None, propagation: str = "next-pack"):
        self.most, self.ttl, self.propagation = most, ttl, propagation

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "nth long", "item_id string, source string, item_kind string, priority double, scope string, propagation string, at long, expires long")
        self.acks = handle.getMapState("acks", "agent string, item_id string", "at long")
        self.next = handle.getValueState("next", "nth long")

    def _add(self, value: tuple) -> list[tuple]:
        """Add an item; the oldest that are too many now."""
        nth = self.next.get()[0] if self.next.exists() else 0
        self.items.updateValue((nth,), value)
        self.next.update((nth + 1,))
        if value[-1] is not None:
            self.handle.registerTimer(value[-1])
        held = sorted(k[0] for k in self.items.keys())
        old = [(k, self.items.getValue((k,))) for k in held[: max(0, len(held) - self.most)]]
        for k, _ in old:
            self.items.removeKey((k,))
        return [v for _, v in old]

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        if initialState["kind"] == "ack":
            self.acks.updateValue((initialState["agent"], initialState["item_id"]), (0,))
        else:
            self._add(tuple(json.loads(initialState["state"])))

    def _row(self, key, kind, value=None, agent=None, item_id=None, state=None):
        v = value or (item_id, None, None, None, None, None, None, None)
        return Row(mesh=key[0], kind=kind, agent=agent, item_id=v[0], item_kind=v[2], priority=v[3], propagation=v[5], state=state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r["ts"], r["item_id"] or "")):
            now, agent = _ms(r["ts"]), r["agent"]
            if r["action"] == "publish":
                life = self.ttl if r["expires_in"] is None else r["expires_in"]
                scope = None if r["scope"] is None else json.dumps(list(r["scope"]))
                value = (r["item_id"], agent, r["item_kind"], r["priority"], scope, r["propagation"] or self.propagation, now, None if life is None else now + int(life * 1000))
                for old in self._add(value):
                    yield self._row(key, "dropped", old)
            elif r["action"] == "acknowledge":
                self.acks.updateValue((agent, r["item_id"]), (now,))
            elif r["action"] == "unregister":
                for a, item in [k for k in self.acks.keys() if k[0] == agent]:
                    self.acks.removeKey((a, item))
            elif r["action"] in ("pending", "pack"):
                for _, v in sorted(self.items.iterator()):
                    item_id, source, kind, _, scope, propagation, _, expires = v
                    inside = source != agent and (scope is None or agent in json.loads(scope)) and (expires is None or now < expires) and (not r["kinds"] or kind in r["kinds"])
                    seen = propagation == "immediate" and self.acks.containsKey((agent, item_id))
                    if inside and not seen and not (r["action"] == "pack" and propagation == "on-demand"):
                        yield self._row(key, r["action"], v, agent)
            elif r["action"] == "export":
                for _, v in sorted(self.items.iterator()):
                    yield self._row(key, "item", v, state=json.dumps(v))
                for a, item in sorted(self.acks.keys()):
                    yield self._row(key, "ack", agent=a, item_id=item)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in sorted(self.items.iterator()):
            if v[-1] is not None and v[-1] <= due:
                self.items.removeKey(k)
                yield self._row(key, "expired", v)


def _prepared(df: DataFrame) -> None:
    if df.sparkSession.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}")


def immune_stream(events: DataFrame, threshold: float = 0.7, most: int = 100, ttl: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """The alerts of a stream of events (IMMUNE_EVENT); `start` are exported rows (IMMUNE_OUT, kind antibody) of the state to begin with."""
    _prepared(events)
    given = None if start is None else start.where("kind = 'antibody'").groupBy("system")
    mode = "None" if ttl is None else "ProcessingTime"
    return events.groupBy("system").transformWithState(ImmuneMemory(threshold, most, ttl), IMMUNE_OUT, "Update", mode, given)


def mesh_stream(events: DataFrame, late: str = "10 minutes", most: int = 1000, ttl: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """What agents are given of a stream of events (MESH_EVENT) whose rows are at most `late`; `start` are exported rows (MESH_OUT, kinds item and ack)."""
    _prepared(events)
    given = None if start is None else start.where(F.col("kind").isin("item", "ack")).groupBy("mesh")
    return events.withWatermark("ts", late).groupBy("mesh").transformWithState(SharedMesh(most, ttl), MESH_OUT, "Update", "EventTime", given)
