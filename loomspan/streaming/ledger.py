"""Ledgers and leases whose state lives in the stream: admission under a budget, and closure of leases.

Both keep keyed state in Spark's state store, so a stream that starts again from its checkpoint goes on where it
stopped. The rows that one batch brings for one key are taken in their order by one task; how many that are is bounded
by what the stream admits to a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Admission(StatefulProcessor):
    """State of a ledger: what is charged, and the jobs it holds with the time until which their names are kept."""

    def __init__(self, opening: int, teardown: int, limit: int, keep: int | None):
        self.opening, self.teardown, self.limit, self.keep = opening, teardown, limit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "charged long")
        self.jobs = handle.getMapState("jobs", "job string", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        charged = (self.spent.get() or (0,))[0]
        found = pd.concat(list(rows)).sort_values(["at", "id"])
        states, prior, taken = [], [], []
        for job, reserve, charge, at in zip(found["job"], found["reserve"], found["charge"], found["at"], strict=True):
            if self.jobs.containsKey((job,)):
                state = "DUPLICATE_JOB"
            elif self.opening + charged + int(reserve) + self.teardown > self.limit:
                state = "OVER_BUDGET"
            else:
                state = "ACCEPTED"
                until = -1 if self.keep is None else int(at) // 1000 + self.keep
                self.jobs.updateValue((job,), (until,))
                if until >= 0:
                    self.handle.registerTimer(until)
            states.append(state)
            prior.append(charged)
            taken.append(int(charge) if state == "ACCEPTED" else 0)
            charged += taken[-1]
        self.spent.update((charged,))
        yield pd.DataFrame({"ledger": key[0], "id": found["id"], "job": found["job"], "state": states, "prior": prior, "charged": taken})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Names of jobs whose time has passed are free again; what they were charged stays."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (job,), (until,) in list(self.jobs.iterator()):
            if 0 <= until <= now:
                self.jobs.removeKey((job,))
        return iter(())

    def close(self) -> None:
        pass


def admit(stream: DataFrame, opening: int = 7200, teardown: int = 120, limit: int = 86_400, keep_ms: int | None = None) -> DataFrame:
    """(ledger, id, job, state, prior, charged) of a stream of (ledger, id, job, reserve, charge, at), at in microseconds.

    Rows of a ledger are taken by (at, id). A job whose name the ledger holds is DUPLICATE_JOB; one whose reserve, with
    what is charged so far (prior), the opening charge and the teardown, passes the limit is OVER_BUDGET and leaves no
    trace; others are ACCEPTED and charged. keep_ms: names are held until the watermark of the stream's column `when`
    has passed their row's time by so much; without it for good."""
    processor = _Admission(opening, teardown, limit, keep_ms)
    mode = "none" if keep_ms is None else "eventTime"
    return stream.groupBy("ledger").transformWithStateInPandas(processor, "ledger string, id long, job string, state string, prior long, charged long", "append", mode)


class _Lease(StatefulProcessor):
    """State of a lease: how many consumers it has, how many of them have accepted, and each consumer's part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "registered long, accepted long, repeated long, strange long")
        self.consumers = handle.getMapState("consumers", "consumer string", "registered boolean, accepted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        registered, accepted, repeated, strange = self.sums.get() or (0, 0, 0, 0)
        again = 0
        for frame in rows:
            for consumers, consumer in zip(frame["consumers"], frame["consumer"], strict=True):
                if consumers is not None and registered:
                    again += 1  # a lease has one complete list of consumers
                elif consumers is not None:
                    for c in consumers:
                        held = self.consumers.getValue((c,)) or (False, False)
                        self.consumers.updateValue((c,), (True, held[1]))
                        registered, accepted, strange = registered + 1, accepted + held[1], strange - held[1]
                else:
                    held = self.consumers.getValue((consumer,)) or (False, False)
                    self.consumers.updateValue((consumer,), (held[0], True))
                    repeated += held[1]
                    accepted += held[0] and not held[1]
                    strange += not held[0] and not held[1]
        self.sums.update((registered, accepted, repeated, strange))
        yield pd.DataFrame({"lease": [key[0]], "registered": [registered], "accepted": [accepted], "released": [0 < registered == accepted], "repeated": [repeated], "strange": [strange], "again": [again]})

    def close(self) -> None:
        pass


def close_leases(stream: DataFrame) -> DataFrame:
    """The state of each lease that a batch touches, for a stream of (lease, consumers, consumer): a row with
    `consumers` registers the lease, one without says that `consumer` has accepted.

    released: every registered consumer has accepted. A consumer's further acceptances count as repeated; those of
    consumers that the lease does not name (yet) as strange. again: registrations of the batch that came after the first,
    which change nothing."""
    return stream.groupBy("lease").transformWithStateInPandas(_Lease(), "lease long, registered long, accepted long, released boolean, repeated long, strange long, again long", "update", "none")
