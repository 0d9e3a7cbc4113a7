"""The session store as a stream: values keep or get their tokens as they arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, value string, type string, token string"
STATE = "tokens map<string,string>, top map<string,bigint>"


def session_tokens(finds: DataFrame, mode: str = "append") -> DataFrame:
    """A stream of (session_id, value, type, prefix, seen) to one row for each new value with its token.

    State a session: value to token and the largest number a prefix; numbers are never given twice, and a value keeps
    the token of its first sight, across batches and restarts.
    """

    def step(key, batches, state: GroupState):
        tokens, top = (dict(x or {}) for x in state.get) if state.exists else ({}, {})
        rows = pd.concat(list(batches)).sort_values(["seen", "value"])
        out = []
        for r in rows.itertuples():
            if r.value not in tokens:
                top[r.prefix] = top.get(r.prefix, 0) + 1
                tokens[r.value] = f"{r.prefix}_{top[r.prefix]}"
                out.append((key[0], r.value, r.type, tokens[r.value]))
        state.update((tokens, top))
        yield pd.DataFrame(out, columns=["session_id", "value", "type", "token"])

    return finds.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, mode, GroupStateTimeout.NoTimeout)
