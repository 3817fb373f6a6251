"""Keyed state with expiry and accumulation of streamed deltas, in batch and streaming form."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tracewake.operators.slices import MIN_HOT, same_keys, sliced
from tracewake.session import cut

# fixed values: default times to live in hours
CACHE_HOURS, CHECKPOINT_HOURS, PROGRESS_HOURS = 72, 24, 24


def expiry(at: Column, hours: int) -> Column:
    """at plus the time to live; hours 0 means the cache's default."""
    return at + F.make_dt_interval(hours=F.lit(hours or CACHE_HOURS))


def written(rows: DataFrame, at: str = "at", hours: int = CACHE_HOURS) -> DataFrame:
    return rows.withColumn("expires_at", expiry(F.col(at), hours))


def current(rows: DataFrame, key: str, as_of: Column, at: str = "at", deleted: str | None = None) -> DataFrame:
    """The last written, unexpired, not deleted row of each key as of a time; a partial maximum per key."""
    rest = [c for c in rows.columns if c not in (key, at)]
    last = rows.where(F.col(at) <= as_of).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r")).select(key, f"r.{at}", *[f"r.{c}" for c in rest])
    live = last.where(F.col("expires_at") > as_of)
    return live.where(~F.col(deleted)) if deleted else live


def cache_hits(writes: DataFrame, probes: DataFrame, key: str, hours: int = CACHE_HOURS, min_hot: int = MIN_HOT) -> DataFrame:
    """Probes with hit: a write of the key lies at or before the probe, by less than the time to live.

    Writes and probes of a key go through one running maximum. Hot keys are cut into
    slices at their own quantiles; the last write before a slice comes from a small
    table of the slices' last writes (bounded, hence a safe broadcast).
    """
    w = writes.select(F.col(key).alias("k"), "at", F.lit(0).alias("is_probe"), F.lit(None).cast("long").alias("probe_id"))
    p = probes.select(F.col(key).alias("k"), "at", F.lit(1).alias("is_probe"), F.col("probe_id").cast("long").alias("probe_id"))
    order = ["at", "is_probe", "probe_id"]
    both, hot = sliced(w.unionByName(p), ["k"], order, min_hot)
    written = F.when(F.col("is_probe") == 0, F.col("at"))
    if hot:
        both = cut(both)
    before = Window.partitionBy("k", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("last", F.max(written).over(before)).where("is_probe = 1")
    if hot:
        ends = both.where("slice > 0").groupBy("k", "slice").agg(F.max(written).alias("m"))
        earlier = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("k", "slice", F.max("m").over(earlier).alias("carried"))
        cond = (F.col("l.slice") == F.col("r.slice")) & same_keys(["k"])
        out = out.alias("l").join(F.broadcast(carried.alias("r")), cond, "left").select("l.k", "l.at", "l.probe_id", F.coalesce("l.last", "r.carried").alias("last"))
    return out.select("probe_id", F.col("k").alias(key), "at", F.coalesce(F.col("last") + F.make_dt_interval(hours=F.lit(hours)) > F.col("at"), F.lit(False)).alias("hit"))


def checkpoint_rows(messages: DataFrame) -> DataFrame:
    """task_id, step_count, envelope of messages as tagged JSON; one row is one saved state."""
    env = F.to_json(F.struct(F.col("role").alias("type"), F.struct("content", "tool_call_id").alias("payload")))
    return messages.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").cast("int").alias("step_count"), F.transform(F.array_sort(F.collect_list(F.struct("pos", env.alias("e")))), lambda x: x["e"]).alias("envelopes")
    )


def restored(states: DataFrame) -> DataFrame:
    """Messages of saved states; an unknown tag is an error."""
    e = F.from_json("e", "type string, payload struct<content:string,tool_call_id:string>")
    out = states.select("conv_id", F.posexplode("envelopes").alias("pos", "e")).select("conv_id", "pos", e.alias("m"))
    role = F.when(F.col("m.type").isin("user", "assistant", "tool"), F.col("m.type")).otherwise(F.raise_error(F.concat(F.lit("unknown message type "), F.coalesce("m.type", F.lit("null")))))
    return out.select("conv_id", "pos", role.alias("role"), F.col("m.payload.content").alias("content"), F.col("m.payload.tool_call_id").alias("tool_call_id"))


def resumed(states: DataFrame, seeds: DataFrame) -> DataFrame:
    """conv_id, pos, role, content, tool_call_id, fresh: messages of saved states; a run without one, or whose state
    can't be read, starts from its seed. seeds: conv_id, content; one row a run."""
    e = F.from_json("e", "type string, payload struct<content:string,tool_call_id:string>")
    known = F.coalesce(F.col("m.type").isin("user", "assistant", "tool") & F.col("m.payload").isNotNull(), F.lit(False))
    whole = states.select("conv_id", "envelopes", F.coalesce(F.forall(F.transform("envelopes", lambda x: F.from_json(x, "type string, payload struct<content:string,tool_call_id:string>")), lambda m: F.coalesce(m["type"].isin("user", "assistant", "tool") & m["payload"].isNotNull(), F.lit(False))), F.lit(False)).alias("ok"))
    good = whole.where("ok")
    kept = good.select("conv_id", F.posexplode("envelopes").alias("pos", "e")).select("conv_id", "pos", e.alias("m")).where(known)
    kept = kept.select("conv_id", "pos", F.col("m.type").alias("role"), F.col("m.payload.content").alias("content"), F.col("m.payload.tool_call_id").alias("tool_call_id"), F.lit(False).alias("fresh"))
    new = seeds.join(good.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).alias("pos"), F.lit("user").alias("role"), "content", F.lit(None).cast("string").alias("tool_call_id"), F.lit(True).alias("fresh"))
    return kept.unionByName(new)


def accumulated(deltas: DataFrame) -> DataFrame:
    """stream_id, content, calls, finish. deltas: stream_id, seq, content, call_index, call_id, call_name, arguments, finish.

    Text is concatenated in order; of ids, names and finish reasons the last one not empty counts.
    """
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", F.col(c).alias("t"))))), lambda x: x["t"]), "")
    last = lambda c: F.max_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    whole = deltas.groupBy("stream_id").agg(text("content").alias("content"), last("finish").alias("finish"))
    calls = deltas.where("call_index IS NOT NULL").groupBy("stream_id", "call_index").agg(last("call_id").alias("id"), last("call_name").alias("name"), text("arguments").alias("arguments"))
    lists = calls.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("call_index", "id", "name", "arguments"))).alias("calls"))
    return whole.join(lists, "stream_id", "left")


def stream_latest(rows: DataFrame, key: str, hours: int = CACHE_HOURS) -> DataFrame:
    """Streaming form: emits key, value, written_at when a key is written; state expires after the time to live.

    rows: key, value (strings), at (event time, with a watermark).
    """

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for b in batches:
            for value, at in zip(b["value"], b["at"], strict=True):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                if best is None or ms >= best[1]:
                    best = (json.dumps(value), ms)
        state.update(best)
        state.setTimeoutTimestamp(max(best[1] + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "value": [json.loads(best[0])], "written_at": [best[1]]})

    out = f"{key} string, value string, written_at long"
    return rows.groupBy(key).applyInPandasWithState(fn, out, "value string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def stream_accumulated(deltas: DataFrame, hours: int = CHECKPOINT_HOURS) -> DataFrame:
    """Streaming form of accumulated: emits stream_id, content, calls (JSON), finish after each batch that adds to a stream.

    deltas: as for accumulated, with an event time at and a watermark; seq orders a stream's deltas
    and is not repeated across batches. State expires after the time to live without deltas.
    """

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts, at = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for b in batches:
            at = max([at, *(int(pd.Timestamp(x).timestamp() * 1000) for x in b["at"])])
            for r in b.drop(columns=["at"]).astype(object).where(b.notna(), None).to_dict("records"):
                parts.append([int(r["seq"]), r["content"], None if r["call_index"] is None else int(r["call_index"]), r["call_id"], r["call_name"], r["arguments"], r["finish"]])
        parts.sort(key=lambda p: p[0])
        calls: dict[int, dict[str, object]] = {}
        for _, _, i, call_id, name, arguments, _ in parts:
            if i is not None:
                c = calls.setdefault(i, {"call_index": i, "id": None, "name": None, "arguments": ""})
                c |= {"id": call_id or c["id"], "name": name or c["name"], "arguments": c["arguments"] + (arguments or "")}
        state.update((json.dumps(parts), at))
        state.setTimeoutTimestamp(max(at + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        finish = next((p[6] for p in reversed(parts) if p[6]), None)
        yield pd.DataFrame({"stream_id": [k[0]], "content": ["".join(p[1] or "" for p in parts)], "calls": [json.dumps([calls[i] for i in sorted(calls)])], "finish": [finish]})

    out = f"stream_id {deltas.schema['stream_id'].dataType.simpleString()}, content string, calls string, finish string"
    return deltas.groupBy("stream_id").applyInPandasWithState(fn, out, "parts string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def stream_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts per event type in tumbling windows with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
