"""Tool calls answered from a store of geometries, and the bounded loop of turns that asks a model and answers its calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.toolcalls import ToolCalls, call_results
from ..session import written
from . import store as stores
from .records import MESSAGES

#: Names that geocode is asked for.
ASKED = "struct<place_names:array<string>>"


def _json(text: Column) -> Column:
    """JSON string of a text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


def answered(calls: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """calls (key, name, arguments) with result, JSON of what the tool gives: geocode from the store, cyclic_order from its
    arguments, an error for others and for arguments that are not as the tool's schema declares them.

    key names one call. Places are looked up by equi-joins (see store.lookup); a name asked for twice is answered
    once, at its first place; unknown ones give an error of their own.
    """
    places = calls.where(F.col("name") == "geocode").select(*key, F.posexplode(F.array_distinct(F.coalesce(F.from_json("arguments", ASKED)["place_names"], F.array().cast("array<string>")))).alias("pos", "wanted"))
    found = stores.geocoded(places, store)
    entry = F.when(F.col("error").isNull(), F.to_json(F.struct("longitude", "latitude"))).otherwise(F.to_json(F.struct("error")))
    each = found.select(*key, "pos", F.concat(_json(F.col("wanted")), F.lit(":"), entry).alias("entry"))
    geo = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("entries"))
    geo = geo.select(*key, F.concat(F.lit("{"), F.array_join(F.transform("entries", lambda e: e["entry"]), ","), F.lit("}")).alias("geo"))
    rows = call_results(calls).join(geo, key, "left")
    return rows.withColumn("result", F.when(F.col("name") == "geocode", F.coalesce("result", "geo", F.lit("{}"))).otherwise(F.col("result"))).drop("geo")


def _message(role: Column, content: Column, calls: Column, name: Column, call_id: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"), calls.alias("tool_calls"), name.alias("name"), call_id.alias("tool_call_id"))


def tool_loop(threads: DataFrame, generate: Callable[[DataFrame], DataFrame], store: DataFrame, max_turns: int = 6, key: str = "conv_id") -> DataFrame:
    """key, messages, turns, stopped and outcome of threads (key, messages) after asking generate again and again.

    generate gets the open threads (thread, key, messages, turn) and returns thread and completion: the boundary to a model.
    A completion without calls is the last message (outcome answered). Else its narration and calls become one message,
    each call's result a tool message, and the thread is asked again, max_turns times at most; one that still calls
    then is stopped (calls left). A thread that gets no completion, or a null one, ends as it is (no completion).

    thread is a number of each row's own, so null and repeated keys are threads of their own; of several completions of a
    thread the least counts. Null messages count as none. A turn is one job over all open threads, written to the shared
    folder; calls are rows of a table function, and only a turn's own messages are gathered.
    """
    none = F.lit(None)
    open_ = written(threads.select(F.monotonically_increasing_id().alias("thread"), key, F.coalesce(F.col("messages").cast(MESSAGES), F.array().cast(MESSAGES)).alias("messages")), "threads")
    done = []

    def end(rows: DataFrame, turns: int, outcome: str) -> None:
        done.append(rows.select(key, "messages", F.lit(turns).alias("turns"), F.lit(outcome == "calls left").alias("stopped"), F.lit(outcome).alias("outcome")))

    for turn in range(max_turns):
        asked = open_.withColumn("turn", F.lit(turn))
        said = generate(asked).where("thread is not null and completion is not null").groupBy("thread").agg(F.min("completion").alias("completion"))
        said = written(said, "completions")
        called = written(said.lateralJoin(ToolCalls(F.col("completion").outer())), "calls")
        end(open_.join(said, "thread", "left_anti"), turn + 1, "no completion")
        last = _message(F.lit("assistant"), F.col("completion"), none, none, none)
        plain = said.join(called, "thread", "left_anti")
        end(open_.join(plain, "thread").withColumn("messages", F.concat("messages", F.array(last).cast(MESSAGES))), turn + 1, "answered")
        before = open_.select("thread", F.size("messages").alias("before"))
        calls = called.join(before, "thread").select("thread", F.col("position").alias("i"), F.format_string("call_%d_%d", "before", "position").alias("id"), "name", "arguments", "narration")
        results = answered(calls, store, ["thread", "i"]).groupBy("thread").agg(F.first("narration").alias("narration"), F.array_sort(F.collect_list(F.struct("i", "id", "name", "arguments", "result"))).alias("r"))
        function = lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"))
        asks = _message(F.lit("assistant"), F.col("narration"), F.transform("r", function), none, none)
        tells = F.transform("r", lambda c: _message(F.lit("tool"), c["result"], none, c["name"], c["id"]))
        open_ = written(open_.join(results, "thread").select("thread", key, F.concat("messages", F.array(asks).cast(MESSAGES), tells.cast(MESSAGES)).alias("messages")), "open")
        if open_.isEmpty():
            break
    end(open_, max_turns, "calls left")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out
