"""The change from one embedding model to another, as a state machine over each space's configuration log.

A space has one model and perhaps a next one. Slots hold vectors: the active one answers searches, the building one
fills up meanwhile. An entry that its state does not allow is refused and changes nothing; one that asks for vectors that
no slot has flags a resync.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Models of this family have task prefixes of their own unless the log gives any.
PREFIXED, PREFIXES = "nomic-embed-text", ("search_document: ", "search_query: ")


class State(NamedTuple):
    """Models are named by `key`; None stands for none."""

    model: str | None = None
    next: str | None = None
    document_prefix: str = ""
    query_prefix: str = ""
    active: str | None = None
    building: str | None = None


def key(name: str | None, digest: str | None, dims: int | None) -> str | None:
    """A model's identity; None if it lacks a part."""
    return f"{name}@{digest}/{dims}" if name and digest and dims and dims > 0 else None


def _prefixes(model: str, document: str | None, query: str | None) -> tuple[str, str]:
    return PREFIXES if not document and not query and model.startswith(PREFIXED) else (document or "", query or "")


def reshaped(s: State) -> tuple[State, bool]:
    """Slots as the configuration asks for, and whether a slot begins empty. A building slot of the new model takes over."""
    active, building, fresh = s.active, s.building, False
    if active != s.model:
        if building == s.model:
            active, building = building, None
        else:
            active, fresh = s.model, True
    wanted = s.next if s.next != s.model else None
    if wanted != building:
        building, fresh = wanted, fresh or wanted is not None
    return s._replace(active=active, building=building), fresh


def change(s: State, action: str | None, model: str | None, document: str | None = None, query: str | None = None) -> tuple[State, str | None, bool]:
    """The state after one entry, why it was refused (None if it wasn't), and whether spaces must be synced again."""
    refusal = None
    if action == "declare":
        if model is None:
            refusal = "incomplete model"
        else:
            s = State(model, None, *_prefixes(model, document, query), s.active, s.building)
    elif action == "next":
        refusal = "no model" if s.model is None else "incomplete model" if model is None else "same model" if model == s.model else None
        s = s if refusal else s._replace(next=model)
    elif action == "promote":
        if s.next is None:
            refusal = "no change in progress"
        else:
            s = State(s.next, None, *_prefixes(s.next, document, query), s.active, s.building)
    elif action == "cancel":
        refusal = "no model" if s.model is None else None
        s = s if refusal else s._replace(next=None)
    else:
        refusal = "unknown action"
    if refusal:
        return s, refusal, False
    s, fresh = reshaped(s)
    return s, None, fresh


def fold(log: DataFrame) -> DataFrame:
    """Every entry of `log` (space, seq, action, name, digest, dims, document_prefix, query_prefix) with the state after it.

    Entries of a space are taken by seq; entries without a space are left out. A task walks over its spaces' entries and
    holds one state at a time.
    """
    rows = log.where(F.col("space").isNotNull()).select("space", "seq", "action", "name", "digest", F.col("dims").cast("int").alias("dims"), "document_prefix", "query_prefix")
    placed = rows.repartition("space").sortWithinPartitions("space", "seq", "action", "name", "digest", "dims")
    texts = ["refusal", "model", "next", "document_prefix", "query_prefix", "active", "building"]
    schema = placed.select("space", "seq", "action").schema
    for t in texts:
        schema = schema.add(t, "string")
    schema = schema.add("resync", "boolean")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, s = None, State()
        for batch in batches:
            out: dict[str, list] = {t: [] for t in [*texts, "resync"]}
            for space, _, action, name, digest, dims, document, query in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if space != own:
                    own, s = space, State()
                s, refusal, fresh = change(s, action, key(name, digest, dims), document, query)
                for t, v in {"refusal": refusal, **s._asdict(), "resync": fresh}.items():
                    out[t].append(v)
            made = [pa.array(out[t], pa.string()) for t in texts] + [pa.array(out["resync"], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["space", "seq", "action", *texts, "resync"])

    return placed.mapInArrow(walk, schema)


def current(states: DataFrame) -> DataFrame:
    """(space, model, next, active, building): the state after each space's last entry."""
    names = ["model", "next", "active", "building"]
    return states.groupBy("space").agg(F.max_by(F.struct(*names), "seq").alias("s")).select("space", *(F.col(f"s.{n}").alias(n) for n in names))


def slot_progress(states: DataFrame, memories: DataFrame, models: Column) -> DataFrame:
    """(space, n, searchable, built, ready): a space's memories, those with a vector for its active and its building slot,
    and whether the building slot has all and can be promoted.

    `models` is the array of model keys that a memory has vectors of; a space has one row of state, which
    Spark joins to its memories.
    """
    met = memories.withColumn("__models", models).join(current(states).select("space", "active", "building"), "space")
    has = lambda slot: F.coalesce(F.array_contains("__models", F.col(slot)), F.lit(False))
    held = met.groupBy("space", "building").agg(F.count("*").alias("n"), F.count_if(has("active")).alias("searchable"), F.count_if(has("building")).alias("built"))
    return held.select("space", "n", "searchable", "built", (F.col("building").isNotNull() & (F.col("built") == F.col("n"))).alias("ready"))
