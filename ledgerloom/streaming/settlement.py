"""Stateful sinks over a ledger: what a batch settles, what it leaves open and what came too late become visible in one commit.

Spark's own stateful operators drop rows behind the watermark without a word. These sinks hold their state in tables of a ledger
instead: every row that arrives ends in a result, in the open state, or in a table of late rows, and a repeated batch is passed over
because its number is the cursor that was committed with its rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from ..sources.ledger import Ledger

Sink = Callable[[DataFrame, int], None]
Clock = Callable[[], dt.datetime]


def now() -> dt.datetime:
    """The wall clock, UTC."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def micros(at: dt.datetime) -> int:
    return (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def _moment(value: int | None) -> Column:
    return F.timestamp_micros(F.lit(value).cast("long"))


def _new(ledger: Ledger, number: int) -> dict | None:
    """The state that a batch starts from, or None if the batch is in already."""
    base = ledger.state()
    return None if base["cursor"] is not None and number <= base["cursor"] else base


def _head(base: dict, batch: DataFrame, at: str) -> int | None:
    """The newest event time of all batches so far, in microseconds."""
    found = batch.agg(F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()[0]
    known = [x for x in (found, base["notes"].get("head")) if x is not None]
    return max(known) if known else None


def _with(ledger: Ledger, base: dict, tables: dict, table: str, rows: DataFrame, at: str | None = None) -> DataFrame | None:
    """Append rows to a table of the next commit, unless there are none."""
    rows = settle(rows, table)
    newest = rows.agg(F.count(F.lit(1)), *([F.max(F.unix_micros(F.col(at).cast("timestamp")))] if at else [])).first()
    if not newest[0]:
        return None
    entry = ledger.write(rows, table, **({"newest": newest[1]} if at and newest[1] is not None else {}))
    tables[table] = ledger.appended(table, base | {"tables": base["tables"] | tables}, entry)
    return rows


def append_sink(ledger: Ledger, table: str) -> Sink:
    """Add every batch once; folders are folded as they grow in number."""

    def write(batch: DataFrame, number: int) -> None:
        base, tables = _new(ledger, number), {}
        if base is not None:
            _with(ledger, base, tables, table, batch)
            ledger.publish(base, tables, cursor=number)

    return write


def _gate(head: int | None, delay: dt.timedelta, clock: Clock, wait: dt.timedelta, floor: dt.date | None) -> dt.date | None:
    """The first day that is not settled: days before it have ended both in event time, less delay, and on the clock, less wait."""
    if head is None:
        return floor
    day = min(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=head) - delay, clock() - wait).date()
    return max(day, floor) if floor else day


class DaySettlement:
    """Daily sums that are given out once, when both gates have passed a day's end.

    One gate is event time: the newest event of all batches lies `delay` behind the end. The other is the clock, which lies `wait` behind
    it. Until then a day's sums are open state, one row a day and key, also over restarts; `release` gives out what only the clock
    held back, when the source is idle. A row of a day that was given out goes to the late rows, as does one without a time; so settled,
    open and late rows are all rows. Measures are sums (counts are): sums of batches are added up.

    Tables: settled, open (keys, measures, day), late (the rows).
    """

    def __init__(self, ledger: Ledger, at: str, delay: dt.timedelta, keys: Sequence[str], measures: dict[str, Column], *, wait: dt.timedelta = dt.timedelta(0), clock: Clock = now):
        self.ledger, self.at, self.delay, self.keys, self.measures, self.wait, self.clock = ledger, at, delay, list(keys), measures, wait, clock

    def sink(self, batch: DataFrame, number: int) -> None:
        base = _new(self.ledger, number)
        if base is None:
            return
        rows = settle(batch, "settlement")
        day = F.to_date(F.col(self.at).cast("timestamp"))
        to = base["notes"].get("settled_to")
        closed = day.isNull() | (day < F.lit(to).cast("date") if to else F.lit(False))
        fresh = rows.filter(~closed).groupBy(day.alias("day"), *self.keys).agg(*[m.alias(n) for n, m in self.measures.items()])
        self._commit(base, fresh, rows.filter(closed), _head(base, rows, self.at), number)

    def release(self) -> None:
        """Look at both gates again without new rows."""
        base = self.ledger.state()
        self._commit(base, None, None, base["notes"].get("head"), None)

    def _commit(self, base: dict, fresh: DataFrame | None, late: DataFrame | None, head: int | None, number: int | None) -> None:
        known = self.ledger.read("open", base)
        parts = [x for x in (known, fresh) if x is not None]
        if not parts:
            return
        kinds = {f.name: f.dataType for f in parts[0].schema.fields}
        sums = reduce(DataFrame.unionByName, parts).groupBy("day", *self.keys).agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in self.measures])
        sums = settle(sums, "open-days")
        old = base["notes"].get("settled_to")
        to = _gate(head, self.delay, self.clock, self.wait, dt.date.fromisoformat(old) if old else None)
        done = F.col("day") < F.lit(to) if to else F.lit(False)
        tables: dict = {}
        _with(self.ledger, base, tables, "settled", sums.filter(done))
        if late is not None:
            _with(self.ledger, base, tables, "late", late)
        tables["open"] = [self.ledger.write(sums.filter(~done).coalesce(1), "open")]
        self.ledger.publish(base, tables, cursor=number, head=head, settled_to=to.isoformat() if to else None)


def keep_first_sink(ledger: Ledger, key: Sequence[str], at: str, delay: dt.timedelta) -> Sink:
    """Each key once. Tables: kept, repeated and late (together all rows that were delivered), seen (key and time of kept rows).

    A row counts as late when it lies more than `delay` behind the newest event of earlier batches, or has no time: its copy may be
    forgotten by then, so it is put aside instead of being dropped or given out twice. Keys are remembered as long as that.
    """
    key = list(key)

    def write(batch: DataFrame, number: int) -> None:
        base = _new(ledger, number)
        if base is None:
            return
        rows, tables = settle(batch, "redelivered"), {}
        mark = lambda head: None if head is None else head - delay // dt.timedelta(microseconds=1)
        before = mark(base["notes"].get("head"))
        late = F.col(at).isNull() | (F.col(at) < _moment(before) if before is not None else F.lit(False))
        place = F.row_number().over(Window.partitionBy(*key).orderBy(at))
        ranked = rows.filter(~late).withColumn("__first", place == 1)
        seen = ledger.read("seen", base)
        if seen is not None:
            ranked = ranked.join(seen.select(*key).distinct().withColumn("__seen", F.lit(True)), key, "left").withColumn("__first", F.col("__first") & F.col("__seen").isNull())
        ranked = settle(ranked.select(*batch.columns, "__first"), "first-rows")
        _with(ledger, base, tables, "late", rows.filter(late))
        _with(ledger, base, tables, "repeated", ranked.filter(~F.col("__first")).drop("__first"))
        kept = _with(ledger, base, tables, "kept", ranked.filter("__first").drop("__first"))
        if kept is not None:
            _with(ledger, base, tables, "seen", kept.select(*key, at), at)
        head = _head(base, rows, at)
        after = mark(head)
        entries = tables.get("seen", base["tables"].get("seen", []))
        tables["seen"] = [e for e in entries if after is None or e.get("newest", after) >= after]
        ledger.publish(base, tables, cursor=number, head=head)

    return write


ORDER = ["order_id", "placed_at", "fills", "first_fill", "refunded", "redeemed"]


class OrderEnds:
    """Orders followed from their placing to their end over any number of batches of order steps.

    Steps are (order_id, step, at): `placed`, or a fill, which is `filled`, `refunded` or `redeemed` by what followed it. A fill counts for its order if it lies
    within `within` of the placing. An order ends when the newest step of earlier batches lies `delay` behind that bound: filled or not,
    it is given out once, an unfilled one as placed. A fill that comes before its order waits for it as long as an order can still come.
    Without `within` no order expires and every fill counts.

    Tables: ended and open (order_id, placed_at, fills, first_fill, refunded, redeemed), waiting (fills), late (steps behind the mark or
    without a time), stray (fills outside of their order's bound, or without an order). Every step is in one of these or counted in an order.
    """

    def __init__(self, ledger: Ledger, delay: dt.timedelta, within: dt.timedelta | None = None):
        self.ledger, self.delay, self.within = ledger, delay // dt.timedelta(microseconds=1), within

    def sink(self, batch: DataFrame, number: int) -> None:
        ledger, base = self.ledger, _new(self.ledger, number)
        if base is None:
            return
        rows, tables = settle(batch.select("order_id", "step", "at"), "order-steps"), {}
        head = _head(base, rows, "at")
        before, after = (None if h is None else h - self.delay for h in (base["notes"].get("head"), head))
        late = F.col("at").isNull() | (F.col("at") < _moment(before) if before is not None and self.within else F.lit(False))
        _with(ledger, base, tables, "late", rows.filter(late))
        steps = rows.filter(~late)
        held, waited = ledger.read("open", base), ledger.read("waiting", base)
        zero = F.lit(0).cast("long")
        placed = steps.filter(F.col("step") == "placed").groupBy("order_id").agg(F.min("at").alias("placed_at"))
        placed = placed.select("order_id", "placed_at", zero.alias("fills"), F.lit(None).cast("timestamp").alias("first_fill"), zero.alias("refunded"), zero.alias("redeemed"))
        orders = placed if held is None else held.unionByName(placed)
        # A placing that is delivered again changes nothing; the earliest one counts.
        orders = settle(orders.groupBy("order_id").agg(F.min("placed_at").alias("placed_at"), *[F.sum(c).alias(c) for c in ("fills", "refunded", "redeemed")], F.min("first_fill").alias("first_fill")), "orders")
        fills = steps.filter(F.col("step") != "placed")
        fills = fills if waited is None else waited.unionByName(fills)
        matched = settle(fills.join(orders.select("order_id", "placed_at"), "order_id", "left"), "matched-fills")
        inside = F.col("placed_at").isNotNull()
        gone = F.lit(False)
        if self.within:
            bound = F.lit(self.within)
            inside = inside & (F.col("at") >= F.col("placed_at")) & (F.col("at") <= F.col("placed_at") + bound)
            gone = F.col("placed_at").isNotNull() & ~inside
            if after is not None:  # an order that could claim the fill would be late by now
                gone = gone | (F.col("placed_at").isNull() & (F.col("at") < _moment(after)))
        _with(ledger, base, tables, "stray", matched.filter(gone).select("order_id", "step", "at"))
        tables["waiting"] = [ledger.write(matched.filter(F.col("placed_at").isNull() & ~gone).select("order_id", "step", "at"), "waiting")]
        counted = matched.filter(inside).groupBy("order_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.count_if(F.col("step") == "refunded").alias("r"), F.count_if(F.col("step") == "redeemed").alias("d")
        )
        added = lambda name, more: (F.col(name) + F.coalesce(F.col(more), zero)).alias(name)
        folded = orders.join(counted, "order_id", "left").select("order_id", "placed_at", added("fills", "n"), F.least("first_fill", "first").alias("first_fill"), added("refunded", "r"), added("redeemed", "d"))
        folded = settle(folded, "folded-orders")
        ended = F.col("placed_at") + F.lit(self.within) < _moment(after) if self.within and after is not None else F.lit(False)
        _with(ledger, base, tables, "ended", folded.filter(ended))
        tables["open"] = [ledger.write(folded.filter(~ended), "open")]
        ledger.publish(base, tables, cursor=number, head=head)

    def ends(self) -> DataFrame:
        """(order_id, fills, state, first_latency_s, final): every order so far; `final` ones were given out and do not change."""
        state = self.ledger.state()
        ended, held = self.ledger.read("ended", state), self.ledger.read("open", state)
        parts = [x.select(*ORDER, F.lit(final).alias("final")) for x, final in ((ended, True), (held, False)) if x is not None]
        if not parts:
            raise ValueError("no batch has been taken yet")
        name = F.when(F.col("refunded") > 0, "refunded").when(F.col("redeemed") > 0, "redeemed").when(F.col("fills") > 0, "filled").otherwise("placed")
        return reduce(DataFrame.unionByName, parts).select(
            "order_id", "fills", name.alias("state"), (F.unix_seconds("first_fill") - F.unix_seconds("placed_at")).alias("first_latency_s"), "final"
        )
