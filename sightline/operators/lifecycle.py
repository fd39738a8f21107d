"""The life of events out of sightings: sessions, confirmation, cooldown and late promotion, as a batch query.

Sightings of one key (camera, type, subject) form sessions that end after a silence. A session is confirmed at the first
sighting at which enough of them lie within a window (and, if asked, the uninterrupted streak has lasted long enough).
A confirmed event notifies unless the key's last notification is too recent; such a suppressed event is promoted at the
first later sighting that is far enough from it. Unconfirmed sessions are discarded.

One range sort serves all steps. Scans spread each key over the cluster, so that a key that is never silent fills as many
partitions as it needs; what passes between partitions is the end of a session and a few times. The sessions themselves
come from a plain aggregation with partial sums. All times are BIGINT microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.claims import Claim, claims
from sightline.operators.ordered import changes, column, entity_of, range_sorted, rescan, summaries

KEY = ["camera_id", "event_type", "subject"]
SECOND = 1_000_000


@dataclass(frozen=True)
class EventRule:
    """When sightings become an event; seconds."""

    confirm_hits: int = 3
    confirm_window_s: float = 2.0
    close_after_s: float = 10.0
    cooldown_s: float = 30.0
    min_duration_s: float = 0.0
    max_gap_s: float = 1.5

    def __post_init__(self) -> None:
        if self.confirm_hits < 1:
            raise ValueError("confirm_hits must be at least 1")

    def us(self, name: str) -> int:
        return round(getattr(self, f"{name}_s") * SECOND)


@dataclass
class _Open:
    """After a sighting: its entity and time, the start of its session, the number and start of its streak, the last times in it."""

    entity: tuple
    last: int
    session: int
    streak: int
    begun: int
    recent: np.ndarray


class _Sightings:
    """A scan over sorted sightings, batch after batch."""

    def __init__(self, rule: EventRule, state: _Open | None = None) -> None:
        self.state = state
        self.close, self.window, self.duration, self.gap = (rule.us(x) for x in ("close_after", "confirm_window", "min_duration", "max_gap"))
        self.back = rule.confirm_hits - 1
        self.first: tuple[tuple, int] | None = None
        self.session_broken = self.streak_broken = False

    def feed(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The session start and streak number of each row, and whether the rule is met there."""
        t, state = column(b, "ts_us"), self.state
        entity = entity_of(b, KEY, 0)
        goes_on = state is not None and state.entity == entity
        step = np.diff(t, prepend=state.last if goes_on else t[0])
        fresh = changes(b, KEY) | (step >= self.close)
        fresh[0] = not goes_on or step[0] >= self.close
        broken = fresh | (step > self.gap) if self.duration else fresh
        n = np.arange(len(t))
        in_session, in_streak = (np.maximum.accumulate(np.where(x, n, -1)) for x in (fresh, broken))
        held = state or _Open(entity, 0, 0, 0, 0, np.zeros(0, np.int64))
        session = np.where(in_session >= 0, t[in_session], held.session)
        begun = np.where(in_streak >= 0, t[in_streak], held.begun)
        total = np.cumsum(broken & ~fresh)
        streak = np.where(in_session >= 0, total - total[in_session], total + held.streak)
        known = np.concatenate([held.recent, t])
        start = np.where(in_streak >= 0, len(held.recent) + in_streak, 0)
        source = len(held.recent) + n - self.back
        meets = (source >= start) & (t - known[np.maximum(source, 0)] <= self.window)
        if self.duration:
            meets &= t - begun >= self.duration
        if self.first is None:
            self.first = entity, int(t[0])
            self.session_broken, self.streak_broken = bool(fresh[1:].any()), bool(broken[1:].any())
        else:
            self.session_broken |= bool(fresh.any())
            self.streak_broken |= bool(broken.any())
        tail = known[max(int(start[-1]), len(known) - self.back) :] if self.back else known[:0]
        self.state = _Open(entity_of(b, KEY, b.num_rows - 1), int(t[-1]), int(session[-1]), int(streak[-1]), int(begun[-1]), tail)
        return session, streak, meets

    def after(self, before: _Open | None) -> _Open:
        """The state behind a partition scanned from nothing, had it begun in ``before``."""
        out, (entity, t) = copy(self.state), self.first
        if before is None or before.entity != entity or t - before.last >= self.close or self.session_broken:
            return out
        parted = bool(self.duration) and t - before.last > self.gap
        out.session, out.streak = before.session, before.streak + parted + out.streak
        if not parted and not self.streak_broken:
            out.begun = before.begun
            out.recent = np.concatenate([before.recent, out.recent])[-self.back :] if self.back else out.recent
        return out


def confirmations(candidates: DataFrame, rule: EventRule) -> DataFrame:
    """The candidates (key, ts_us, seq, confidence, ...) in time order with ``session``, the time their session began,
    ``streak`` (number of the uninterrupted streak) and ``meets`` (the rule is met). Rows without time are left out."""
    ordered = range_sorted(candidates.where("ts_us IS NOT NULL"), [*KEY, "ts_us", "seq"])
    schema = T.StructType([*ordered.schema.fields, T.StructField("session", T.LongType()), T.StructField("streak", T.LongType()), T.StructField("meets", T.BooleanType())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> _Sightings:
        found = _Sightings(rule)
        for b in batches:
            found.feed(b)
        return found

    carried, state = {}, None
    for pid, s in summaries(ordered.select(*KEY, "ts_us", "__pid"), summarise):
        carried[pid] = state
        state = s.after(state)

    def scan(state: _Open | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Sightings(rule, state)
        for b in batches:
            session, streak, meets = found.feed(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(session, pa.int64()), pa.array(streak, pa.int64()), pa.array(meets)], names=schema.names)

    return rescan(ordered, carried, scan, schema)


def session_summary(confirmed: DataFrame) -> DataFrame:
    """One row per session: its sightings, their peak (ties: the last), when it was confirmed and, if known, notified."""
    notified = [F.min(F.when(F.col("claimed"), F.col("ts_us"))).alias("notified_us")] if "claimed" in confirmed.columns else []
    one = confirmed.groupBy(*KEY, "session").agg(F.max("ts_us").alias("last_us"), F.count("*").alias("hits"), F.max(F.struct("confidence", "seq")).alias("peak"), F.min(F.when(F.col("meets"), F.col("ts_us"))).alias("confirm_us"), *notified)
    return one.select(*KEY, F.col("session").alias("started_us"), "last_us", "hits", F.col("peak.confidence").alias("peak_confidence"), F.col("peak.seq").alias("peak_seq"), "confirm_us", *(["notified_us"] if notified else []))


def lifecycle(candidates: DataFrame, rule: EventRule) -> DataFrame:
    """The confirmed events: key, times, hits, peak, ``outcome`` and ``notified_us``; closed after the silence."""
    seen = confirmations(candidates, rule).select(*KEY, "ts_us", "seq", "confidence", "session", "meets", "__pid")
    slots = claims(seen, Claim(KEY, "ts_us", "meets", rule.us("cooldown"), unit="session"))
    done = session_summary(slots).where("confirm_us IS NOT NULL")
    outcome = F.when(F.col("notified_us").isNull(), "SUPPRESSED").when(F.col("notified_us") == F.col("confirm_us"), "CONFIRMED").otherwise("PROMOTED")
    return done.withColumns({"outcome": outcome, "closed_us": F.col("last_us") + rule.us("close_after")})


def open_sessions(summary: DataFrame, now_us: int, rule: EventRule) -> DataFrame:
    """The sessions still open at a moment."""
    return summary.where((F.col("started_us") <= now_us) & (F.col("last_us") + rule.us("close_after") > now_us))


def cooldown_slots(df: DataFrame, keys: list[str], time_us: str, seq: str, cooldown_us: int, inclusive: bool = True, success: str | None = None) -> DataFrame:
    """The rows that claim a notification slot: the first, then each one that is a cooldown away from the last that did.

    ``inclusive``: a distance equal to the cooldown is enough. ``success``: a BOOLEAN column; only rows in which it is
    true move the slot, others may try again. Rows without time are left out.
    """
    moves = F.coalesce(F.col(success), F.lit(False)) if success else F.lit(True)
    base = df.select(*keys, F.col(time_us).alias("t"), F.col(seq).alias("s"), moves.alias("ok")).where("t IS NOT NULL")
    found = claims(range_sorted(base, [*keys, "t", "s"]), Claim(keys, "t", "ok", cooldown_us, inclusive))
    apart = F.col("t") - F.col("since")
    free = F.col("since").isNull() | (apart >= cooldown_us if inclusive else apart > cooldown_us)
    return found.where(free).select(*keys, F.col("t").alias(time_us), F.col("s").alias(seq))
