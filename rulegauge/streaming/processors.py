"""Keyed state for the online forms: windows, last record, chain, agreement, silence, lateness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GENESIS = "0" * 64
MICROS = 1_000_000


def _whole(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The key's rows of this micro-batch in order. All of them are held at once: bound the micro-batch by its trigger."""
    parts = [p for p in rows if len(p)]
    return pd.concat(parts, ignore_index=True).sort_values(order, ignore_index=True) if parts else pd.DataFrame()


class PerKey(StatefulProcessor):
    """State per key, many keys at a call: rows are grouped by a bucket of keys, as a call and a frame per key cost more than
    the work on a short key. State maps the key's values to ``held``; only keys with rows are read and written."""

    held: str
    order = ["us", "measurement_id"]

    def __init__(self, key_names: list[str]):
        self.key_names = key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", ", ".join(f"k{i} string" for i in range(len(self.key_names))), self.held)

    def answer(self, rows: dict[str, np.ndarray], found: tuple | None) -> tuple[dict, tuple]:
        """Columns that answer a key's rows, and what to hold. ``found`` is what was held."""
        raise NotImplementedError

    def keys_of(self, batch: pd.DataFrame) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
        """The keys of an ordered batch, each with its rows as arrays by column, in order."""
        names = [tuple(None if pd.isna(x) else x for x in k) for k in zip(*[batch[k] for k in self.key_names])]
        places: dict[tuple, list[int]] = {}
        for at, name in enumerate(names):
            places.setdefault(name, []).append(at)
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        for name, at in places.items():
            yield name, {c: v[at] for c, v in columns.items()}

    def handleInputRows(self, key, rows, timerValues):
        batch = _whole(rows, self.order)
        if batch.empty:
            return
        told: dict[str, list] = {}
        for name, mine in self.keys_of(batch):
            answers, held = self.answer(mine, self.kept.getValue(name))
            self.kept.updateValue(name, held)
            n = len(mine[self.order[0]])
            for column, values in ({k: [v] * n for k, v in zip(self.key_names, name)} | answers).items():
                told.setdefault(column, []).extend(values)
        yield pd.DataFrame(told)

    def close(self) -> None:
        pass


class TrailingWindow(PerKey):
    """Count, sum and mean over ``(t - seconds, t]`` per key.

    State is one value with the times and numbers held; tiles of time older than the window and the allowed lateness are dropped.
    ``late`` marks a record older than one of an earlier batch: answers given since then did not know it.
    ``to_replay`` marks a record whose window reaches into dropped tiles: its own answer may lack records.
    """

    held = "newest bigint, kept_from bigint, us binary, val binary"

    def __init__(self, key_names: list[str], seconds: int, tiles: int = 8, keep_seconds: int = 86_400):
        super().__init__(key_names)
        self.span = seconds * MICROS
        self.width = -(-self.span // tiles)
        self.keep = self.span + keep_seconds * MICROS

    def answer(self, rows, found):
        us, val = rows["us"].astype(np.int64), rows["val"].astype(np.float64)
        newest, kept_from, old_us, old_val = found or (None, None, b"", b"")
        held_us = np.concatenate([np.frombuffer(bytes(old_us), np.int64), us])
        held_val = np.concatenate([np.frombuffer(bytes(old_val), np.float64), val])
        all_us, all_val = held_us, held_val
        order = np.argsort(all_us, kind="stable")
        all_us, all_val = all_us[order], all_val[order]
        numeric = ~np.isnan(all_val)
        sums = np.concatenate([[0.0], np.cumsum(np.where(numeric, all_val, 0.0))])
        counts = np.concatenate([[0], np.cumsum(numeric)])
        lo = np.searchsorted(all_us, us - self.span, side="right")
        hi = np.searchsorted(all_us, us, side="right")
        n = counts[hi] - counts[lo]
        total = np.where(n > 0, sums[hi] - sums[lo], np.nan)
        late = np.zeros(len(us), bool) if newest is None else us < newest
        lost = np.zeros(len(us), bool) if kept_from is None else us - self.span + 1 < kept_from
        newest = int(us.max()) if newest is None else max(newest, int(us.max()))
        horizon = (newest - self.keep) // self.width
        stays = held_us // self.width >= horizon
        if not stays.all():
            kept_from = max(horizon * self.width, kept_from or horizon * self.width)
        return {"measurement_id": rows["measurement_id"], "count": hi - lo, "sum_value": total,
                "avg_value": np.divide(total, n, out=np.full(len(us), np.nan), where=n > 0), "late": late, "to_replay": lost}, (
            newest, kept_from, held_us[stays].tobytes(), held_val[stays].tobytes())


class LastRecord(PerKey):
    """Seconds since the key's record before. Records older than the newest one held are marked late."""

    held = "us bigint"

    def answer(self, rows, found):
        us = rows["us"].astype(np.int64)
        held = None if found is None else found[0]
        before = np.concatenate([[np.nan if held is None else float(held)], us[:-1].astype(np.float64)])
        late = np.zeros(len(us), bool) if held is None else us < held
        first_on_time = int(late.sum())
        if held is not None and first_on_time < len(us):
            before[first_on_time] = float(held)
        gap = np.where(late, np.nan, (us - before) / MICROS)
        return {"measurement_id": rows["measurement_id"], "since_last": gap, "late": late}, (int(max(us.max(), held or us.max())),)


class ChainAppend(StatefulProcessor):
    """Single writer per ledger: sequence number and head hash carry from batch to batch."""

    def __init__(self, ledger: str):
        self.ledger = ledger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq bigint, hash string")

    def handleInputRows(self, key, rows, timerValues):
        batch = _whole(rows, ["timestamp_iso", "telemetry_id"])
        if batch.empty:
            return
        seq, tip = self.head.get() or (0, GENESIS)
        numbers, before, after = [], [], []
        for lead, middle, tail in zip(batch["lead_text"], batch["middle_text"], batch["tail_text"]):
            seq += 1
            numbers.append(seq)
            before.append(tip)
            tip = hashlib.sha256(f"{lead}{tip}{middle}{seq}{tail}".encode()).hexdigest()
            after.append(tip)
        self.head.update((seq, tip))
        yield pd.DataFrame({self.ledger: key[0], "telemetry_id": batch["telemetry_id"], "sequence_number": numbers,
                            "previous_hash": before, "entry_hash": after})

    def close(self) -> None:
        pass


class RollingAgreement(StatefulProcessor):
    """Agreement over the last ``n`` statuses of a key, after each entry. State is one letter per entry."""

    def __init__(self, key: str, n: int, threshold: float):
        self.key, self.n, self.threshold = key, n, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "letters string")

    def handleInputRows(self, key, rows, timerValues):
        batch = _whole(rows, ["sequence_number"])
        if batch.empty:
            return
        held = self.ring.get()[0] if self.ring.exists() else ""
        letters = held + "".join("a" if s == "AGREED" else "x" for s in batch["verifier_status"])
        hits = np.concatenate([[0], np.cumsum(np.frombuffer(letters.encode(), np.uint8) == ord("a"))])
        stop = np.arange(len(held) + 1, len(letters) + 1)
        start = np.maximum(stop - self.n, 0)
        rate = (hits[stop] - hits[start]) / (stop - start)
        self.ring.update((letters[-self.n:],))
        yield pd.DataFrame({self.key: key[0], "entry_id": batch["entry_id"], "observed": stop - start,
                            "agreement_rate": rate, "is_healthy": rate >= self.threshold})

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """A row when a source has been quiet for more than ``seconds``: at the timer, or when it speaks again."""

    def __init__(self, key: str, seconds: int):
        self.key, self.limit = key, seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        batch = _whole(rows, ["us"])
        if batch.empty:
            return
        us = batch["us"].to_numpy(np.int64)
        held, told = self.last.get() if self.last.exists() else (None, True)
        # a record older than the newest one ends no silence that is still open and starts none
        us = us if held is None else us[us > held]
        if not len(us):
            return
        # a silence already told by the timer is not told again
        chain = us if told else np.concatenate([[held], us])
        chain = np.sort(chain)
        quiet = np.diff(chain) > self.limit
        starts = chain[:-1][quiet].tolist()
        newest = int(chain[-1])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.limit) // 1000 + 1)
        self.last.update((newest, False))
        if starts:
            yield pd.DataFrame({self.key: key[0], "silent_from_us": starts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            held, told = self.last.get()
            if not told:
                self.last.update((held, True))
                yield pd.DataFrame({self.key: [key[0]], "silent_from_us": [held]})

    def close(self) -> None:
        pass


class Lateness(PerKey):
    """How far each record lies behind the newest record its source had sent in earlier batches."""

    held = "us bigint"

    def __init__(self, key_names: list[str], allowed_seconds: int):
        super().__init__(key_names)
        self.allowed = allowed_seconds * MICROS

    def answer(self, rows, found):
        us = rows["us"].astype(np.int64)
        held = None if found is None else found[0]
        behind = np.zeros(len(us), np.int64) if held is None else np.maximum(held - us, 0)
        return {"measurement_id": rows["measurement_id"], "behind_seconds": behind / MICROS, "to_replay": behind > self.allowed}, (
            int(us.max() if held is None else max(held, us.max())),)
