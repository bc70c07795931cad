"""Small inputs built by hand, and a plain-Python account of what to expect."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

DAY = "2026-01-05"


def at(text: str, day: str = DAY) -> datetime:
    return datetime.fromisoformat(f"{day} {text}")


def error(event_id: str, service: str | None, time: str, message: str | None = None, day: str = DAY) -> dict:
    stamp = time if time == "bad" else f"{day}T{time}Z"
    return envelope(event_id, "log", service, stamp, {"level": "ERROR", "message": message or event_id})


def deployment(event_id: str, service: str, time: str, conclusion: str = "success", day: str = DAY) -> dict:
    return envelope(event_id, "deployment", service, f"{day}T{time}Z", {"conclusion": conclusion})


def envelope(event_id, event_type, service, timestamp, payload) -> dict:
    return {"event_id": event_id, "event_type": event_type, "source": "test", "timestamp": timestamp,
            "service_name": service, "payload": payload if isinstance(payload, str) else json.dumps(payload)}


RAW = ("event_id string, event_type string, source string, timestamp string, service_name string, "
       "payload string")


def raw(spark, rows: list[dict]):
    names = [c.split()[0] for c in RAW.split(",")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RAW)
    return df.withColumn("ingested_at", F.to_timestamp(F.lit("2026-01-06 00:00:00")))


SIGNAL = "event_id string, service_name string, event_at timestamp, negative_reason string"


def minute(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)) // timedelta(minutes=1))


def brute_sessions(signals: list[tuple], gap: int) -> list[dict]:
    """Each signal with its predecessor, flag and number, row by row."""
    out = []
    for service in {s[1] for s in signals}:
        mine = [s for s in signals if s[1] == service]
        mine.sort(key=lambda s: (s[2] is not None, s[2] or datetime.min, s[0]))
        previous, seq = None, 0
        for eid, _, t, reason in mine:
            new = previous is None or minute(t) - minute(previous) > gap
            seq += new
            out.append({"event_id": eid, "service": service, "at": t, "reason": reason, "prev": previous,
                        "new": int(new), "seq": seq})
            previous = t
    return out


def brute_incidents(signals: list[tuple], gap: int) -> set[tuple]:
    groups: dict = {}
    for r in brute_sessions(signals, gap):
        key = (r["service"], r["seq"] if r["service"] is not None else None)
        groups.setdefault(key, []).append(r)
    out = set()
    for (service, seq), rows in groups.items():
        times = [r["at"] for r in rows if r["at"] is not None]
        iid = None if service is None else hashlib.sha256(f"{service}|{seq}".encode()).hexdigest().upper()
        out.add((iid, service, min(times, default=None), max(times, default=None), len(rows),
                 min(r["reason"] for r in rows if r["new"])))
    return out


def brute_correlation(incidents, deployments, lookback: int) -> set[tuple]:
    """(incident_id, deployment_id, minutes) for every match."""
    out = set()
    for iid, service, start in incidents:
        best = None
        for did, dservice, t in deployments:
            if dservice == service and t <= start and minute(start) - minute(t) <= lookback:
                best = max(best or (t, did), (t, did))
        if best:
            out.add((iid, best[1], minute(start) - minute(best[0])))
    return out
