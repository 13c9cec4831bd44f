"""Sequential parts of a scenario: aircraft rotation and overlap repair. Both run as kernels over one group at a time."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

ROTATED = "scenario string, flight_id string, aircraft_id string, origin string, destination string, departure timestamp, speed_kts int"


def rotate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Departures in order take the aircraft that is ready longest at their origin, or a new one."""
    pdf = pdf.sort_values(["departure", "idx"], kind="stable", ignore_index=True)
    start = pdf["departure"].to_numpy().astype("datetime64[us]").astype("int64")  # whole microseconds throughout
    back = start + ((pdf["duration_min"] + pdf["tat_min"]) * 60e6).round().astype("int64").to_numpy()
    ready: dict[str, list] = defaultdict(list)
    speed: list[int] = []
    crafts = []
    for dep, end, origin, destination, knots in zip(start.tolist(), back.tolist(), pdf["origin"], pdf["destination"], pdf["speed_kts"].tolist()):
        heap = ready[origin]
        if heap and heap[0][0] <= dep:
            craft = heapq.heappop(heap)[1]
        else:
            speed.append(int(knots))
            craft = len(speed)
        heapq.heappush(ready[destination], (end, craft))
        crafts.append(craft)
    flights = {"flight_id": [f"F{i:07d}" for i in range(1, len(pdf) + 1)], "aircraft_id": [f"AC{c:06d}" for c in crafts], "speed_kts": [speed[c - 1] for c in crafts]}
    return pdf.assign(**flights)[["scenario", "flight_id", "aircraft_id", "origin", "destination", "departure", "speed_kts"]]


def rotation(departures: DataFrame) -> DataFrame:
    """departures (scenario, idx, origin, destination, departure, duration_min, tat_min, speed_kts), all drawn beforehand ->
    flights with their aircraft. Airports depend on each other through time, so a scenario is one group; scenarios are parallel."""
    return departures.groupBy("scenario").applyInPandas(rotate, ROTATED)


def repair(pdf: pd.DataFrame, horizon: int, compat: bool = False) -> pd.DataFrame:
    """Flights of one aircraft in order of start: one that begins before the last has ended moves behind it, or, where that passes
    the horizon, stays as it is on a copy of the aircraft. compat: a flight on a copy still counts as the last."""
    rows, end, copies = [], None, 0
    for r in pdf.sort_values(["start_slot", "flight_id"], kind="stable").itertuples(index=False):
        craft, shift, first, last = r.aircraft_id, 0, r.first, r.last
        if end is not None and end >= first:
            shift = end - first + 1
            if last + shift > horizon:
                craft, shift, copies = f"{r.aircraft_id}_{copies}", shift - max(last + shift - horizon, shift), copies + 1
        if compat or craft == r.aircraft_id:
            end = last + shift
        rows.append((r.flight_id, r.aircraft_id, craft, shift))
    return pd.DataFrame(rows, columns=["flight_id", "aircraft_id", "new_aircraft_id", "shift"])


def overlap_repair(flights: DataFrame, horizon: int, compat: bool = False) -> DataFrame:
    """flights (flight_id, aircraft_id, start_slot, first, last) -> flight_id, aircraft_id, new_aircraft_id, shift. Flights without
    a route are left out by the caller."""
    kind = dict(flights.dtypes)["flight_id"]
    schema = f"flight_id {kind}, aircraft_id string, new_aircraft_id string, shift long"
    few = flights.select("flight_id", flights["aircraft_id"].cast("string").alias("aircraft_id"), "start_slot", "first", "last")
    return few.groupBy("aircraft_id").applyInPandas(lambda pdf: repair(pdf, horizon, compat), schema)
