"""Events over a stream of photos: the sequential rule with the last photo of each library as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlake.operators.events import DEFAULTS, EventConfig

_OUT = "library_id long, id long, event_id long"
_STATE = "epoch double, latitude double, longitude double, embedding array<double>, event_id long"


def _number(x) -> float | None:
    return None if pd.isna(x) else float(x)


def _far(epoch: np.ndarray, lat: np.ndarray, lon: np.ndarray, vectors: list, strategy: str, config: EventConfig) -> np.ndarray:
    """Of photos in their order, whether each but the first opens an event after the one before."""
    gap = np.minimum(np.abs(np.diff(epoch)) / 3600 / max(config.max_gap_hours, 1e-6), 1.0)
    if strategy == "time_only":
        return gap > config.threshold
    distance = config.time_weight * gap
    size = np.array([0 if v is None else len(v) for v in vectors])
    x = np.zeros((len(size), int(size.max(initial=0))))
    for n in set(size.tolist()) - {0}:
        which = np.flatnonzero(size == n)
        x[which, :n] = np.array([vectors[i] for i in which], float)
    length = np.sqrt((x * x).sum(1))
    seen = (size[1:] > 0) & (size[:-1] == size[1:])
    distance += config.visual_weight * np.where(seen, 1 - (x[1:] * x[:-1]).sum(1) / np.maximum(length[1:] * length[:-1], 1e-12), 0.0)
    if strategy == "time_clip_gps":
        p, q = np.radians(lat), np.radians(lon)
        h = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(np.diff(q) / 2) ** 2
        far = np.minimum(2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0))) / config.geo_scale_km, 1.0)
        distance += config.geo_weight * np.nan_to_num(far)
    return distance > config.threshold


def streaming_events(photos: DataFrame, strategy: str = "time_clip_gps", config: EventConfig = DEFAULTS) -> DataFrame:
    """(library_id, id, event_id) of a stream of photos with captured_epoch; order within a micro-batch is by time.

    State is one photo per library.  A photo that comes after a later one has been seen is held against that one.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        join = lambda c, kind: np.concatenate([p[c].to_numpy(kind) for p in parts])
        ids, epoch = join("id", object), join("captured_epoch", float)
        order = np.lexsort((ids.astype(np.int64), epoch))
        epoch, lat, lon = epoch[order], join("latitude", float)[order], join("longitude", float)[order]
        vectors = list(join("embedding", object)[order])
        last, n = state.get if state.exists else None, len(order)
        if last is not None:  # the photo before them
            epoch, lat, lon = (np.append(np.nan if x is None else x, c) for x, c in zip(last[:3], (epoch, lat, lon), strict=True))
            vectors.insert(0, last[3])
        opens = _far(epoch, lat, lon, vectors, strategy, config).cumsum()
        events = int(last[4]) + opens if last is not None else np.append(0, opens)
        state.update((float(epoch[-1]), _number(lat[-1]), _number(lon[-1]), None if vectors[-1] is None else [float(x) for x in vectors[-1]], int(events[-1])))
        yield pd.DataFrame({"library_id": [key[0]] * n, "id": ids[order], "event_id": events})

    keyed = photos.where("captured_epoch is not null").select("library_id", "id", "captured_epoch", "latitude", "longitude", "embedding").groupBy("library_id")
    return keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
